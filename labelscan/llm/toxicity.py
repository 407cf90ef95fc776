"""Toxic passages by maximum-scoring segments over token log-odds.

1. Document frequencies of words and word beginnings, by label, come from a bounded sample of labelled rows. A feature
   enters the lexicon if it stands in more toxic rows than chance explains: its binomial tail (Chernoff's bound) passes
   Benjamini and Hochberg's procedure at FALSE_SHARE over all features tested, so that the bar follows the number of rows
   and of features. Its weight is the log-odds under an informative Dirichlet prior: the pooled frequencies, as heavy as
   the square root of the number of rows. It has to outweigh the labels' own odds: rows with the feature are toxic more
   often than not. Any other token scores NEUTRAL, which is negative.
2. The linear-time scan of Ruzzo and Tompa finds all maximal-scoring segments of a whole text. Since only lexicon tokens
   are positive, it runs over these, the neutral stretches between them being single negative items.
3. Under the null model the best segment of n tokens has an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)).
   lambda solves sum p(s) exp(lambda s) = 1 over the scores of tokens in clean texts, K is its maximum-likelihood value on
   clean texts. Every segment gets its p by this law; passages are the segments at or below LEVEL.
4. A logistic curve over the evidence of all passages of a text together gives the probability. The scores that K and the
   curve are fitted on come from lexicons that have not seen the row (FOLDS folds by text). Where rows are too few to fit
   the slope, it stays at SLOPE.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.fit import logistic, sigmoid
from labelscan.llm.shared import SPACES, Words, mixed, pieces, plus

#: Labelled rows used at most; they bound the lexicon too.
SAMPLE = 24_000
#: Share of the lexicon that may be there by chance, p up to which a segment is a passage, score of other tokens, folds.
FALSE_SHARE, LEVEL, NEUTRAL, FOLDS = 0.1, 0.05, -0.25, 5
SLOPE = 2.0
BEGINNINGS = (4, 5, 6, 7, 8)
#: Tokens are runs of letters and digits; all bytes of other characters than ASCII count as letters.
BREAKS = SPACES.copy()
BREAKS[[i for i in range(128) if not chr(i).isalnum()]] = True
_FILTER_BITS = 20


def features(words: Words) -> list[np.ndarray]:
    """Hashes of each token and of its beginnings of some lengths; 0 where the token is not longer."""
    out = [words.hashes]
    lengths = words.ends - words.starts
    for k in BEGINNINGS:
        longer = lengths > k
        h = np.zeros(len(lengths), np.uint64)
        h[longer] = mixed(words.spans(words.starts[longer], words.starts[longer] + k) ^ np.uint64(k))
        out.append(h)
    return out


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    decay: float = 1.0  # lambda and K of the extreme-value law
    scale: float = 1.0
    curve: tuple[float, float] = (SLOPE, 0.0)  # of the passages' evidence, and a constant

    def __post_init__(self):
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def p_values(self, n: int, scores: np.ndarray) -> np.ndarray:
        """Chance of a segment of each score or more in a clean text of n tokens."""
        return -np.expm1(-self.scale * n * np.exp(-self.decay * scores))

    def evidence(self, n: int, scores: np.ndarray) -> float:
        """-ln P of a text's passages together, on a log scale; 0 without a passage.

        P is that of Karlin and Altschul's sum statistic: the r best passages, with t = -ln p in sum, come about with
        probability exp(-t) t**(r-1) / (r! (r-1)!); the r that is least likely counts.
        """
        t = -np.log(np.maximum(self.p_values(n, scores), 1e-300))
        t = np.cumsum(np.sort(t[t >= -np.log(LEVEL)])[::-1])
        if not len(t):
            return 0.0
        r = np.arange(1, len(t) + 1)
        factorials = np.cumsum(np.log(r))
        return float(np.log1p(max((t - (r - 1) * np.log(t) + 2 * factorials - np.log(r)).max(), 0.0)))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] * evidence + self.curve[1])

    def token_scores(self, words: Words) -> np.ndarray:
        """The largest log-odds of a token's features; NEUTRAL without one in the lexicon."""
        out = np.full(len(words.starts), NEUTRAL)
        if not len(self.keys):
            return out
        for h in features(words):
            maybe = np.flatnonzero(self.filter[(h & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            found = self.keys[at] == h[maybe]
            out[maybe[found]] = np.maximum(out[maybe[found]], self.weights[at[found]])
        return out


def segments(positions: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (first token, end token, score), given the positive tokens; others score NEUTRAL.

    A candidate keeps a link to the nearest one to its left with a smaller sum before it, which lets a search skip all
    that an earlier one has passed: the time is linear.
    """
    first: list[int] = []
    end: list[int] = []
    low: list[float] = []  # sum before the candidate
    high: list[float] = []  # sum after it
    link: list[int] = []
    total, last = 0.0, -1
    for p, s in zip(positions.tolist(), scores.tolist(), strict=True):
        total += NEUTRAL * (p - last - 1)
        a, before = p, total
        total += s
        last = p
        j = len(first) - 1
        while j >= 0 and low[j] >= before:
            j = link[j]
        while j >= 0 and high[j] < total:  # joined with all candidates from there on
            a, before, k = first[j], low[j], link[j]
            for x in (first, end, low, high, link):
                del x[j:]
            j = k
        for x, v in zip((first, end, low, high, link), (a, p + 1, before, total, j), strict=True):
            x.append(v)
    return [(a, b, d - c) for a, b, c, d in zip(first, end, low, high, strict=True)]


def scan(texts: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, list[tuple[int, int]]]]:
    """For each text: tokens, lexicon tokens, its segments' scores, and their places in bytes."""
    words = Words(texts, lower=True, separators=BREAKS)
    scores = model.token_scores(words)
    positive = np.flatnonzero(scores > 0)
    cuts = np.searchsorted(positive, words.first)
    for d in range(words.n):
        own = positive[cuts[d] : cuts[d + 1]]
        base, offset = words.first[d], words.offsets[d]
        runs = segments(own - base, scores[own]) if len(own) else []
        places = [(int(words.starts[base + a] - offset), int(words.ends[base + b - 1] - offset)) for a, b, _ in runs]
        yield int(words.counts[d]), len(own), np.array([s for *_, s in runs], float), places


def _decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum shares * exp(x * scores) = 1."""
    low, high = 1e-6, 50.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if shares @ np.exp(x * scores) < 1 else (low, x)
    return low


def _log_tail(a: Column, b: Column, n1: int, n0: int) -> Column:
    """Logarithm of Chernoff's bound of P(X >= a) for X of a + b rows, each toxic at the labels' share; 0 if a is no more than that."""
    share, c = (n1 + 0.5) / (n1 + n0 + 1), a + b
    part = lambda x, p: F.when(x > 0, x * F.log(x / (c * p))).otherwise(0.0)
    return F.when(a > c * share, -(part(a, share) + part(b, 1 - share))).otherwise(0.0)


def log_tail(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """_log_tail() of arrays."""
    share, c = (n1 + 0.5) / (n1 + n0 + 1), np.maximum(a + b, 1)
    part = lambda x, p: np.where(x > 0, x * np.log(np.maximum(x, 1) / (c * p)), 0)
    return np.where(a > c * share, -(part(a, share) + part(b, 1 - share)), 0)


def lexicon(a: np.ndarray, b: np.ndarray, n1: int, n0: int, tested: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features (in a of n1 toxic rows and b of n0 others) enter the lexicon, and the weights of all.

    tested[c] counts the features in c rows. As with Tarone's correction, those that are too rare to reach a bar don't
    count as tested at that bar.
    """
    tail = log_tail(a, b, n1, n0)
    c = np.flatnonzero(tested)
    reach = log_tail(np.minimum(c, n1), c - np.minimum(c, n1), n1, n0)
    by = np.argsort(reach)
    able = np.concatenate(([0], np.cumsum(tested[c][by])))
    order = np.sort(tail)
    competitors = np.maximum(able[np.searchsorted(reach[by], order, "right")], 1)
    passed = np.flatnonzero(order <= np.log(FALSE_SHARE * np.arange(1, len(order) + 1) / competitors))
    chosen = tail <= order[passed[-1]] if len(passed) else np.zeros(len(tail), bool)
    heavy = np.sqrt(n1 + n0)
    prior = heavy * (a + b) / max(n1 + n0, 1)
    odds = lambda x, n: np.log((x + prior + 1e-9) / np.maximum(n + heavy - x - prior, 1e-9))
    weights = odds(a, n1) - odds(b, n0)
    return chosen & (weights >= np.log((n0 + 1) / (n1 + 1))), weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows, taken by a hash of the id. Labels of one class only give an empty lexicon.

    Rows that repeat an id have the largest of its labels; texts that agree, label included, count once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64(F.col(key)), key).limit(sample)
    taken = docs.select(key, text).join(F.broadcast(chosen), key)  # at most `sample` rows of two numbers
    taken = taken.dropDuplicates([text, "_label"]).withColumn("_fold", F.pmod(F.xxhash64(F.lit("fold"), text), F.lit(FOLDS)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                words = Words(part.column(text), lower=True, separators=BREAKS)
                cell = part.column("_label").to_numpy().astype(np.int64) * FOLDS + part.column("_fold").to_numpy()
                rows = (words.docs.astype(np.uint64), cell[words.docs].astype(np.uint64))
                keys = [np.unique(np.column_stack((h, *rows))[h != 0], axis=0) for h in features(words)]
                pairs, n = np.unique(np.concatenate(keys)[:, [0, 2]], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (pairs[:, 0], pairs[:, 1], n)], ["feature", "cell", "n"])

    rows = {(int(r["_label"]), r["_fold"]): r["count"] for r in taken.groupBy("_label", "_fold").count().collect()}
    size = np.array([[rows.get((y, f), 0) for f in range(FOLDS)] for y in (0, 1)])
    cells = [F.sum(F.when(F.col("cell") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(2 * FOLDS)]
    counts = taken.select("_label", "_fold", text).mapInArrow(count, "feature long, cell long, n long").groupBy("feature").agg(*cells)
    columns = [[F.col(f"n{y * FOLDS + f}") for f in range(FOLDS)] for y in (0, 1)]
    total = lambda y, but=-1: sum((c for f, c in enumerate(columns[y]) if f != but), F.lit(0))
    tails = [_log_tail(total(1, f), total(0, f), *(int(size[y].sum() - (size[y, f] if f >= 0 else 0)) for y in (1, 0))) for f in range(-1, FOLDS)]
    counts = counts.where(total(0) + total(1) > 1)  # in one row only, a feature can't be significant
    by_rows = counts.groupBy((total(0) + total(1)).alias("rows")).count().collect()  # a row for each number of rows
    tested = np.bincount([r["rows"] for r in by_rows], [r["count"] for r in by_rows]) if by_rows else np.zeros(1)
    least = counts.withColumn("_tail", F.least(*tails)).where(F.col("_tail") < float(np.log(FALSE_SHARE)))
    found = least.drop("_tail").toPandas()  # eleven numbers for each feature of the sample that could be significant
    found = found.iloc[np.argsort(found["feature"].to_numpy(np.int64).view(np.uint64))]
    keys = found["feature"].to_numpy(np.int64).view(np.uint64)
    n = found[[f"n{i}" for i in range(2 * FOLDS)]].to_numpy(np.int64).reshape(-1, 2, FOLDS)

    def without(fold: int) -> Model:
        others = [f for f in range(FOLDS) if f != fold]
        a, b = n[:, 1, others].sum(axis=1), n[:, 0, others].sum(axis=1)
        enters, weights = lexicon(a, b, int(size[1, others].sum()), int(size[0, others].sum()), tested)
        return Model(keys[enters], weights[enters])

    model, parts = without(-1), [without(f) for f in range(FOLDS)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                folds = part.column("_fold").to_numpy()
                for f in np.unique(folds).tolist():
                    own = part.filter(pa.array(folds == f))
                    n_tokens, hits, scores, _ = zip(*scan(own.column(text), parts[f]), strict=True)
                    columns = [own.column("_label").cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array([s.tolist() for s in scores], pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, ["y", "n", "hits", "scores"])

    seen = taken.select("_label", "_fold", text).mapInArrow(measure, "y long, n long, hits long, scores array<double>").toPandas()
    clean = seen[seen.y == 0]
    share = (clean.hits.sum() + 1) / (clean.n.sum() + 2)  # of lexicon tokens in clean texts
    if len(model.weights):
        scores = np.append(model.weights, NEUTRAL)
        model.decay = _decay(scores, np.append(np.full(len(model.weights), share / len(model.weights)), 1 - share))
    best = np.array([max(s, default=0.0) for s in clean.scores], float)
    model.scale = ((best > 0).sum() + 0.5) / (clean.n.to_numpy() * np.exp(-model.decay * best)).sum() if len(clean) and clean.n.sum() else 1.0
    x = np.array([model.evidence(n, np.asarray(s, float)) for n, s in zip(seen.n, seen.scores, strict=True)])
    model.curve = tuple(logistic(x, seen.y.to_numpy(float), ridge=1.0, toward=(SLOPE,)).tolist())
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus toxicity (0 to 1), n_tokens, best (segment score) and passages: all significant segments.

    A passage is a span in bytes of the UTF-8 text, end exclusive, with its score and p. Null and empty texts have no
    tokens and get the probability of a text without a segment. Whole texts are scanned; equal texts get equal results;
    an empty table gives no rows. Result columns replace columns of the same names.
    """
    docs = docs.drop("toxicity", "n_tokens", "best", "passages")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
    schema = plus(docs, "toxicity double, n_tokens long, best double, passages array<struct<start: long, end: long, score: double, p: double>>")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                n, best, evidence, passages = [], [], [], []
                for tokens, _, scores, places in scan(part.column(text), model):
                    p = model.p_values(tokens, scores)
                    n.append(tokens)
                    best.append(float(scores.max(initial=0.0)))
                    evidence.append(model.evidence(tokens, scores))
                    passages.append([{"start": a, "end": b, "score": s, "p": q} for (a, b), s, q in zip(places, scores.tolist(), p.tolist(), strict=True) if q <= LEVEL])
                p = model.probability(np.array(evidence, float))
                columns = [pa.array(p), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(passages, spans)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names)

    return docs.mapInArrow(run, schema)

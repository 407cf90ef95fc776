"""Document quality by hierarchical empirical Bayes over host and path.

1. A logistic classifier on a dozen surface features gives every document its log-odds against the labelled rows'
   mean: the evidence. It is fitted on a bounded sample of labelled rows.
2. Posteriors are grouped by host and by path below the host. A host's prior is the global mean, a path's prior the
   host's posterior mean; the strength of either prior is estimated by moments from the spread between the groups, so
   that sparse groups shrink towards what lies above them.
3. A document's posterior is its evidence added to the log-odds of its path.

Groups are added up with partial sums, so that a hot host costs no more than any other. A group's own document is taken
out of its sums before it is judged: no document is its own evidence twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.fit import logistic, sigmoid
from labelscan.llm.shared import Words, pieces, plus, stored

#: Labelled rows that the classifier is fitted on at most, and groups up to which their table is broadcast.
SAMPLE, BROADCAST_GROUPS = 20_000, 20_000
#: Weight of the site against the document: groups say less about a document than its own text.
SITE_WEIGHT = 0.5
FEATURES = ("symbols", "marked words", "upper case", "digits", "bars", "exclamations", "distinct words", "repeated neighbours", "word length", "spaces", "lines", "log words")

_SYMBOL, _UPPER, _DIGIT, _LETTER = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
_UPPER[65:91] = _DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; zeros for a null or empty one."""
    w = Words(texts)
    size, n = np.maximum(np.diff(w.offsets), 1), np.maximum(w.counts, 1)
    letters = np.maximum(w.per_doc(_LETTER[w.data]), 1)
    last = np.zeros(len(w.data), bool)
    last[w.ends - 1] = True
    marked = last & _SYMBOL[w.data]
    distinct = np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.first, w.first[1:], strict=False)], float)
    same = np.zeros(len(w.hashes) + 1, np.int64)
    docs = w.docs
    if len(docs) > 1:
        same[2:] = np.cumsum((w.hashes[1:] == w.hashes[:-1]) & (docs[1:] == docs[:-1]))
    repeated = same[w.first[1:]] - same[np.minimum(w.first[:-1] + 1, w.first[1:])]
    lengths = np.concatenate(([0], np.cumsum(w.ends - w.starts)))
    expected = n ** -0.1  # distinct words become rarer in long texts
    return np.column_stack((
        w.per_doc(_SYMBOL[w.data]) / size, w.per_doc(marked) / n, w.per_doc(_UPPER[w.data]) / letters, w.per_doc(_DIGIT[w.data]) / size,
        w.per_doc(w.data == 124) / n, w.per_doc(w.data == 33) / n, np.where(w.counts > 0, distinct / n / expected, 0), repeated / n,
        np.diff(lengths[w.first]) / n / 10, w.per_doc(w.data == 32) / size, w.per_doc(w.data == 10) / n, np.log1p(w.counts) / 10,
    ))


@dataclass
class Model:
    weights: np.ndarray
    mean: float  # share of good rows among the labelled ones

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        """Evidence of each text: its log-odds less those of the mean, within 12 either way."""
        x = features(texts)
        base = np.log(self.mean / (1 - self.mean))
        return np.clip(x @ self.weights[:-1] + self.weights[-1] - base, -12, 12)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows, taken by a hash of the id; without any, every document gets the evidence 0."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_label")).orderBy(F.xxhash64(key), key).limit(sample)
    taken = docs.select(key, text).join(F.broadcast(chosen), key)  # at most `sample` rows of two numbers

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                x = features(part.column(text))
                yield pa.RecordBatch.from_arrays([part.column("_label").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = taken.select("_label", text).mapInArrow(measure, "y long, x array<double>").toPandas()  # at most `sample` rows of FEATURES
    if not len(rows):
        return Model(np.zeros(len(FEATURES) + 1), 0.5)
    y = rows.y.to_numpy(float)
    w = logistic(np.stack(rows.x.to_numpy()), y, ridge=0.01)
    return Model(w, float((y.sum() + 1) / (len(y) + 2)))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Strength of the prior `mean` over groups (n, s, q), by moments: mean * (1 - mean) / variance between groups - 1.

    The variance between the groups' means is lessened by what the sampling of n documents makes by itself.
    """
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.greatest(F.sum(F.col("n") - 1), F.lit(1))
    size = F.sum("n")
    spare = F.greatest(size - F.sum(F.col("n") * F.col("n")) / size, F.lit(1e-9))
    between = (F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)) - (F.count(F.lit(1)) - 1) * within) / spare
    m, v = groups.agg(F.sum(F.col("n") * mean) / size, between).first()  # two numbers
    return 2.0 if m is None else float(min(max(m * (1 - m) / max(v, 1e-6) - 1, 2.0), 1e4))


def judge(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text: str = "text", site_weight: float = SITE_WEIGHT) -> DataFrame:
    """docs plus evidence, host_mean, path_mean, quality (0 to 1) and kept (quality of at least 0.5).

    Null hosts form one host and null paths one path of their host. Null and empty texts have the features of a text
    without words. Repeated rows count as often as they occur. An empty table gives no rows. Columns of docs with a
    result's name are replaced.
    """
    docs = docs.drop("evidence", "host_mean", "path_mean", "quality", "kept")
    schema = plus(docs, "evidence double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.log_odds(part.column(text)))], schema.names)

    base = float(np.log(model.mean / (1 - model.mean)))
    narrow = docs.select(F.col(host).alias("_host"), F.col(path).alias("_path"), F.col(text).alias("_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                p = sigmoid(model.log_odds(part.column("_text")) + base)
                yield pa.RecordBatch.from_arrays([part.column("_host"), part.column("_path"), pa.array(p)], ["_host", "_path", "_p"])

    weighed = narrow.mapInArrow(weigh, plus(narrow.drop("_text"), "_p double"))
    paths = weighed.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q"))
    sites = posteriors(stored(paths, "quality-paths"))
    groups = sites.count()
    sites = F.broadcast(sites) if groups <= BROADCAST_GROUPS else sites  # beyond the bound a shuffled join, whose hot keys Spark splits
    judged = docs.mapInArrow(run, schema)
    joined = judged.join(sites, judged[host].eqNullSafe(F.col("_host")) & judged[path].eqNullSafe(F.col("_path")))
    own = 1 / (1 + F.exp(-(F.col("evidence") + base)))
    # the path's posterior without this document
    path_mean = (F.col("_a") - own) / (F.col("_n") - 1)
    joined = joined.withColumn("path_mean", F.least(F.greatest(path_mean, F.lit(1e-4)), F.lit(1 - 1e-4)))
    site = site_weight * (_logit(F.col("path_mean")) - base) + base
    quality = 1 / (1 + F.exp(-(F.col("evidence") + site)))
    return joined.withColumn("quality", quality).withColumn("kept", F.col("quality") >= 0.5).select(*docs.columns, "evidence", "host_mean", "path_mean", "quality", "kept")


def posteriors(paths: DataFrame) -> DataFrame:
    """Path sums (_host, _path, n, s, q) -> host_mean and the path's posterior as _a of _n."""
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    overall = hosts.agg(F.sum("s") / F.sum("n")).first()[0] or 0.5
    strength = _strength(hosts, F.lit(overall))
    host = hosts.select("_host", ((F.col("s") + strength * overall) / (F.col("n") + strength)).alias("host_mean"))
    below = paths.alias("p").join(host.alias("h"), F.col("p._host").eqNullSafe(F.col("h._host"))).select("p.*", "host_mean")
    inner = _strength(below, F.col("host_mean"))
    return below.select("_host", "_path", "host_mean", (F.col("s") + inner * F.col("host_mean")).alias("_a"), (F.col("n") + inner).alias("_n"))

"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns find the base spans. They run only on stretches of bytes that their characters can make up, which numpy
finds for a whole batch at once; as no match crosses such a stretch's ends, the matches are those of the whole text. All
of them take time in proportion to the text: addresses are read off chains of digit groups, and mail addresses from
their at signs.

The network finds what the patterns miss: it is trained in numpy from the base spans of a bounded sample and from
variants that are made of them: addresses with spaces or words ("at", "dot") for their signs, card numbers with other
separators, phone numbers without a plus. Matches that fail their kind's test (most often the Luhn sum) are outside any
span in the training as in the base: the network learns that such numbers are none, and no number that fails is added.

Overlapping windows of the whole text are decoded, positions take their tag from the window in whose middle half they
lie, which reconciles the windows, and spans are then read off the whole text's tags. A span is added if the CRF is
CERTAIN of it, it touches no base span, and it has the parts of its kind (plausible()). Those need a digit, an at sign,
or the word "at" with a dot after it, so that a window without any of them can't hold a span that is added, and isn't
decoded.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.shared import pieces, plus

KINDS = ("email", "ip", "card", "phone")
#: The kinds' patterns (fixed values).
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
PATTERNS = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))
#: Parts of the first two: what may follow an at sign, and digit groups joined by single dots.
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CHAIN = re.compile(rb"[0-9]++(?:\.[0-9]++)*")

#: Window and step in characters, documents and windows of the training sample at most, hidden units, training steps.
WINDOW, STEP, SAMPLE_DOCS, SAMPLE_WINDOWS, HIDDEN, STEPS = 64, 32, 6000, 6000, 16, 400
BATCH = 1024
#: Mean posterior of a span's tags from which it is added.
CERTAIN = 0.9

_MAIL_BYTE, _NUMBER_BYTE, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_DIGIT[48:58] = True
_MAIL_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *b"._%+-@"]] = True
_NUMBER_BYTE[[*range(48, 58), *b" .()+-"]] = True
#: Character classes that the network reads.
_CLASS = np.ones(256, np.int64)  # 1: any other
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 2, 3, 4, 5
for _i, _c in enumerate(b"@._%+-() \n,:=\"'[]/"):
    _CLASS[_c] = 6 + _i
for _c in b"atdo":  # the letters of the words for the signs of an address
    _CLASS[[_c, _c - 32]] = int(_CLASS.max()) + 1
CLASSES = int(_CLASS.max()) + 1  # class 0 is outside the text
TAGS = 1 + 2 * len(KINDS)  # outside; beginning and inside of each kind


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(double)) % 10 == 0


def valid(kind: str, match: bytes) -> bool:
    """The test that a match of the kind's pattern must stand."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip(b"0")) <= 3 and int(p) <= 255 for p in match.split(b"."))
    digits = "".join(chr(c) for c in match if 48 <= c <= 57)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


_AT_WORD, _DOT = re.compile(rb"\bat\b", re.I), re.compile(rb"\bdot\b|[A-Za-z0-9]\.[A-Za-z]", re.I)
_AT_SIGN, _DOT_SIGN = (re.compile(rb"[\x20(\[{]*(?:%b|\b%b\b)[\x20)\]}]*" % x, re.I) for x in ((b"@", b"at"), (b"\\.", b"dot")))


def plain(kind: str, found: bytes) -> bytes:
    """A span as its kind's pattern would have it: words and spaces for the signs of an address undone."""
    if kind == "email":
        found = _AT_SIGN.sub(b"@", found)
    return _DOT_SIGN.sub(b".", found) if kind in ("email", "ip") else found


def plausible(kind: str, found: bytes) -> bool:
    """Whether a span has its kind's parts: an address once undone; or digits, set apart by little else, that stand their kind's test, the sum of card numbers too."""
    if kind == "email":
        return bool(EMAIL.fullmatch(plain(kind, found)))
    if kind == "ip":
        found = plain(kind, found)
        return bool(IP.fullmatch(found)) and valid(kind, found)
    digits = re.sub(rb"[^0-9]", b"", found)
    if len(found) > 2 * len(digits) or len(found) == len(digits) or re.search(rb"[^0-9 ()+./_-]", found):
        return False
    return valid(kind, found)


def varied(kind: str, found: bytes, r: random.Random) -> bytes:
    """A base span in a form that its pattern misses."""
    if kind in ("email", "ip"):
        at = r.choice([b" at ", b" (at) ", b" [at] ", b" AT ", b" @ "])
        dot = r.choice([b" dot ", b" (dot) ", b" [dot] ", b" DOT ", b" . "] + [b"."] * (2 if kind == "email" else 0))
        return found.replace(b".", dot).replace(b"@", at)
    digits = re.sub(rb"[^0-9]", b"", found)
    gap = r.choice([b".", b"_", b"/", b" - ", b"  "] if kind == "card" else [b".", b"-", b" ", b"/"])
    size = 4 if kind == "card" else 3
    parts = [digits[i : i + size] for i in range(0, len(digits), size)]
    if kind == "phone" and len(parts[-1]) < 3:
        parts[-2:] = [parts[-2] + parts[-1]]
    return gap.join(parts)


class Batch:
    """Bytes of some documents, with what the patterns and the network need of them."""

    def __init__(self, texts: pa.Array | list[bytes]):
        values = texts if isinstance(texts, list) else [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        self.raw = b"".join(values)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
        self.n = len(values)
        self.points = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))  # code points before each byte

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def stretches(self, allowed: np.ndarray, cue: np.ndarray, least: int) -> list[tuple[int, int]]:
        """Maximal stretches of allowed bytes within a document that hold at least so many cue bytes."""
        cues = np.flatnonzero(cue)
        if not len(cues):
            return []
        breaks = np.flatnonzero(~allowed[self.data])
        i = np.searchsorted(breaks, cues)
        start = np.where(i > 0, breaks[i - 1] + 1 if len(breaks) else 0, 0)
        end = np.where(i < len(breaks), breaks[np.minimum(i, len(breaks) - 1)] if len(breaks) else 0, len(self.data))
        d = self.doc(cues)
        pairs, count = np.unique(np.column_stack((np.maximum(start, self.offsets[d]), np.minimum(end, self.offsets[d + 1]))), axis=0, return_counts=True)
        return pairs[count >= least].tolist()

    def matches(self) -> list[tuple[int, int, int]]:
        """(start byte, end byte, kind's number) of all matches of the patterns, tested or not."""
        found = []
        done = -1
        signs = np.flatnonzero(self.data == 64)
        breaks = np.flatnonzero(~_MAIL_BYTE[self.data] | (self.data == 64))
        before = np.searchsorted(breaks, signs)
        first = np.where(before > 0, breaks[before - 1] + 1 if len(breaks) else 0, 0)
        d = self.doc(signs)
        for at, a, end in zip(signs.tolist(), np.maximum(first, self.offsets[d]).tolist(), self.offsets[d + 1].tolist(), strict=True):
            a = max(a, done)
            if a < at and (m := DOMAIN.match(self.raw, at + 1, end)):
                done = m.end()
                found.append((a, done, 0))
        for a, b in self.stretches(_NUMBER_BYTE, _DIGIT[self.data], 4):
            part = self.raw[a:b]
            for m in CHAIN.finditer(part):
                groups = m[0].split(b".")
                start = a + m.start()
                for i in range(0, len(groups) - 3, 4):
                    end = start + sum(map(len, groups[i : i + 4])) + 3
                    found.append((start, end, 1))
                    start = end + 1
            for k, pattern in ((2, CARD), (3, PHONE)):
                found += [(a + m.start(), a + m.end(), k) for m in pattern.finditer(part)]
        return found

    def base(self) -> list[tuple[int, int, int]]:
        """Those matches that stand their kind's test: the base spans."""
        return [m for m in self.matches() if valid(KINDS[m[2]], self.raw[m[0] : m[1]])]

    def windows(self) -> np.ndarray:
        """First byte of each window that could hold an added span, on a grid of STEP within each document."""
        cues = [np.flatnonzero(_DIGIT[self.data] | (self.data == 64))]
        words = np.array([m.start() for m in _AT_WORD.finditer(self.raw)], np.int64)
        if len(words):
            dots = np.array([m.start() for m in _DOT.finditer(self.raw)] + [len(self.data) + WINDOW], np.int64)
            cues.append(words[dots[np.searchsorted(dots, words)] - words < WINDOW])
        cues = np.concatenate(cues)
        if not len(cues):
            return cues
        first = self.offsets[self.doc(cues)]
        k = (cues - first) // STEP
        starts = np.concatenate((first + k * STEP, (first + (k - 1) * STEP)[k > 0]))
        return np.unique(starts)

    def classes(self, starts: np.ndarray) -> np.ndarray:
        """Character classes of windows, windows by characters; 0 beyond the document."""
        at = starts[:, None] + np.arange(WINDOW)
        end = self.offsets[self.doc(starts) + 1][:, None]
        return np.where(at < end, _CLASS[self.data[np.minimum(at, len(self.data) - 1)]], 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters p: input table, recurrent weights and output weights of both directions, CRF transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p["x" + d] = r.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            p["x" + d][:, HIDDEN : 2 * HIDDEN] += 0.5  # forget gates start open
            p["h" + d] = r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p["o" + d] = r.normal(0, 0.3, (HIDDEN, TAGS))
        p["bias"], p["trans"], p["first"] = np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (characters, windows, HIDDEN) of one direction; x is characters by windows."""
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape, HIDDEN), np.float32)
        table, weights = self.p["x" + d], self.p["h" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + h @ weights
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = c
            c = f * c + i * g
            s = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, i, f, o, g, s))
            h = o * s
            out[t] = h
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self.run(x, "f") @ self.p["of"] + self.run(x, "b") @ self.p["ob"] + self.p["bias"]

    def decode(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of windows (windows by characters) under emissions and transitions, and each tag's posterior."""
        x = classes.T
        e = self.emissions(x)
        score, back = self.p["first"] + e[0], np.empty((len(x), x.shape[1], TAGS), np.int8)
        for t in range(1, len(x)):
            paths = score[:, :, None] + self.p["trans"]
            back[t] = paths.argmax(axis=1)
            score = np.take_along_axis(paths, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        tags = np.empty(x.shape, np.int8)
        tags[-1] = score.argmax(axis=1)
        rows = np.arange(x.shape[1])
        for t in range(len(x) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        alpha, beta, log_z = self.sums(e.astype(np.float64))
        chosen = np.take_along_axis(alpha + beta, tags[:, :, None].astype(np.int64), axis=2)[:, :, 0]
        return tags.T, np.exp(chosen - log_z).T

    def sums(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of the CRF for emissions (characters, windows, TAGS), and the log of all paths' weight."""
        trans = self.p["trans"].astype(np.float64)

        def total(a: np.ndarray, axis: int) -> np.ndarray:
            m = a.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))

        alpha, beta = np.empty(e.shape), np.zeros(e.shape)
        alpha[0] = self.p["first"] + e[0]
        for t in range(1, len(e)):
            alpha[t] = total(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        for t in range(len(e) - 2, -1, -1):
            beta[t] = total(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        return alpha, beta, total(alpha[-1], 1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the CRF's negative log-likelihood, per window; x and y are characters by windows."""
        p, n = self.p, x.shape[1]
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.run(x, d, kept[d]) for d in "fb"}
        e = (states["f"] @ p["of"] + states["b"] @ p["ob"] + p["bias"]).astype(np.float64)
        trans = p["trans"].astype(np.float64)

        alpha, beta, log_z = self.sums(e)
        gold = np.eye(TAGS)[y]
        de = (np.exp(alpha + beta - log_z[:, None]) - gold) / n
        pair = np.exp(alpha[:-1, :, :, None] + trans + (e[1:] + beta[1:])[:, :, None, :] - log_z[None, :, None, None]).sum(axis=(0, 1))
        g = {"trans": (pair - np.einsum("tni,tnj->ij", gold[:-1], gold[1:])) / n, "first": de[0].sum(axis=0), "bias": de.sum(axis=(0, 1))}
        de = de.astype(np.float32)
        for d in "fb":
            g["o" + d] = np.einsum("tnh,tnk->hk", states[d], de)
            dh_all = de @ p["o" + d].T
            dx, dw = np.zeros_like(p["x" + d]), np.zeros_like(p["h" + d])
            dh_next, dc_next = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h, before, i, f, o, gg, s in reversed(kept[d]):
                dh = dh_all[t] + dh_next
                dc = dc_next + dh * o * (1 - s * s)
                dz = np.concatenate((dc * gg * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - gg * gg)), axis=1)
                dx += np.eye(CLASSES, dtype=np.float32)[x[t]].T @ dz
                dw += h.T @ dz
                dh_next, dc_next = dz @ p["h" + d].T, dc * f
            g["x" + d], g["h" + d] = dx, dw
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
        """Adam with clipped gradients and a rate that falls to nothing; x and y are windows by characters."""
        r, m, v = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        order = np.concatenate([r.permutation(len(x)) for _ in range(-(-steps * batch // len(x)))])
        for step in range(1, steps + 1):
            part = order[(step - 1) * batch : step * batch]
            for k, g in self.gradients(x[part].T, y[part].T).items():
                g = g * min(1.0, 5 / (np.linalg.norm(g) + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                change = (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
                self.p[k] = (self.p[k] - rate * (1 - (step - 1) / steps) * change).astype(np.float32)
        return self


def labelled(batch: Batch, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a batch and their tags from spans; where kinds overlap, the one listed first holds."""
    tags = np.zeros(len(batch.data), np.int8)
    for a, b, k in sorted(spans, key=lambda s: -s[2]):
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    starts = batch.windows()
    x = batch.classes(starts)
    return x, np.where(x > 0, tags[np.minimum(starts[:, None] + np.arange(WINDOW), max(len(tags) - 1, 0))] if len(tags) else 0, 0)


def variant(text: bytes, seed: int = 0) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text with its base spans varied, and where they then are; what overlaps an earlier span goes with it."""
    r = random.Random(zlib.crc32(text) + seed)
    out, spans, done, size = [], [], 0, 0
    for a, b, k in sorted(Batch([text]).base()):
        if a < done:
            continue
        new = varied(KINDS[k], text[a:b], r)
        size += a - done
        spans.append((size, size + len(new), k))
        size += len(new)
        out += [text[done:a], new]
        done = b
    return b"".join([*out, text[done:]]), spans


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> Network:
    """Train on windows of at most `sample` documents with a digit or at sign, taken by a hash, and at most `windows` of them.

    Half of them come from the texts as they are, half from their variants. Rows that agree in id and text count once.
    """
    cues = docs.where(F.col(text).rlike("[0-9@]")).select(F.xxhash64(key, text).alias("_order"), F.col(text).alias("_text"))
    last = cues.select("_order").orderBy("_order").limit(sample).agg(F.max("_order")).first()[0]  # hashes alone meet in one task
    rows = cues.where(F.col("_order") <= last).dropDuplicates(["_order"]) if last is not None else cues.limit(0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bytes = lambda rows: pa.array([a.astype(np.int8).tobytes() for a in rows], pa.binary())
        for batch in batches:
            for part in pieces(batch, "_text"):
                own = Batch(part.column("_text"))
                made = [variant(own.raw[a:b]) for a, b in zip(own.offsets.tolist(), own.offsets[1:].tolist(), strict=False)]
                other = Batch([t for t, _ in made])
                moved = [(a + o, b + o, k) for o, (_, found) in zip(other.offsets.tolist(), made, strict=False) for a, b, k in found]
                for kind, (x, y) in enumerate((labelled(own, own.base()), labelled(other, moved))):
                    yield pa.RecordBatch.from_arrays([as_bytes(x), as_bytes(y), pa.array(np.full(len(x), kind, np.int32))], ["x", "y", "kind"])

    taken = []
    made = rows.select("_text").mapInArrow(cut, "x binary, y binary, kind int")
    for kind in (0, 1):  # two bytes a character
        taken += made.where(F.col("kind") == kind).orderBy(F.xxhash64("x", "y"), "x", "y").limit(windows // 2).collect()
    network = Network.fresh()
    if taken:
        x, y = (np.stack([np.frombuffer(bytes(r[c]), np.int8) for r in taken]).astype(np.int64) for c in ("x", "y"))
        network.fit(x, y)
    return network


def added(batch: Batch, network: Network, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the network is certain of, that have their kind's parts and touch no base span."""
    starts = batch.windows()
    if not len(starts):
        return []
    tags = np.zeros(len(batch.data) + 1, np.int8)
    sure = np.zeros(len(batch.data) + 1, np.float32)
    quarter = (WINDOW - STEP) // 2
    for a in range(0, len(starts), BATCH):
        part = starts[a : a + BATCH]
        found, posterior = network.decode(batch.classes(part))
        d = batch.doc(part)
        # the middle of each window, and the text's first and last quarter windows
        low = np.where(part == batch.offsets[d], 0, quarter)
        at = part[:, None] + np.arange(WINDOW)
        last = part + STEP >= batch.offsets[d + 1]
        own = (np.arange(WINDOW) >= low[:, None]) & ((np.arange(WINDOW) < WINDOW - quarter) | last[:, None]) & (at < batch.offsets[d + 1][:, None])
        tags[at[own]], sure[at[own]] = found[own], posterior[own]
    taken = np.zeros(len(batch.data) + 1, bool)
    for a, b, _ in base:
        taken[a:b] = True
    inside = tags > 0
    kind = (tags - 1) // 2
    at = np.flatnonzero(inside)
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (kind[at[1:]] != kind[at[:-1]]) | (tags[at[1:]] % 2 == 1) | (batch.doc(at[1:]) != batch.doc(at[:-1]))
    first = np.flatnonzero(new)
    out = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        a, b, k = int(at[i]), int(at[j - 1]) + 1, int(kind[at[i]])
        if not taken[a:b].any() and sure[a:b].mean() >= CERTAIN and plausible(KINDS[k], batch.raw[a:b]):
            out.append((a, b, k))
    return out


def find(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs plus pii_base and pii_spans: arrays of (kind, start, end) in code points, end exclusive, by kind as listed and start.

    pii_spans holds the base spans and those that the network adds. Null and empty texts have none. Whole texts are
    read; equal texts get equal spans. An empty table gives no rows; columns of docs with a result's name are replaced.
    """
    docs = docs.drop("pii_base", "pii_spans")
    span = "array<struct<kind: string, start: long, end: long>>"
    schema = plus(docs, f"pii_base {span}, pii_spans {span}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for part in pieces(record, text):
                batch = Batch(part.column(text))
                base = batch.base()
                columns = []
                for spans in (base, base + added(batch, network, base)):
                    by_doc: list[list] = [[] for _ in range(batch.n)]
                    if spans:
                        a = np.array(spans)
                        d = batch.doc(a[:, 0])
                        first = batch.points[batch.offsets[d]]
                        rows = np.column_stack((d, a[:, 2], batch.points[a[:, 0]] - first, batch.points[a[:, 1]] - first))
                        for i, k, s, e in rows[np.lexsort(rows.T[::-1])].tolist():
                            by_doc[i].append({"kind": KINDS[k], "start": s, "end": e})
                    columns.append(pa.array(by_doc, kind))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], schema.names)

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets, as in <email>; overlapping spans become one."""
    schema, names = docs.schema, docs.columns
    at, plain = names.index(text), [f"c{i}" for i in range(len(names))]
    found = find(docs.toDF(*plain), network, plain[at])  # so that no column has a result's name

    def one(value: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return value
        out, done, end = [], 0, -1
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
            if s["start"] < end:
                end = max(end, s["end"])
                done = end
                continue
            out += [value[done : s["start"]], f"<{s['kind']}>"]
            done = end = s["end"]
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, plain[at]):
                texts = [one(v, s) for v, s in zip(part.column(plain[at]).to_pylist(), part.column("pii_spans").to_pylist(), strict=True)]
                columns = [part.column(c) for c in plain]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names)

    return found.drop("pii_base").mapInArrow(run, schema)

"""Shared folder, written intermediate tables and the vectorised word scanner.

The scanner works on the UTF-8 bytes of an Arrow batch: the separators of a
word, ``[\\x20\\x09-\\x0D]``, are single bytes that occur in no other character,
so that words, word hashes and word runs come from a few numpy passes without a
Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from labelscan.sources.scratch import scratch, stored

__all__ = ["Words", "bucketed", "mixed", "pieces", "plus", "runs", "scratch", "stored", "table"]

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that the scanner takes at a time (one document at least).
CHUNK = 1 << 20


#: Buckets that Spark allows a table, and bytes that one is to hold.
MOST_BUCKETS, BUCKET_BYTES = 100_000, 128 << 20


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write df into the shared folder in hash buckets of a column: joins on that column then leave these rows in place.

    There are as many buckets as the session has shuffle partitions, or more if those would hold more than BUCKET_BYTES
    by Spark's estimate of df's size. The catalogue's entry goes with clear_scratch().
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    label = path.rpartition("/")[2]
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), MOST_BUCKETS)
    writer = df.repartition(n, column).write.bucketBy(n, column).format("parquet").option("compression", "zstd")
    writer.option("path", path).saveAsTable(label)
    return spark.table(label)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plus(df: DataFrame, ddl: str) -> StructType:
    """df's schema and further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            full = np.full(size, np.uint64(base))
            full[0] = 1
            _powers[name] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def runs(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of values[i:i+n] for each i; empty if there are fewer than n."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    up, down = powers(len(values))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)))
    return mixed((sums[n:] - sums[:-n]) * down[: len(values) - n + 1])


class Words:
    """Words of some documents: start and end bytes, document, and 64-bit hash, as flat arrays."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True, separators: np.ndarray = SPACES):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        self.n = len(texts)
        if lower:
            self.data = LOWER[self.data]
        size = len(self.data)
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        inside = ~separators[self.data]
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0] = after[-1] = True
            before[1:] = ~inside[:-1] | edge[1:-1]
            after[:-1] = ~inside[1:] | edge[1:-1]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # word index at which each document begins
        self.counts = np.diff(self.first)
        self._sums: np.ndarray | None = None
        self.hashes = self.spans(self.starts, self.ends) if hashes else None

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[self.data] * up[:-1], dtype=np.uint64)))
        return mixed((self._sums[ends] - self._sums[starts]) * down[starts])

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte, by document."""
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return np.diff(total[self.offsets])

    @property
    def docs(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def words(self, doc: int) -> list[bytes]:
        """The document's words as bytes."""
        return self.data[self.offsets[doc] : self.offsets[doc + 1]].tobytes().translate(_TO_SPACE).split()


#: bytes.split() without arguments would also split at other control bytes only in str; for bytes it splits at exactly these six.
_TO_SPACE = bytes(32 if SPACES[i] else i for i in range(256))


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose text is at most limit bytes, or one row."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lengths) - lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)

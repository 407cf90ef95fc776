"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document gets the set of its word shingles, as 64-bit hashes, an id of the whole set and a signature of HASHES
   minima. Documents with equal sets form a class, and all that follows compares classes.
2. BANDS bands of the signature give buckets. A pair of the wanted similarity s shares a bucket but with the probability
   (1 - s**r)**BANDS, r being the rows of a band: 5e-8 at 0.8. In the first PIVOT_BANDS of them the smallest class of a
   bucket is the pivot of the others, and every class is paired with the pivot that it meets most often and with its
   smallest one, never all with all.
3. Signatures of a pair are compared in batches. Under a uniform prior, m of n equal minima give the posterior
   probability that the similarity is at least s; once it falls below MISS the pair is dropped. Survivors are verified
   on their full sets.
4. Verified links give components. Where a bucket of any band then still holds several components, the members outside
   its largest one are compared, in blocks, with all members of other components. This is exact for what the pivots
   leave open: no link between components that any bucket shows is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscan.llm.components import components
from labelscan.llm.shared import Words, mixed, pieces, runs, stored

SHINGLE, SIMILARITY = 5, 80  # words, per cent
HASHES, BANDS, PIVOT_BANDS, STEP, MISS = 128, 32, 8, 16, 1e-9
#: Members of a block in the last comparison, and ids up to which they are broadcast.
BLOCK, BROADCAST_IDS = 1024, 2000

_r = np.random.default_rng(20240301)
_SEEDS = _r.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _r.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_equal(similarity: float = SIMILARITY / 100, miss: float = MISS) -> list[int]:
    """After each batch, the least number of equal minima at which the posterior of `similarity` or more is not below `miss`."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # P(S >= s | m) = 1 - I_s(m + 1, n - m + 1) = P(Binomial(n + 1, s) <= m)
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append(m)
    return out


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: of the whole sequence if it is shorter, none without words."""
    words = Words(texts, lower=True)
    grams = runs(words.hashes, shingle)
    for a, n in zip(words.first.tolist(), words.counts.tolist(), strict=False):
        yield np.unique(grams[a : a + n - shingle + 1]) if n >= shingle else runs(words.hashes[a : a + n], n) if n else np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**32 - 1, np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        out = np.minimum(out, (((part[None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def fixed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column whose values have one length."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width) if len(column) else np.empty((0, width), kind)


def plausible(a: np.ndarray, b: np.ndarray, bars: list[int]) -> np.ndarray:
    """Rows of two signature tables that survive the sequential test."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, bar in enumerate(bars):
        part = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (a[alive, part] == b[alive, part]).sum(axis=1)
        keep = equal >= bar
        alive, equal = alive[keep], equal[keep]
    return alive


def _sketch(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                rows = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s).tobytes()) if len(s) else (0, None, None) for s in shingle_sets(part.column("text"), shingle)]
                n, ids, signatures = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n", "set_id", "signature"])

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, signature binary")


def _keys(signatures: np.ndarray, first: int = BANDS) -> np.ndarray:
    """Bucket of each of the first bands of each signature."""
    rows = HASHES // BANDS
    s = signatures.astype(np.uint64).reshape(-1, BANDS, rows)[:, :first]
    key = np.broadcast_to(np.arange(first, dtype=np.uint64), s.shape[:2])
    for k in range(rows):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return key.view(np.int64)


def _bands(classes: DataFrame, first: int = BANDS) -> DataFrame:
    """(rep, component, bucket) for the first bands of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _keys(fixed(batch.column("signature"), np.uint32, HASHES), first)
            reps, components = (np.repeat(batch.column(c).to_numpy(), first) for c in ("rep", "component"))
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(components), pa.array(key.ravel())], ["rep", "component", "bucket"])

    return classes.select("rep", "component", "signature").mapInArrow(run, "rep long, component long, bucket long")


def _pivots(bands: DataFrame) -> DataFrame:
    """Pairs (a, b): each class b with the pivot that it meets most often and with its smallest one."""
    low = bands.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("_high")).where("a < _high").select("bucket", "a")
    met = bands.join(low, "bucket").where("a < rep").groupBy("rep", "a").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("rep").agg(F.min("a").alias("least"), F.max_by("a", F.struct("n", -F.col("a"))).alias("most"))
    return best.select(F.explode(F.array_distinct(F.array("least", "most"))).alias("a"), F.col("rep").alias("b"))


def _survivors(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) whose signatures survive the sequential test."""
    bars = least_equal(similarity / 100)
    own = classes.select("rep", "signature")
    # b first: it is in two pairs at most, so that no pivot's signature is shuffled for each of its partners
    both = pairs.join(own.toDF("b", "sb"), "b").join(own.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = plausible(fixed(batch.column("sa"), np.uint32, HASHES), fixed(batch.column("sb"), np.uint32, HASHES), bars)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return both.mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(rep, shingles) of the documents in ids (doc_id). Their texts are shuffled once, by id, at every size but a handful of ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), shingle)], pa.binary())], ["rep", "shingles"])

    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(sets, "rep long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """100 * intersection >= similarity * union, of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < similarity * len(y):
        return False
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * shared >= similarity * (len(x) + len(y) - shared)


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Those pairs that are similar on their full sets."""
    own = _sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), shingle)
    both = pairs.join(own.toDF("b", "sb"), "b").join(own.toDF("a", "sa"), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("sa"), batch.column("sb"), strict=True)
            keep = [k for k, (x, y) in enumerate(rows) if similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity)]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, "a long, b long").distinct()


def _plausible_tiles(classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs of different components that share a bucket and survive the sequential test: a row (tile, reps, pairs) for each pair of blocks.

    Members of a bucket outside its largest component meet all members of other components, block by block. A pair is
    looked at in the first bucket that it shares only.
    """
    bands = _bands(classes)
    several = bands.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    members = stored(bands.join(several, "bucket"), "mixed")
    parts = members.groupBy("bucket", "component").count()
    split = parts.groupBy("bucket").agg(F.max(F.struct("count", "component"))["component"].alias("main"), F.sum("count").alias("size"))
    rows = members.join(split, "bucket").join(classes.select("rep", "signature"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1))))
    fields = ("rep", "component", "signature")
    gathered = lambda df, side: df.groupBy("bucket", F.col("block").alias(side + "block")).agg(F.collect_list(F.struct(*fields)).alias("x"), F.first("main").alias(side + "main")).select("bucket", side + "block", side + "main", *[F.col(f"x.{c}").alias(side + c) for c in fields])
    tiles = gathered(rows.where("component <> main"), "a_").join(gathered(rows, "b_"), "bucket").withColumn("tile", F.struct("bucket", "a_block", "b_block"))
    bars, width = least_equal(similarity / 100), HASHES // BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, reps, pairs = [], [], []
            for t in range(batch.num_rows):
                side = {n: batch.column(n)[t].values for n in ("a_rep", "a_component", "a_signature", "b_rep", "b_component", "b_signature")}
                ra, ca, rb, cb = (side[n].to_numpy() for n in ("a_rep", "a_component", "b_rep", "b_component"))
                sa, sb = (fixed(side[n], np.uint32, HASHES) for n in ("a_signature", "b_signature"))
                keys, bucket, main, found = _keys(sb), batch.column("bucket")[t].as_py(), batch.column("a_main")[t].as_py(), []
                for i in range(len(ra)):
                    other = np.flatnonzero((cb != ca[i]) & ((cb == main) | (ra[i] < rb)))  # a pair outside the largest component once
                    equal = (sb[other].reshape(-1, BANDS, width) == sa[i].reshape(BANDS, width)).all(axis=2)
                    other = other[equal.any(axis=1) & (keys[other, equal.argmax(axis=1)] == bucket)]
                    hit = other[plausible(np.broadcast_to(sa[i], (len(other), HASHES)), sb[other], bars)]
                    found.append(np.column_stack((np.minimum(ra[i], rb[hit]), np.maximum(ra[i], rb[hit]))))
                both = np.unique(np.concatenate(found), axis=0)
                if len(both):
                    keep.append(t)
                    reps.append(np.unique(both))
                    pairs.append(np.ascontiguousarray(both).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("tile").take(pa.array(keep, pa.int64())), pa.array(reps, pa.list_(pa.int64())), pa.array(pairs, pa.binary())], ["tile", "reps", "pairs"])

    return tiles.mapInArrow(run, "tile struct<bucket: long, a_block: long, b_block: long>, reps array<long>, pairs binary")


def _across(classes: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Verified links between different components that share a bucket: sets go to the tiles, so that only links leave a task."""
    tiles = stored(_plausible_tiles(classes, similarity), "tiles")
    members = tiles.select("tile", F.explode("reps").alias("rep"))
    own = _sets(docs, members.select(F.col("rep").alias("doc_id")).distinct(), shingle)
    sets = members.join(own, "rep").groupBy("tile").agg(F.collect_list(F.struct("rep", "shingles")).alias("x")).select("tile", F.col("x.rep").alias("rep"), F.col("x.shingles").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for t in range(batch.num_rows):
                by: dict[int, list[np.ndarray]] = {}
                for rep, value in zip(batch.column("rep")[t].values.to_pylist(), batch.column("shingles")[t].values, strict=True):
                    by.setdefault(rep, []).append(np.frombuffer(value.as_py(), np.uint64))
                for a, b in np.frombuffer(batch.column("pairs")[t].as_py(), np.int64).reshape(-1, 2).tolist():
                    if any(similar(x, y, similarity) for x in by.get(a, []) for y in by.get(b, [])):
                        found.add((a, b))
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    return tiles.select("tile", "pairs").join(sets, "tile").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Words are lower-cased (A to Z). Documents with fewer words than a shingle have the whole sequence as their one
    shingle. Null, empty and blank texts have no shingles, are linked with nothing and are kept. component_id is the
    smallest id that links reach, and a row is kept if that is its own. Rows without an id are linked with nothing, as
    links need ids: their component_id is null and they are kept. Rows that repeat an id are one document: their
    components are joined if their texts differ. An empty table gives no rows; further columns are ignored.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketch = stored(_sketch(docs, shingle), "sketch")
    docs = docs.where("doc_id is not null")
    classes = stored(sketch.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature")), "classes")
    pairs = _pivots(_bands(classes.withColumn("component", F.col("rep")), PIVOT_BANDS))
    links = stored(_verified(stored(_survivors(pairs, classes, similarity), "survivors"), docs, shingle, similarity), "verified")
    labels = components(links)
    joined = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = stored(_across(stored(joined, "classes"), docs, shingle, similarity), "across")
    if not more.isEmpty():
        labels = components(links.union(more))
    found = classes.select("set_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.select("doc_id", "n", "set_id").join(found, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))

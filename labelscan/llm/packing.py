"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Pieces are dealt into groups of bounded size, each of which is packed by itself: descending sizes, bins ordered by
residual, and for each piece a successor search from its size upwards that goes on until the tightest bin without a
conflict is found. A bin carries a bitmap of the duplicate clusters in it and one bitmap of sources for each piece that
it may still take of a source; a set bit in the last of them is a conflict.

Groups are dealt by a hash, or along a given order: then a group is a stretch of it, and bins are numbered along it.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.llm.shared import stored

#: Words of a bin, pieces of a source in a bin at least, and pieces of a group on average.
CAPACITY, PER_SOURCE, GROUP_PIECES = 4096, 4, 8192


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t\n\u000b\f\r]"), "")


def cluster_of(text: Column) -> Column:
    """Texts that agree but for case and white space."""
    return F.xxhash64(words(F.lower(text)))


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int | None = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; sizes are 1 to capacity, in the order in which they are to be placed.

    per_source is the number of pieces of one source that a bin may hold, None for any number.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    least = min(sizes, default=0)
    depth = per_source or 1
    free: list[tuple[int, int]] = []  # residual, bin
    planes: list[list[int]] = []  # of a bin: plane k has a source's bit once k + 1 of its pieces are in
    held: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit[source] if per_source else 0, cluster_bit[cluster]
        at = bisect_left(free, (size, -1))
        while at < len(free) and (planes[free[at][1]][-1] & s or held[free[at][1]] & c):
            at += 1
        if at < len(free):
            residual, b = free.pop(at)
        else:
            residual, b = capacity, len(held)
            planes.append([0] * depth)
            held.append(0)
        out.append((b, capacity - residual))
        plane = next(k for k in range(depth) if not planes[b][k] & s)
        planes[b][plane] |= s
        held[b] |= c
        if residual - size >= least:
            insort(free, (residual - size, b))
    return out


def pack(
    docs: DataFrame,
    size: Column | None = None,
    cluster: Column | None = None,
    order: Column | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    capacity: int = CAPACITY,
    per_source: int | None = None,
) -> DataFrame:
    """One row for each piece of a document: doc_id, piece, start, n_words, n_bin, bin_offset, cluster, source and order.

    `n_bin` numbers the bins (not without gaps), `start` is the piece's first word, `bin_offset` its place in the bin.
    A document of more than `capacity` words fills bins of its own with its first pieces; the rest is packed with the
    others. No bin holds two pieces of one cluster (by default texts that agree but for case and white space) or more
    than per_source pieces of one source; null sources count as one source. By default that is PER_SOURCE, or twice a
    source's even part of the pieces that fill a bin if that is more, and there is no such limit with a single source.
    Documents without words come back with a null bin. Repeated rows are pieces of their own, of one cluster. Equal
    sizes are placed by id (as text), and rows that agree in all of this are interchangeable. An empty table gives no
    rows.

    order is a column from 0 to 1 of even density (positions in training): bins are packed within stretches of it and
    numbered along it. Null, or without it, pieces are dealt by a hash.
    """
    n_words = F.coalesce(size, F.lit(0)) if size is not None else F.size(words(F.col(text)))
    group = cluster if cluster is not None else cluster_of(F.col(text))
    place = order if order is not None else F.lit(None)
    columns = [F.col(key).cast("string").alias("doc_id"), F.col(source).alias("source"), n_words.cast("long").alias("_n")]
    rows = stored(docs.select(*columns, group.alias("cluster"), place.cast("double").alias("order")), "sizes")
    n_pieces = F.greatest(F.ceil(F.col("_n") / capacity), F.lit(1))
    count = rows.agg(F.sum(n_pieces).alias("pieces"), F.sum("_n").alias("words"), F.countDistinct(F.coalesce("source", F.lit(""))).alias("sources")).first()
    pieces, sources = count["pieces"] or 0, count["sources"]
    if per_source is None and sources > 1:
        per_bin = pieces * capacity / max(count["words"], 1)
        per_source = max(PER_SOURCE, int(-(-2 * per_bin // sources)))
    groups = max(1, -(-pieces // GROUP_PIECES))
    # the number of the row in the written table keeps equal rows apart
    cut = rows.withColumn("_row", F.monotonically_increasing_id())
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))))
    start = F.col("piece").cast("long") * capacity
    cut = cut.withColumn("start", start).withColumn("n_words", F.least(F.col("_n") - start, F.lit(capacity)))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "_n", "cluster", "_row"), F.lit(groups))
    along = F.when(F.col("order").isNotNull(), F.least(F.floor(F.col("order") * groups), F.lit(groups - 1)))  # least() skips nulls
    cut = cut.withColumn("_group", F.when(F.col("n_words") > 0, F.coalesce(along, dealt)).otherwise(dealt))
    schema = "doc_id string, piece int, start long, n_words long, n_bin long, bin_offset long, cluster long, source string, order double"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_words", "doc_id", "piece", "cluster", "order"], ascending=[False, True, True, True, True], kind="stable")
        full = frame[frame.n_words > 0]
        number = int(frame["_group"].iloc[0])
        names = full.source.where(full.source.notna(), None).tolist()
        placed = best_fit(full.n_words.tolist(), names, full.cluster.tolist(), capacity, per_source)
        found = pd.DataFrame(placed, columns=["n_bin", "bin_offset"], index=full.index, dtype="int64")
        found["n_bin"] += number << 32
        return frame.join(found.astype("Int64"))[[x.split()[0] for x in schema.split(", ")]]

    # the id goes through pandas as text: a column of numbers with a null would become floats there
    packed = cut.drop("_n", "_row").groupBy("_group").applyInPandas(one, schema)
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))

"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule w(t) = 1 + slope * (2t - 1) over training time t in [0, 1]; its integral
t + slope * (t*t - t) is the share of the source's demand that is due by t. A document takes its place in its source's
token sequence (in the order of a digest of its id and text), and the inverse of the integral turns that place into a
position in training. Documents are then range-sorted by position. Only DataFrame functions are used.

The running token sums never put a source into one task: each source's sequence is cut into buckets by digest, the
bucket sums are added up, and only rows of one bucket share a window. Buckets and rows of a bucket both grow with the
square root of the table, up to BUCKET_ROWS.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.llm.shared import stored

#: Documents of one bucket of the running sum at most, on average.
BUCKET_ROWS = 20_000
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST = 2


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \t\n\u000b\f\r]"), "")), F.lit(0)).cast("long")


def digest(key: Column, text: Column, copy: Column | None = None) -> Column:
    """What orders a source's sequence: of id and text, so that rows without an id or of one id lie apart."""
    parts = [F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))]
    return F.md5(F.concat_ws(":", *([copy.cast("string")] if copy is not None else []), *parts))


def _weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) plus weight: weights repeat over the sources by code point, null last."""
    by_name = W.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    place = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """Target of each source: (source, source_size) -> (source, source_size, weight, target).

    The total of share_percent of all sizes is dealt out by weight; a target stops at `most` times its source's size
    and the excess is dealt out again by weight. With the sources in the order of most * size / weight those that stop
    come first, so two running sums give the same result as repeating the deal. Sources without words have the target 0.
    One row for each source is all that meets in one task.
    """
    places = _weights(sizes, weights)
    order = (F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    all_rows = W.partitionBy()
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rest = F.sum("source_size").over(all_rows) * (share_percent / 100) - most * earlier("source_size")
    leveled = places.withColumn("level", rest / (F.sum("weight").over(all_rows) - earlier("weight")))
    leveled = leveled.withColumn("full", most * F.col("source_size") <= F.col("level") * F.col("weight"))
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    open_level = F.min(F.when(~F.col("full"), F.struct(*keys, F.col("level").alias("level")))).over(all_rows)["level"]
    filled = (most * F.col("source_size")).cast("double")
    target = F.when(F.col("full"), filled).otherwise(F.col("open_level") * F.col("weight"))
    return leveled.withColumn("open_level", open_level).select("source", "source_size", "weight", target.alias("target"))


def _places(rows: DataFrame, narrow: DataFrame, plan: DataFrame, source: str, ties: tuple) -> DataFrame:
    """rows (with _digest and size) plus plan's columns and _middle: the middle of each row's place in its source, 0 to 1.

    narrow has the rows' source, size and _digest; plan is (source, source_size, ...). _middle is null in sources
    without words.
    """
    n = narrow.count()
    buckets = max(1, -(-n // max(1, min(BUCKET_ROWS, isqrt(n)))))
    bucket = (F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long")
    per_bucket = narrow.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_size"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.select("source", "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    own = [F.col(f"p.{c}") for c in plan.columns if c != "source"]
    starts = starts.alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
    starts = starts.select(F.col("b.source").alias("_source"), F.col("b._bucket").alias("_at"), "_start", *own)
    placed = rows.withColumn("_bucket", bucket)
    placed = placed.join(starts, placed[source].eqNullSafe(F.col("_source")) & (placed["_bucket"] == F.col("_at")))
    inside = W.partitionBy("_source", "_bucket").orderBy("_digest", *ties).rowsBetween(W.unboundedPreceding, -1)
    place = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    return placed.withColumn("_middle", place / F.nullif(F.col("source_size"), F.lit(0)))


def _slope(weight: Column) -> Column:
    """Light sources come early, heavy ones late."""
    return (weight - 2) / F.lit(2.0)


def _position(slope: Column, place: Column) -> Column:
    """t + slope * (t*t - t) = place, solved for t."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * place)
    return F.when(slope == 0, place).otherwise((root - (1 - slope)) / (2 * F.nullif(slope, F.lit(0.0))))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """docs plus size, source_size, target, copies, taken, slope and position, range-sorted by position.

    A document is taken whole: floor(target / source_size) times, and once more if the middle of its place in its
    source's sequence lies before the remaining fraction; a source's taken words thus miss its target by at most half
    a document. Documents without words are in no copy (taken 0) and come last (position 1), also in sources that have
    none at all. Null sources form one source, which comes last. Rows that repeat an id are separate documents; ties in
    the digest (the same id and text) are ordered by id and size, which is the same for them. An empty table gives no
    rows. Columns of docs that have a result's name are replaced.
    """
    base = docs.drop("size", "source_size", "target", "copies", "taken", "slope", "position", "weight")
    measures = {"size": word_count(F.col(text)), "_digest": digest(F.col(key), F.col(text))}
    narrow = stored(base.select(F.col(source).alias("source"), *[c.alias(n) for n, c in measures.items()]), "sizes")
    plan = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_percent, most)
    placed = _places(base.withColumns(measures), narrow, plan, source, (F.col(key), F.col("size")))
    ratio = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    once_more = (F.col("_middle") < ratio - F.floor(ratio)).cast("int")
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.floor(ratio) + once_more).cast("long")
    position = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_position(F.col("slope"), F.col("_middle")))
    out = placed.withColumn("slope", _slope(F.col("weight"))).withColumn("copies", copies)
    out = out.withColumn("taken", F.col("copies") * F.col("size")).withColumn("position", position)
    out = out.repartitionByRange("position", F.col(key), "_digest").sortWithinPartitions("position", key)
    return out.select(*base.columns, "size", "source_size", "target", "copies", "taken", "slope", "position")


def schedule(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """rows of a mixture (source, size, digest and others) plus position in training.

    Every row has a place of its own in its source's sequence, so that the copies of a document come at different
    times if their digests differ. Rows without words come last (position 1). Columns named position are replaced.
    """
    rows = rows.drop("position").withColumn("_digest", F.col("digest"))
    plan = _weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    placed = _places(rows, rows.select("source", "size", "_digest"), plan, "source", (F.col("size"),))
    position = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_position(_slope(F.col("weight")), F.col("_middle")))
    return placed.withColumn("position", position).select(*[c for c in rows.columns if c != "_digest"], "position")

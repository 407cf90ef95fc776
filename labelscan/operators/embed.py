"""Similarity candidates over given vectors: phrases (code, pos, phrase, vector) and terms (allergen, term, vector)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.operators.evaluate import micro_metrics
from labelscan.operators.match import drop_excluded, drop_negated, exclusion_rules, negation_rules, substring_hits

#: Numbers of a group of term vectors, rows of a part of the phrases, and rows of it that are multiplied at once.
BLOCK, PART, ROWS = 4_000_000, 1 << 18, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def term_vectors(terms: DataFrame, vectors: DataFrame) -> DataFrame:
    return terms.where(F.length("term") >= 3).join(vectors, "vec_id").select("allergen", "term", "vector")


def best_per_allergen(phrases: DataFrame, terms: DataFrame, bar: float = -1.0) -> DataFrame:
    """(code, pos, phrase, allergen, term, similarity): for each phrase the nearest term of each allergen, the first in order on a tie.

    A block matrix join: phrases are dealt into parts of some PART rows, terms into groups of some BLOCK numbers; a task
    gets one part and one group and multiplies them. Terms are copied to as many places as there are parts and phrases to
    as many as there are groups, most often one; the best of several groups is taken at the end, for each row of its own.
    Vectors that are null or hold nulls take no part; those of another length meet nothing.
    """
    spark = phrases.sparkSession
    size = F.size("vector")
    usable = lambda df: df.where(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    rows = usable(phrases.select(F.col("code").cast("string"), F.col("pos").cast("long"), F.col("phrase").cast("string"), "vector")).withColumn("_dim", size)
    terms = usable(terms.select("allergen", "term", "vector")).withColumn("_dim", size)
    numbers = terms.agg(F.sum("_dim")).first()[0] or 0
    groups = max(1, -(-numbers // BLOCK))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-phrases.count() // PART))
    own = F.monotonically_increasing_id()
    left = rows.withColumn("_row", own).withColumn("_part", F.pmod("_row", F.lit(parts)).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = terms.withColumn("_group", F.pmod(F.xxhash64("allergen", "term"), F.lit(groups)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    key = ["_part", "_group", "_dim"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(bar), "_row long, code string, pos long, phrase string, allergen string, term string, similarity double")
    if groups > 1:
        first = F.min_by(F.struct("code", "pos", "phrase", "term", "similarity"), F.struct(-F.col("similarity"), F.col("term"))).alias("b")
        found = found.groupBy("_row", "allergen").agg(first).select("allergen", "b.*")
    return found.select("code", "pos", "phrase", "allergen", "term", "similarity")


def _matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = [np.asarray(c.flatten(), float) for c in vectors.chunks]
    return np.concatenate(chunks or [np.empty(0)]).reshape(-1, dim)


def _tile(bar: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The product of a part of the phrases and a group of terms: the best term of each allergen."""
    names = ["_row", "code", "pos", "phrase"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows and (dim := left.column("_dim")[0].as_py()):
            right = right.sort_by([("allergen", "ascending"), ("term", "ascending")])
            matrix, terms, allergens = _matrix(right.column("vector"), dim), right.column("term").combine_chunks(), right.column("allergen").to_pylist()
            starts = [i for i, a in enumerate(allergens) if not i or a != allergens[i - 1]]
            for a in range(0, left.num_rows, ROWS):
                part = left.slice(a, ROWS)
                similarity = np.round(_matrix(part.column("vector"), dim) @ matrix.T, 9)
                for x, z in zip(starts, [*starts[1:], len(allergens)], strict=True):
                    at = similarity[:, x:z].argmax(axis=1)  # the first of equal ones
                    best = similarity[np.arange(len(at)), x + at]
                    keep = np.flatnonzero(best >= bar)
                    columns = [part.column(c).take(pa.array(keep)) for c in names]
                    out.append(pa.table([*columns, pa.array([allergens[x]] * len(keep), pa.string()), terms.take(pa.array(x + at[keep])), pa.array(best[keep])], [*names, "allergen", "term", "similarity"]))
        if out:
            return pa.concat_tables(out)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
        return pa.table([pa.array([], k) for k in kinds], [*names, "allergen", "term", "similarity"])

    return run


def gated_candidates(best: DataFrame, rule_hits: DataFrame, texts: DataFrame, bar: float) -> DataFrame:
    """(code, allergen, term, pos): allergens that the rules have not found in the code; the first phrase wins.

    texts is (code, text), the normalised section of each code: what it negates or excludes is no candidate, as with an exact match.
    """
    new = best.where(F.col("similarity") >= bar).join(rule_hits.select("code", "allergen").distinct(), ["code", "allergen"], "left_anti")
    new = new.join(texts.select("code", "text"), "code", "left").withColumn("text", F.coalesce("text", F.lit("")))
    new = drop_excluded(drop_negated(new, negation_rules(best.sparkSession)), exclusion_rules(best.sparkSession))
    return new.groupBy("code", "allergen").agg(F.min_by(F.struct("term", "pos"), F.struct("pos", "term")).alias("f")).select("code", "allergen", "f.*")


def threshold_sweep(best: DataFrame, sets: DataFrame, bars: list[float]) -> DataFrame:
    """Micro metrics of rules plus candidates at each threshold; sets is (code, ref, pred). Similarities are computed once."""
    gained = best.groupBy("code", "allergen").agg(F.max("similarity").alias("s")).groupBy("code").agg(F.collect_list(F.struct("allergen", "s")).alias("g"))
    wide = sets.join(gained, "code", "left").withColumn("bar", F.explode(F.array(*map(F.lit, bars))))
    extra = F.transform(F.filter(F.coalesce("g", F.array().cast("array<struct<allergen:string,s:double>>")), lambda x: x["s"] >= F.col("bar")), lambda x: x["allergen"])
    return micro_metrics(wide.withColumn("pred", F.array_union("pred", extra)), "ref", "pred", ("bar",))


def pick_threshold(sweep: DataFrame, baseline: dict[str, float], tolerance: float = 0.005) -> DataFrame:
    """(bar, gain) of the threshold with the largest sum of F1, the smallest on a tie.

    sweep is (bar, section, f1); a threshold is out if the F1 of any section falls below its baseline by more than the
    tolerance. No row if all are.
    """
    before = F.coalesce(*[F.when(F.col("section") == s, F.lit(f1)) for s, f1 in baseline.items()])
    each = sweep.withColumn("_gain", F.col("f1") - before)
    sums = each.groupBy("bar").agg(F.min("_gain").alias("_least"), F.round(F.sum("_gain"), 9).alias("gain"))
    fine = sums.where(F.col("_least") >= -tolerance)
    best = fine.agg(F.min_by(F.struct("bar", "gain"), F.struct(-F.col("gain"), F.col("bar"))).alias("b"))
    return best.where("b is not null").select("b.*")


def synonym_proposals(best: DataFrame, resolved: DataFrame | None = None, bar: float = 0.82, n: int = 15, examples: int = 5, vocab: DataFrame | None = None) -> DataFrame:
    """(allergen, phrase, term, similarity, products, codes, rank): new phrases near a term, the n best of each allergen: a report.

    resolved is (code, allergen), what the rules find already: such phrases are no proposals, nor are those that hold a
    term of vocab (term), even within a word. codes are the first `examples` by name.
    """
    near = best.where((F.col("similarity") >= bar) & (F.col("phrase") != F.col("term")))
    if resolved is not None:
        near = near.join(resolved.select("code", "allergen").distinct(), ["code", "allergen"], "left_anti")
    near = near if vocab is None else without_term(near, vocab)
    term = F.min_by("term", F.struct(-F.col("similarity"), F.col("term"))).alias("term")
    grouped = near.groupBy("allergen", "phrase").agg(term, F.max("similarity").alias("similarity"), F.countDistinct("code").alias("products"))
    order = W.partitionBy("allergen").orderBy(F.desc("similarity"), "phrase")
    top = grouped.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    codes = near.join(F.broadcast(top.select("allergen", "phrase")), ["allergen", "phrase"])  # n rows for each allergen
    place = W.partitionBy("allergen", "phrase").orderBy("code")
    codes = codes.select("allergen", "phrase", "code").distinct().withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= examples)
    listed = codes.groupBy("allergen", "phrase").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    return top.join(listed, ["allergen", "phrase"])


def without_term(phrases: DataFrame, vocab: DataFrame) -> DataFrame:
    """Phrases that hold no term of the vocabulary, even within a word; null ones hold none."""
    digest = F.md5("phrase")
    texts = phrases.select(digest.alias("_d"), F.col("phrase").alias("text")).where("text is not null").distinct()
    hits = substring_hits(texts, vocab.select("term").distinct(), ("_d",)).select("_d").distinct()
    return phrases.withColumn("_d", digest).join(hits, "_d", "left_anti").drop("_d")

"""Sampling: strata, quotas, top-ups. Order is a documented integer hash of the key, so that samples can be repeated anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.functions.text import any_phrase


def shuffle_key(key: Column, seed: int) -> Column:
    """A position for each integer key: multiplication modulo a prime, which SQL engines agree on."""
    return (key.cast("long") * F.lit(48271) + seed) % F.lit(2147483647)


def sampling_flags(df: DataFrame, context: list[str]) -> DataFrame:
    """df plus declared, trace, multi (two or more declared or, without any, traces) and context (one of the phrases)."""
    d, t = F.size("ref_declared"), F.size("ref_trace")
    return df.withColumn("has_declared", d > 0).withColumn("has_trace", t > 0).withColumn("multi", (d >= 2) | (t >= 2)).withColumn("context", any_phrase(F.col("norm"), context))


#: Strata in the order in which they take rows.
STRATA = ("multi", "trace_only", "declared", "context", "plain")


def stratum(df: DataFrame) -> Column:
    return F.when(F.col("multi"), "multi").when(F.col("has_trace") & ~F.col("has_declared"), "trace_only").when(F.col("has_declared"), "declared").when(F.col("context"), "context").otherwise("plain")


def quota_sample(df: DataFrame, quotas: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """Up to the quota (stratum, quota) of each stratum, in shuffled order; a row belongs to its first stratum only.

    Ranks are bounded by the largest quota first, a number in the plan, so that Spark keeps no more than so many rows of
    a stratum in each partition before they are shuffled.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0
    order = W.partitionBy("stratum").orderBy(shuffle_key(F.col(key), seed), key)
    ranked = df.withColumn("stratum", stratum(df)).join(F.broadcast(quotas), "stratum").withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= most) & (F.col("rank") <= F.col("quota")))


def top_up(sample: DataFrame, pool: DataFrame, total: int, seed: int, key: str = "id") -> DataFrame:
    """The sample's keys and, up to `total`, those of the pool's other rows in shuffled order."""
    short = max(0, total - sample.count())
    rest = pool.join(sample.select(key), key, "left_anti").orderBy(shuffle_key(F.col(key), seed), key).limit(short)
    return sample.select(key, F.lit("quota").alias("origin")).unionByName(rest.select(key, F.lit("top-up").alias("origin")))


def strata(df: DataFrame, languages: list[str]) -> DataFrame:
    """(id, stratum) of all strata that a row is in: its allergens, trace, control and language."""
    many = F.concat(F.transform("ref_declared", lambda a: F.concat(F.lit("allergen:"), a)), F.array(F.when(F.size("ref_trace") > 0, F.lit("trace")).when(F.size("ref_declared") == 0, F.lit("control")), F.when(F.col("lang").isin(languages), F.concat(F.lit("lang:"), F.col("lang")))))
    return df.select("id", F.explode(F.filter(many, lambda x: x.isNotNull())).alias("stratum"))


def attainable(members: DataFrame, targets: DataFrame) -> DataFrame:
    """(stratum, target, available, attainable)."""
    counts = members.groupBy("stratum").agg(F.countDistinct("id").alias("available"))
    return targets.join(counts, "stratum", "left").select("stratum", "target", F.coalesce("available", F.lit(0)).alias("available"), F.least("target", F.coalesce("available", F.lit(0))).alias("attainable"))


#: Strata in the order in which a greedy sample takes them, and rows that a language's takes at most.
KINDS, PER_LANGUAGE = ("allergen", "trace", "control", "lang"), 3


def _first(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first rows of each group, `most` at most, with their rank: a limit that Spark applies before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def greedy_sample(members: DataFrame, targets: DataFrame, limit: int, seed: int) -> DataFrame:
    """(id, stratum) chosen without replacement, `limit` rows if there are as many.

    Strata are taken by KINDS and then rarest first, a language's for PER_LANGUAGE rows at most; what is then missing is
    filled from all other members (stratum "fill"). As no more than `limit` rows are taken in all, a stratum's rows beyond
    its first `limit` never are: one ranking leaves so many of each stratum, and the choice among these few is made on
    the driver. limit is a sample's size; strata times limit rows come there.
    """
    place = [shuffle_key(F.col("id"), seed), F.col("id")]
    kind = F.coalesce(*[F.when(F.split("stratum", ":")[0] == k, F.lit(i)) for i, k in enumerate(KINDS)], F.lit(len(KINDS)))
    plan = attainable(members, targets).orderBy(kind, "available", "stratum").collect()  # a row for each stratum
    own = members.join(F.broadcast(targets.select("stratum")), "stratum").select("id", "stratum").distinct()
    every = members.select("id").distinct().withColumn("stratum", F.lit("fill"))
    pools: dict[str, list[int]] = {}
    for r in sorted(_first(own.unionByName(every), "stratum", place, limit).collect(), key=lambda r: r["rank"]):
        pools.setdefault(r["stratum"], []).append(r["id"])
    chosen: dict[int, str] = {}
    for stratum, n in [*((r["stratum"], min(r["attainable"], PER_LANGUAGE) if r["stratum"].startswith("lang:") else r["attainable"]) for r in plan), ("fill", limit)]:
        free = [i for i in pools.get(stratum, ()) if i not in chosen]
        chosen |= dict.fromkeys(free[: min(n, limit - len(chosen))], stratum)
    return members.sparkSession.createDataFrame(list(chosen.items()), f"id {members.schema['id'].dataType.simpleString()}, stratum string")


def language_quota(df: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """(id, language, rank): for each language its quota of rows by relevance, then shuffled order, without backfill.

    Languages take their turn by name. A row may stand for any of its languages, but is taken once. As with
    greedy_sample(), one ranking leaves as many rows of each language as all quotas together.
    """
    quotas = {r["language"]: r["target"] for r in targets.collect()}  # a row for each language
    order = [F.desc("relevance"), shuffle_key(F.col("id"), seed), F.col("id")]
    each = df.select("id", "relevance", F.explode(F.array_distinct("languages")).alias("language")).join(F.broadcast(targets.select("language")), "language")
    pools: dict[str, list[int]] = {}
    for r in sorted(_first(each, "language", order, sum(quotas.values())).collect(), key=lambda r: r["rank"]):
        pools.setdefault(r["language"], []).append(r["id"])
    taken, rows = set(), []
    for language in sorted(quotas):
        free = [i for i in dict.fromkeys(pools.get(language, ())) if i not in taken][: quotas[language]]
        taken.update(free)
        rows += [(i, language, k + 1) for k, i in enumerate(free)]
    return df.sparkSession.createDataFrame(rows, f"id {df.schema['id'].dataType.simpleString()}, language string, rank int")


def shortfall(targets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(language, target, taken, short) of a sample by language."""
    taken = chosen.groupBy("language").agg(F.count(F.lit(1)).alias("taken"))
    out = targets.join(taken, "language", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return out.select("language", "target", "taken", (F.col("target") - F.col("taken")).alias("short"))


def sampling_report(df: DataFrame, sample: DataFrame) -> DataFrame:
    """(stratum, available, sampled)."""
    a = df.groupBy("stratum").agg(F.count(F.lit(1)).alias("available"))
    b = sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("sampled"))
    return a.join(b, "stratum", "left").fillna(0, ["sampled"])


def best_image(images: Column, lang: Column) -> Column:
    """Language of the image to use, of a map from language: the product's own, then English, then the first by name."""
    keys = F.array_sort(F.map_keys(images))
    return F.when(F.array_contains(keys, lang), lang).when(F.array_contains(keys, "en"), F.lit("en")).otherwise(F.get(keys, F.lit(0)))

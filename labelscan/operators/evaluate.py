"""Aggregates, agreement metrics and error analysis; sets are sorted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def scores(df: DataFrame) -> DataFrame:
    """Precision, recall and F1 of tp, fp and fn."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))


def tag_counts(df: DataFrame, tags: str) -> DataFrame:
    """(tag, n) of an array column."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def top_tags(df: DataFrame, tags: str, n: int = 30) -> DataFrame:
    return tag_counts(df, tags).orderBy(F.desc("n"), "tag").limit(n)


def dataset_summary(df: DataFrame, tags: str) -> DataFrame:
    each = df.select(F.size(tags).alias("n"), F.col(tags).alias("t"))
    return each.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") > 0).alias("with_tags"), F.coalesce(F.sum("n"), F.lit(0)).alias("tags")).crossJoin(F.broadcast(df.select(F.explode(tags).alias("t")).agg(F.countDistinct("t").alias("distinct_tags"))))


def risk_distribution(df: DataFrame, levels: DataFrame, risk: str = "risk") -> DataFrame:
    """(level, n) with a row for levels that don't occur."""
    counts = df.groupBy(F.col(risk).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def language_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(log: DataFrame, status: str, good: str) -> DataFrame:
    """(status, n, share) and the share of good rows."""
    total = F.sum("n").over(W.partitionBy())
    counts = log.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("status", "n", (F.col("n") / total).alias("share"), (F.sum(F.when(F.col("status") == good, F.col("n")).otherwise(0)).over(W.partitionBy()) / total).alias("success_rate"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(allergen, one count for each array column): rows whose set names the allergen."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("s")) for c in columns]))).select("c", F.explode(F.array_distinct("s")).alias("allergen"))
    return long.groupBy("allergen").agg(*[F.count_if(F.col("c") == c).alias(c) for c in columns])


def micro_metrics(df: DataFrame, reference: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    size = lambda f, a, b: F.coalesce(F.sum(F.size(f(F.col(a), F.col(b)))), F.lit(0))
    sums = df.groupBy(*by).agg(size(F.array_intersect, reference, predicted).alias("tp"), size(F.array_except, predicted, reference).alias("fp"), size(F.array_except, reference, predicted).alias("fn"))
    return scores(sums)


def exact_agreement(df: DataFrame, reference: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(reference) == F.col(predicted)).cast("int")).alias("exact"))


def per_label_metrics(df: DataFrame, reference: str, predicted: str, by: tuple[str, ...] = (), labels: DataFrame | None = None) -> DataFrame:
    """tp, fp, fn, scores and support of each label that occurs, or of the given ones (allergen)."""
    kind = lambda a, f, b, name: F.transform(f(F.col(a), F.col(b)), lambda x: F.struct(x.alias("allergen"), F.lit(name).alias("k")))
    marks = F.concat(kind(reference, F.array_intersect, predicted, "tp"), kind(predicted, F.array_except, reference, "fp"), kind(reference, F.array_except, predicted, "fn"))
    counts = df.select(*by, F.inline(marks)).groupBy(*by, "allergen").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("tp", "fp", "fn")])
    if labels is not None:
        counts = labels.join(counts, "allergen", "left").fillna(0, ["tp", "fp", "fn"])
    return scores(counts).withColumn("support", F.col("tp") + F.col("fn"))


def error_class(reference: Column, predicted: Column) -> Column:
    return F.when(reference == predicted, "exact").when(F.size(predicted) == 0, "false_negative").when(F.size(reference) == 0, "false_positive").when(F.arrays_overlap(reference, predicted), "partial").otherwise("mismatch")


def set_diffs(df: DataFrame, reference: str, predicted: str) -> DataFrame:
    """df plus missed, extra and correct."""
    r, p = F.col(reference), F.col(predicted)
    return df.withColumn("missed", F.array_sort(F.array_except(r, p))).withColumn("extra", F.array_sort(F.array_except(p, r))).withColumn("correct", F.array_sort(F.array_intersect(r, p)))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(column).alias("allergen")).groupBy("allergen").agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, column: str) -> DataFrame:
    """(class, n, percent)."""
    counts = df.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100 * F.col("n") / F.sum("n").over(W.partitionBy()))


def two_section_status(df: DataFrame) -> Column:
    """mismatch if both sections err in both ways, false_positive or false_negative if one way, else exact."""
    extra = (F.size(F.array_except("pred_declared", "ref_declared")) > 0) | (F.size(F.array_except("pred_trace", "ref_trace")) > 0)
    missed = (F.size(F.array_except("ref_declared", "pred_declared")) > 0) | (F.size(F.array_except("ref_trace", "pred_trace")) > 0)
    return F.when(extra & missed, "mismatch").when(extra, "false_positive").when(missed, "false_negative").otherwise("exact")


def risk_accuracy(df: DataFrame, reference: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(reference) == F.col(predicted)).cast("int")).alias("accuracy"))


def by_method(found: DataFrame, reference: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(code, method, ref, pred): every label of reference (code, ref) under every method, with what found (code, method, allergens) has of it."""
    every = reference.select("code", "ref", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    pred = F.coalesce("allergens", F.array().cast("array<string>")).alias("pred")
    return every.join(found, ["code", "method"], "left").select("code", "method", "ref", pred)


def compare_methods(long: DataFrame) -> DataFrame:
    """Metrics of each label under each method, of (method, ref, pred) in one pass."""
    return per_label_metrics(long, "ref", "pred", ("method",))


def ablation_table(long: DataFrame) -> DataFrame:
    """(method, tp, fp, fn, precision, recall, f1, exact) of (method, ref, pred), in one pass."""
    size = lambda f, a, b: F.coalesce(F.sum(F.size(f(F.col(a), F.col(b)))), F.lit(0))
    exact = F.avg((F.col("ref") == F.col("pred")).cast("int")).alias("exact")
    return scores(long.groupBy("method").agg(size(F.array_intersect, "ref", "pred").alias("tp"), size(F.array_except, "pred", "ref").alias("fp"), size(F.array_except, "ref", "pred").alias("fn"), exact))


def disagreements(df: DataFrame, reference: str, predicted: str, limit: int = 50) -> DataFrame:
    """(code, metadata_only, text_only) where the sets differ, the first `limit` by code: a report."""
    both = df.select("code", F.array_sort(F.array_except(reference, predicted)).alias("metadata_only"), F.array_sort(F.array_except(predicted, reference)).alias("text_only"))
    return both.where((F.size("metadata_only") > 0) | (F.size("text_only") > 0)).orderBy("code").limit(limit)


def metric_deltas(df: DataFrame, reference: str, predicted: str, before: str, after: str) -> DataFrame:
    """Change of each metric from one version to another: one row for each (metric)."""
    m = micro_metrics(df.where(F.col("version").isin(before, after)), reference, predicted, ("version",))
    long = m.unpivot("version", ["precision", "recall", "f1"], "metric", "value")
    pick = lambda v: F.max(F.when(F.col("version") == v, F.col("value")))
    return long.groupBy("metric").agg(pick(before).alias("before"), pick(after).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def changed_predictions(before: DataFrame, after: DataFrame, reference: str, predicted: str) -> DataFrame:
    """(code, gained, lost, new_false_positives) of rows whose predictions changed."""
    a, b = before.select("code", F.col(predicted).alias("old")), after.select("code", F.col(predicted).alias("new"), F.col(reference).alias("ref"))
    both = a.join(b, "code").where("old <> new")
    gained = F.array_sort(F.array_except("new", "old"))
    return both.select("code", gained.alias("gained"), F.array_sort(F.array_except("old", "new")).alias("lost"), F.array_except(gained, F.col("ref")).alias("new_false_positives"))


def recovery(diagnosed: DataFrame, after: DataFrame, predicted: str) -> DataFrame:
    """(cause, n, recovered) of diagnosed misses (code, allergen, cause) under a later version."""
    hit = F.array_contains(F.coalesce(F.col(predicted), F.array().cast("array<string>")), F.col("allergen"))
    return diagnosed.join(after.select("code", predicted), "code", "left").groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("recovered"))


def resolved_fp(before: DataFrame, after: DataFrame, label: str, reference: str, predicted: str) -> DataFrame:
    """Counts of one label's false positives before and after, and of those that went."""
    has = lambda c: F.array_contains(c, label)
    both = before.select("code", has(predicted).alias("b"), has(reference).alias("r")).join(after.select("code", has(predicted).alias("a")), "code")
    return both.agg(F.count_if(F.expr("b and not r")).alias("fp_before"), F.count_if(F.expr("a and not r")).alias("fp_after"), F.count_if(F.expr("b and not r and not a")).alias("resolved"))


def regression(delta: Column) -> Column:
    return F.when(delta > 0, "IMPROVED").when(delta < 0, "WORSENED").otherwise("NO EFFECT")


CAUSES = ("no_text", "marker_and_term", "term_only", "marker_only", "no_evidence")


def fn_causes(missed: DataFrame, loose_terms: DataFrame, markers: list[str]) -> DataFrame:
    """missed (code, lang, text normalised, allergen) plus cause: whether the text holds, even within words, a marker or the allergen's term."""
    terms = F.broadcast(loose_terms.groupBy("allergen").agg(F.sort_array(F.collect_set("term")).alias("terms")))  # a row for each of nine allergens
    out = missed.join(terms, "allergen", "left")
    term = F.coalesce(F.exists("terms", lambda t: F.col("text").contains(t)), F.lit(False))
    marker = F.exists(F.array(*map(F.lit, markers)), lambda m: F.col("text").contains(m))
    cause = F.when(F.col("text") == "", "no_text").when(marker & term, "marker_and_term").when(term, "term_only").when(marker, "marker_only").otherwise("no_evidence")
    return out.withColumn("cause", cause).drop("terms")


def cause_summary(df: DataFrame, covered: tuple[str, ...] = ("en", "fr", "de", "es")) -> DataFrame:
    """(source, allergen, cause, n, percent, languages, uncovered): counts by source, by allergen and in all; null stands for all.

    percent is the cause's share of its source or allergen, uncovered the share of rows in languages other than covered.
    """
    outside = F.avg((~F.coalesce(F.col("lang").isin(*covered), F.lit(False))).cast("int")).alias("uncovered")
    sets = [[F.col(c) for c in names] for names in (("source", "cause"), ("source",), ("allergen", "cause"), ("allergen",), ("cause",), ())]
    counts = df.groupingSets(sets, "source", "allergen", "cause").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("languages"), outside)
    total = F.max("n").over(W.partitionBy("source", "allergen"))  # the row of all causes has all of them
    return counts.withColumn("percent", 100 * F.col("n") / total).select("source", "allergen", "cause", "n", "percent", "languages", "uncovered")


def examples(df: DataFrame, by: str, n: int = 4) -> DataFrame:
    """The first n rows of each class by code and allergen: a report."""
    order = W.partitionBy(by).orderBy("code", "allergen")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def fn_records(sources: list[tuple[str, DataFrame]], texts: DataFrame) -> DataFrame:
    """Misses of several evaluations (code, missed), with their texts, one row for each allergen."""
    parts = [df.select(F.lit(name).alias("source"), "code", F.explode("missed").alias("allergen")) for name, df in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(texts, "code", "left")

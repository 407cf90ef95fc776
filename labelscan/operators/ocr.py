"""OCR text tables: (image_id, pass, line_no, text, confidence)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from labelscan.functions.distance import distance
from labelscan.functions.text import normalize_heading, normalize_ocr, similarity
from labelscan.operators.evaluate import ablation_table
from labelscan.operators.match import analyze

#: Heading words by their normalised form (own list), and what begins the next section.
HEADINGS = ("ingredients", "ingredient", "zutaten", "ingredientes", "ingredienti")
STOPS = ("nutrition", "nahrwerte", "valeurs nutritionnelles", "storage", "informacion nutricional")
CAP = 1500


def best_pass(lines: DataFrame) -> DataFrame:
    """(image_id, pass, confidence) of the pass with the highest mean confidence, the first on a tie."""
    means = lines.groupBy("image_id", "pass").agg(F.avg("confidence").alias("confidence"))
    return means.groupBy("image_id").agg(F.min_by(F.struct("pass", "confidence"), F.struct(-F.col("confidence"), F.col("pass"))).alias("b")).select("image_id", "b.*")


def dedup_lines(lines: DataFrame) -> DataFrame:
    """The first of the lines of an image and pass that agree when normalised."""
    keyed = lines.withColumn("_key", normalize_heading(F.col("text")))
    order = W.partitionBy("image_id", "pass", "_key").orderBy("line_no")
    return keyed.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_key")


def image_text(lines: DataFrame) -> DataFrame:
    """(image_id, raw_text, confidence, n_lines); an image's lines are as many as one label has."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("raw_text"), F.avg("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_lines"))


def fuzzy_heading(line: Column, terms: tuple[str, ...] = HEADINGS) -> Column:
    """Whether some words of a short normalised line are nearly a heading: similarity of 0.8, or 0.85 for up to eight letters.

    A heading of several words is held against every group of as many words in a row. A line with more than one long
    word beside a heading's is no heading.
    """
    every = F.split(line, " ")
    words = F.filter(every, lambda w: F.length(w) >= 5)
    bar = lambda w: F.when(F.length(w) <= 8, 0.85).otherwise(0.8)
    found = F.lit(False)
    for n in sorted({len(t.split()) for t in terms}):
        own = F.array(*[F.lit(t) for t in terms if len(t.split()) == n])
        groups = words
        if n > 1:
            last = F.greatest(F.size(every) - n, F.lit(-1))
            starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
            groups = F.transform(starts, lambda i: F.array_join(F.slice(every, i, n), " "))  # noqa: B023
        near = F.exists(groups, lambda w: F.exists(own, lambda t: similarity(w, t) >= bar(w)))  # noqa: B023
        found = found | ((F.size(words) <= n + 1) & near)
    return found


def _heading(n: Column) -> Column:
    """Whether a normalised line is a heading; nearly right words are looked for only in short lines with a word of a fitting length."""
    plain = n.rlike(r"^(ingredient|ingredients|zutaten|ingredientes|ingredienti)\b") | n.contains("ingredien")
    lengths = [len(w) for t in HEADINGS for w in t.split()]
    most = max(len(t.split()) for t in HEADINGS) + 1
    fits = rf"(^| )\S{{{int(min(lengths) * 0.8)},{-(-max(lengths) * 5 // 4)}}}( |$)"
    words = F.size(F.filter(F.split(n, " "), lambda w: F.length(w) >= 5))
    return F.when(plain, True).when(n.rlike(fits) & (words <= most), fuzzy_heading(n)).otherwise(False)


def is_heading(line: Column) -> Column:
    return _heading(normalize_heading(line))


def heading_line(lines: DataFrame) -> DataFrame:
    """(image_id, heading) line number of each image's first heading."""
    return lines.where(is_heading(F.col("text"))).groupBy("image_id").agg(F.min("line_no").alias("heading"))


def ingredient_section(lines: DataFrame, stops: tuple[str, ...] = STOPS, cap: int = CAP) -> DataFrame:
    """(image_id, section, found): what follows the first heading's colon, and lines up to a stop line.

    Lines are taken while those before stay below the cap; without a stop line a section beyond the cap is not found.
    Lines are read once: all sums run along an image's lines in one order.
    """
    order = W.partitionBy("image_id").orderBy("line_no")
    upto, before = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, -1)
    n = F.col("_n")
    stop = F.lit(False)
    for s in stops:
        stop = stop | n.startswith(s)
    marked = lines.select("image_id", "line_no", "text", normalize_heading(F.col("text")).alias("_n"))
    marked = marked.select("image_id", "line_no", "text", _heading(n).alias("_h"), stop.alias("_stop"))
    run = marked.withColumn("_first", F.min(F.when(F.col("_h"), F.col("line_no"))).over(upto)).where("_first is not null")
    own = F.when(F.col("line_no") == F.col("_first"), F.regexp_replace("text", "^[^:]*:? *", "")).otherwise(F.col("text"))
    run = run.withColumn("text", own).withColumn("_stop", F.col("_stop") & (F.col("line_no") > F.col("_first")))
    run = run.withColumn("_ended", F.max(F.col("_stop").cast("int")).over(upto))
    run = run.where("_ended = 0 or _stop").withColumn("_before", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when((F.col("_ended") == 0) & (F.col("_before") < cap), F.struct("line_no", "text"))))
    total = F.sum(F.when(F.col("_ended") == 0, F.length("text") + 1).otherwise(0))
    out = run.groupBy("image_id").agg(parts.alias("x"), total.alias("total"), F.max(F.col("_ended")).alias("stopped"))
    section = F.trim(F.array_join(F.transform("x", lambda l: l["text"]), " "))
    return out.select("image_id", section.alias("section"), ((F.col("stopped") == 1) | (F.col("total") <= cap)).alias("found"))


def _measured(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """error_rates() of batches (by, _r, _p)."""
    for batch in batches:
        found = []
        for r, p in zip(batch.column("_r"), batch.column("_p"), strict=True):
            r, p = r.as_py(), p.as_py()  # a pair at a time: a batch's texts are not held a second time
            words = r.split(" ") if r else []
            found.append((distance(r, p) / len(r), distance(words, p.split(" ") if p else []) / len(words)) if r else (float(p != ""),) * 2)
        rates = [pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), *rates], [*by, "cer", "wer"])


def error_rates(texts: DataFrame, by: tuple[str, ...] = ("image_id", "lang")) -> DataFrame:
    """(by, cer, wer) of whole texts (by, reference, predicted): edits of characters and of words over the reference's.

    Each row is a text. Distances are exact whatever the length, worked out in batches of Arrow: the built-in one takes a
    time and memory that grow with the product of the lengths. Without a reference 0 if there is no prediction, else 1.
    """
    rows = texts.select(*by, normalize_ocr(F.col("reference")).alias("_r"), normalize_ocr(F.col("predicted")).alias("_p"))

    kinds = StructType([*(rows.schema[c] for c in by), StructField("cer", DoubleType()), StructField("wer", DoubleType())])
    return rows.mapInArrow(lambda batches: _measured(batches, by), kinds)


def judged(texts: DataFrame, vocab: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """texts, for each condition (name: column with its text) a row with condition, pred_declared, pred_trace and pred_risk, what the matcher finds in that text."""
    each = F.inline(F.array(*[F.struct(F.lit(k).alias("condition"), F.col(c).alias("_text")) for k, c in conditions.items()]))
    names = {"declared_allergens": "pred_declared", "trace_allergens": "pred_trace", "risk": "pred_risk"}
    kept = [c for c in texts.columns if c not in conditions.values()]
    return analyze(texts.select(*kept, each), vocab, text="_text").select(*kept, "condition", *[F.col(a).alias(b) for a, b in names.items()])


def ocr_vs_clean(rows: DataFrame) -> DataFrame:
    """(condition, target, tp, fp, fn, precision, recall, f1, exact) of judged() rows with ref_declared, ref_trace and ref_risk.

    The targets are the two sections and the risk, a set of one: its precision and recall are its accuracy.
    """
    kind = rows.schema["ref_declared"].dataType.simpleString()
    section = [F.struct(F.lit(s).alias("target"), F.col(f"ref_{s}").alias("ref"), F.col(f"pred_{s}").alias("pred")) for s in ("declared", "trace")]
    risks = F.struct(F.lit("risk").alias("target"), F.array("ref_risk").cast(kind).alias("ref"), F.array("pred_risk").cast(kind).alias("pred"))
    long = rows.select("condition", F.inline(F.array(*section, risks))).withColumn("method", F.struct("condition", "target"))
    return ablation_table(long).select("method.*", "tp", "fp", "fn", "precision", "recall", "f1", "exact")


def quality_by(df: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"))


def worst(df: DataFrame, metric: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(metric), "image_id").limit(n)


def error_origin(df: DataFrame, labels: DataFrame) -> DataFrame:
    """(section, allergen, ocr_fn, matcher_fn, ocr_fp, matcher_fp) of sets (section, ref, ocr, clean): an error that clean text has too is the matcher's."""
    each = F.array_distinct(F.concat("ref", "ocr", "clean"))
    long = df.select("section", "ref", "ocr", "clean", F.explode(each).alias("allergen"))
    r, o, c = (F.array_contains(x, F.col("allergen")) for x in ("ref", "ocr", "clean"))
    counts = long.groupBy("section", "allergen").agg(F.count_if(r & ~o & c).alias("ocr_fn"), F.count_if(r & ~o & ~c).alias("matcher_fn"), F.count_if(~r & o & ~c).alias("ocr_fp"), F.count_if(~r & o & c).alias("matcher_fp"))
    every = labels.withColumn("section", F.explode(F.array(F.lit("declared"), F.lit("trace"))))
    return every.join(counts, ["section", "allergen"], "left").fillna(0)


def sets_by_section(rows: DataFrame, key: str = "code") -> DataFrame:
    """(key, section, ref, ocr, clean) of judged() rows under the conditions "ocr" and "clean"."""
    pick = lambda s, k: F.first(F.when(F.col("condition") == k, F.col(f"pred_{s}")), ignorenulls=True).alias(k)
    parts = [rows.groupBy(key).agg(F.first(f"ref_{s}").alias("ref"), pick(s, "ocr"), pick(s, "clean")).withColumn("section", F.lit(s)) for s in ("declared", "trace")]
    return parts[0].unionByName(parts[1])


def extraction_failures(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("found", F.lit(False)))


def expansion(annotations: DataFrame, metadata: DataFrame) -> DataFrame:
    """Annotations of quality ok, with their metadata."""
    return annotations.where("quality = 'ok'").join(metadata, "code")

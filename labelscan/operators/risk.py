"""Risk, profiles and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.functions.tags import DISPLAY

LEVELS = ("SAFE", "CAUTION", "AVOID", "UNKNOWN")


def general_risk(declared: Column, trace: Column) -> Column:
    return F.when(F.size(declared) > 0, "AVOID").when(F.size(trace) > 0, "CAUTION").otherwise("SAFE")


def extraction_status(raw: Column, found: Column, section: Column) -> Column:
    """Why a label can't be judged: no_text, section_not_found or section_empty; ok if it can."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(blank(raw), "no_text").when(~F.coalesce(found, F.lit(False)), "section_not_found").when(blank(section), "section_empty").otherwise("ok")


def personal_risk(allergies: Column, declared: Column, trace: Column) -> Column:
    """AVOID or CAUTION if the profile meets a set; an empty profile gets the general risk.

    An accepted name that is never detected is in no set, so a profile of only such names is always SAFE.
    """
    mine = F.when(F.arrays_overlap(allergies, declared), "AVOID").when(F.arrays_overlap(allergies, trace), "CAUTION").otherwise("SAFE")
    return F.when(F.size(allergies) == 0, general_risk(declared, trace)).otherwise(mine)


def relevant(allergies: Column, found: Column) -> Column:
    """Sorted allergens of a set that concern the profile; all of them if it is empty."""
    return F.when(F.size(allergies) == 0, found).otherwise(F.array_sort(F.array_intersect(found, allergies)))


def display(ids: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return F.transform(ids, lambda a: F.coalesce(F.try_element_at(names, a), a))


def explain(matches: Column, section: str) -> Column:
    """A sentence for each piece of evidence."""
    end = "is listed as an ingredient" if section == "declared" else "is named in a precautionary statement"
    names = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    return F.transform(matches, lambda m: F.concat(F.coalesce(F.try_element_at(names, m["allergen"]), m["allergen"]), F.lit(f" {end}: '"), m["matched_term"], F.lit("'.")))


def response(analysis: DataFrame) -> DataFrame:
    """(code, response): the whole answer as JSON."""
    body = F.struct("code", "risk", "declared_allergens", "trace_allergens", display(F.col("declared_allergens")).alias("declared_names"), explain(F.col("declared_matches"), "declared").alias("declared_why"), explain(F.col("trace_matches"), "trace").alias("trace_why"))
    return analysis.select("code", F.to_json(body).alias("response"))


def verdict(personal: Column, general: Column) -> Column:
    return F.coalesce(personal, general, F.lit("UNKNOWN"))


def history_counts(scans: DataFrame, only: str | None = None) -> DataFrame:
    """Scans by verdict, and all of them as the row "all"."""
    rows = scans if only is None else scans.where(F.col("verdict") == only)
    return rows.rollup("verdict").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("verdict", F.lit("all")).alias("verdict"), "n")

"""Curation: deduplication, incremental ingest, upserts, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def present(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def backfill(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Missing columns are added, blank or null values replaced by the default."""
    for c, value in defaults.items():
        df = df.withColumn(c, F.coalesce(F.when(present(c), F.col(c)), F.lit(value)) if c in df.columns else F.lit(value))
    return df


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first; max_by-like partial sums would not keep whole rows apart, so this is a window."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def drop_unusable(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without rows in which all of these columns are null."""
    return df.dropna(how="all", subset=columns)


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null) in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_null")


def with_text(df: DataFrame, key: str = "code", text: str = "text") -> DataFrame:
    return df.where(present(key) & present(text))


def exclude_codes(df: DataFrame, codes: DataFrame, key: str = "code") -> DataFrame:
    """Without the rows whose key is in codes."""
    return df.join(codes.select(key).distinct(), key, "left_anti")


def ingest_new(existing: DataFrame, batch: DataFrame, limit: int, order: str, key: str = "code") -> DataFrame:
    """The first `limit` rows of the batch with unseen keys, each key once; an error if there are fewer."""
    new = exclude_codes(dedup_first(batch, key, order), existing, key).orderBy(order).limit(limit)
    found = new.count()
    if found < limit:
        raise ValueError(f"only {found} of {limit} new rows")
    return new


def merge_keep_existing(old: DataFrame, new: DataFrame, key: str = "code") -> DataFrame:
    """All old rows, and new ones with unseen keys."""
    return old.unionByName(exclude_codes(new, old, key))


def clean_keys(df: DataFrame, code: str = "code", lang: str = "lang") -> DataFrame:
    trimmed = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return df.withColumn(code, trimmed(code)).withColumn(lang, F.lower(trimmed(lang)))


def apply_annotations(base: DataFrame, edits: DataFrame, key: str = "code") -> DataFrame:
    """Latest edit of each key (at, status, transcription) over base; "complete" only with a transcription, else "pending"."""
    latest = edits.groupBy(key).agg(F.max_by(F.struct("status", "transcription"), "at").alias("e"))
    out = base.join(latest, key, "left")
    text = F.coalesce("e.transcription", F.lit(""))
    status = F.when((F.col("e.status") == "complete") & (F.trim(text) != ""), "complete").otherwise("pending")
    return out.select(*base.columns, status.alias("status"), text.alias("transcription"))


def completed_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "complete")

"""Filter, deduplicate, redact, mix and pack the documents.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of its input, the last one the packing.
run() writes what a stage returns as Parquet into the shared folder and reads it again for the next one.

Rows that repeat an id are kept or dropped together by the second stage, and rows without an id always stay in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.llm import pii, quality
from labelscan.llm.minhash import near_duplicates
from labelscan.llm.mixing import digest, mix, schedule, word_count
from labelscan.llm.packing import cluster_of, pack
from labelscan.llm.shared import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is at least 0.5; the classifier is fitted on the labelled ones among them."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates (five-word shingles, similarity of 0.8)."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of a document as the mix takes of it, none to two."""
    taken = mix(docs).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 4096 words without two copies of a text, packed along the curriculum: the bins' numbers follow training.

    Every row of the mixture, copies too, has a position of its own (`order`), which its source's schedule gives it.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "source", word_count(text).alias("size"), cluster_of(text).alias("cluster"), digest(F.col("doc_id"), text).alias("digest"))
    # equal rows are counted and numbered by their count, so that a rerun gives each the same place
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    placed = schedule(stored(counted.withColumn("digest", F.md5(F.concat_ws(":", "digest", "_copy"))).select(rows.columns), "mixture"))
    return pack(placed, size=F.col("size"), cluster=F.col("cluster"), order=F.col("position"))


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs

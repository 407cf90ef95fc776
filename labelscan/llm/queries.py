"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscan.llm import credentials, media, merkle, packing, pii, quality, token_files, toxicity
from labelscan.llm.minhash import near_duplicates
from labelscan.llm.mixing import mix
from labelscan.llm.neighbours import nearest
from labelscan.llm.ranked import rank
from labelscan.llm.shared import stored, table
from labelscan.llm.substring import deduplicate


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "best", F.size("passages").cast("long").alias("n_passages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, similarity=80)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, path, with_ids=False)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for c in ("pii_base", "pii_spans")}
    counts = [F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined["pii_base"], 256).alias("base_sha256"), joined["pii_spans"].alias("spans"), (F.size("pii_spans") - F.size("pii_base")).cast("long").alias("n_added"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(stored(media.store(table(spark, sf_dir, "documents").select("doc_id", "text")), "media"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("doc_id", "evidence", "host_mean", "path_mean", "quality", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",") for c in ("base", "spans")}
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in credentials.BASE]
    return found.select("doc_id", *counts, F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has an even crc32 are held against the manifest without their line feeds; rows without an id as they are."""
    docs = table(spark, sf_dir, "documents")
    leaf, tampered = (merkle.record(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], t) for t in (F.col("text"), F.replace("text", F.lit("\n"), F.lit(""))))
    touched = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    rows = docs.select("doc_id", "source", leaf.alias("digest"), F.when(touched, tampered).otherwise(leaf).alias("tampered"))
    found = merkle.manifest(rows, "source", ["doc_id"]).withColumn("folded_root", merkle.fold(F.col("tampered"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {
    "op1_substring": op1_substring,
    "op2_toxicity": op2_toxicity,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_token_files": op4_token_files,
    "op5_pii": op5_pii,
    "op6_neighbours": op6_neighbours,
    "op7_packing": op7_packing,
    "op8_mixing": op8_mixing,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
    "op11_ranked_search": op11_ranked_search,
    "op12_secrets": op12_secrets,
    "op13_merkle_manifest": op13_merkle_manifest,
}

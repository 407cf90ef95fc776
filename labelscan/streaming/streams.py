"""Streaming forms of the same operators. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelscan.operators.match import analyze
from labelscan.operators.risk import LEVELS

SEVERITY = {"UNKNOWN": 0, "SAFE": 1, "CAUTION": 2, "AVOID": 3}


def score_stream(labels: DataFrame, vocab: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Analyses each micro-batch of labels and appends it to a Parquet folder; no state between batches.

    A batch goes to a folder of its number, which a repeated batch overwrites, so that each label is there once.
    """

    def batch(df: DataFrame, number: int) -> None:
        analyze(df, vocab).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return labels.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest_stream(products: DataFrame, path: str, checkpoint: str, key: str = "code", delay: str = "1 hour", buckets: int = 1024, **trigger) -> StreamingQuery:
    """Appends products with keys that neither the stream's last hours nor the target holds; needs a timestamp column ts.

    State is kept for `delay` only; what comes again later is found in the ledger beside the target (path + "_keys"),
    which holds every key in folders by its hash. A batch reads the folders that its own keys fall in, and of these only
    files whose range of hashes it meets: a batch of few keys reads few of them, whatever the target's size. Products
    come first and their keys afterwards, both under the batch's number: a batch that is repeated writes both again.
    """
    spark = products.sparkSession
    fresh = products.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])
    ledger = f"{path}_keys"
    root = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())

    def batch(df: DataFrame, number: int) -> None:
        own = F.xxhash64(F.col(key))
        df = df.dropDuplicates([key]).withColumn("_hash", own).withColumn("bucket", F.pmod(own, F.lit(buckets)).cast("int"))
        df = df.persist()  # read four times; what an executor loses of it comes from the source again
        met = [f"{ledger}/bucket={r['bucket']}" for r in df.select("bucket").distinct().collect()]  # `buckets` rows at most
        known = [p for p in met if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))]
        if known:
            ends = df.agg(F.min("_hash").alias("a"), F.max("_hash").alias("z")).first()
            seen = spark.read.option("basePath", ledger).parquet(*known).where(F.col("_hash").between(ends["a"], ends["z"]) & (F.col("batch") != number))
            df = df.join(seen.select("bucket", "_hash", key), ["bucket", "_hash", key], "left_anti")
        df.drop("_hash", "bucket").write.mode("overwrite").parquet(f"{path}/batch={number}")
        keys = spark.read.parquet(f"{path}/batch={number}").select(key).withColumn("_hash", own).withColumn("bucket", F.pmod(own, F.lit(buckets)).cast("int")).withColumn("batch", F.lit(number))
        keys.repartition("bucket").sortWithinPartitions("bucket", "_hash").write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(ledger)
        df.unpersist()

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def verdict_windows(scans: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """(start, verdict, n) of tumbling or sliding windows over ts; the same call serves a stream and a table."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return scans.withWatermark("ts", delay).groupBy(span.alias("w"), "verdict").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "verdict", "n")


def severity(verdict: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), verdict), F.lit(0))


def scan_sessions(scans: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, worst): scans of a user with less than the gap between them."""
    grouped = scans.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    names = F.create_map(*[F.lit(x) for v in LEVELS for x in (SEVERITY[v], v)])
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max(severity(F.col("verdict"))).alias("s")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", names[F.col("s")].alias("worst"))

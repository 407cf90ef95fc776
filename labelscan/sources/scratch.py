"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder and table names that this library makes begin so.
PREFIX = "labelscan_"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; without one, a folder in the warehouse of a local session, and an error on a cluster."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/labelscan-scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{PREFIX}{name}_{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all tasks of a shuffle, however few its files are: for small rows that much is made of."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables of earlier jobs, catalogue entries too; returns how many. No job may be running."""
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith(PREFIX) and t.tableType != "TEMPORARY"]
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(folder) if files.exists(folder) else []
    return len(tables) + sum(bool(files.delete(f.getPath(), True)) for f in found if f.getPath().getName().startswith(PREFIX))

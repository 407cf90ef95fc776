"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from labelscan.functions.tags import ALLERGENS
from labelscan.functions.text import joined, normalize

PRODUCT = StructType([StructField(c, StringType()) for c in ("code", "product_name", "ingredients_text", "ingredients_tags", "allergens_tags", "traces_tags", "lang")])


def read_products(spark: SparkSession, path: str, fmt: str = "csv", schema: StructType = PRODUCT, encoding: str = "UTF-8") -> DataFrame:
    """Products, all strings; cells of a CSV file may hold quotes and line breaks.

    Bytes that the encoding doesn't have become U+FFFD, and a byte order mark is no part of the first cell.
    """
    reader = spark.read.schema(schema)
    if fmt != "csv":
        return reader.format(fmt).load(path)
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "encoding": encoding, "enforceSchema": True}
    found = reader.options(**options).csv(path)
    return found.withColumn(found.columns[0], F.regexp_replace(found.columns[0], "^\ufeff", ""))


def vocabulary(rows: DataFrame, raw: bool = False) -> DataFrame:
    """Distinct (allergen, term) of known groups from a column `value` of JSON objects; entries that are no lists are left out."""
    groups = rows.select(F.explode(F.from_json("value", "map<string,string>")).alias("allergen", "list"))
    terms = groups.where(F.col("allergen").isin(*ALLERGENS)).select("allergen", F.explode(F.from_json("list", "array<string>")).alias("term"))
    return terms.select("allergen", (F.col("term") if raw else normalize(F.col("term"))).alias("term")).where("term <> ''").distinct()


def read_vocabulary(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    return vocabulary(spark.read.text(path, wholetext=True), raw)


def flat(df: DataFrame) -> DataFrame:
    """Arrays of strings as delimited strings, other arrays and structs as JSON."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out.append(joined(F.array_sort(f.name)).alias(f.name) if kind == "array<string>" else F.to_json(f.name).alias(f.name) if kind.startswith(("array", "struct", "map")) else F.col(f.name))
    return df.select(*out)


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A cell of a CSV file keeps the white space at its ends, which Spark's writer would cut off."""
    writer = flat(df).write.mode("overwrite")
    options = {"header": True, "quoteAll": True, "escape": '"', "charToEscapeQuoteEscaping": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**options).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


POINTER = "_current"


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """The version that a published table's pointer names, and all there are, the oldest first."""
    folder, files = _folder(spark, path)
    pointer, _ = _folder(spark, f"{path}/{POINTER}")
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    current = None
    if files.exists(pointer):
        stream = files.open(pointer)
        current = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
    return current, sorted(n for n in found if n.startswith("version-"))


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The table that publish() has put there last; a reader keeps its version while others are published."""
    current, _ = versions(spark, path)
    if current is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(f"{path}/{current}")


def publish(df: DataFrame, path: str, expect: int, keep: int = 2) -> DataFrame:
    """Write a new version, check the number of rows, and only then point to it; an error leaves the pointer as it was.

    A table is a folder of versions and one small file that names the current one. That file is replaced in one step, so
    that at no moment is there no table, also where renaming a folder copies it. The `keep` last versions stay for those
    who read them. Publishers take turns; readers need not.
    """
    spark = df.sparkSession
    current, known = versions(spark, path)
    name = f"version-{len(known) and int(known[-1].split('-')[1]) + 1:010}-{uuid.uuid4().hex[:8]}"
    folder, files = _folder(spark, f"{path}/{name}")
    try:
        df.write.parquet(f"{path}/{name}")
        if (n := spark.read.schema(df.schema).parquet(f"{path}/{name}").count()) != expect:
            raise ValueError(f"{n} rows instead of {expect}")
        aside, _ = _folder(spark, f"{path}/.{name}")
        out = files.create(aside, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration())
        options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, _folder(spark, f"{path}/{POINTER}")[0], options)
    except BaseException:
        files.delete(folder, True)
        raise
    for old in [v for v in known if v != current][: max(0, len(known) + 1 - keep)]:
        files.delete(_folder(spark, f"{path}/{old}")[0], True)
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def summary_report(metrics: DataFrame) -> DataFrame:
    """A row of nested metrics as JSON (one column, report)."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("report"))

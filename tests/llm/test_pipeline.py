"""The pipeline's stages against plain Python on the smallest tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelscan.llm import oracles, queries
from tests.llm.test_operators import expected_components

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(q.split("_")[0][2:]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(oracles.ORACLES) <= set(queries.QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, SF)
    kept = good.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [r.doc_id for r in kept if labels.get(r.doc_id) == 0] + [i for i, q in labels.items() if q == 1 and i not in {r.doc_id for r in kept}]
    assert good.columns == docs.columns and len(wrong) <= 0.05 * len(labels)
    one = stages["near-duplicates"](spark, good, SF).collect()
    want = [i for i, _, _, keep in expected_components([(r.doc_id, r.text) for r in kept], 5) if keep]
    assert sorted(r.doc_id for r in one) == want
    clean = stages["personal data"](spark, good, SF)
    assert clean.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    assert clean.where("n_chars <> length(text)").count() == 0
    mixed = stages["mixing"](spark, clean, SF)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    bins = stages["packing"](spark, mixed, SF)
    assert bins.where("n_bin is not null").groupBy("n_bin").agg(F.sum("n_words").alias("n")).where("n > 4096").count() == 0
    assert bins.where("piece = 0").count() == mixed.count()


def test_packing_is_repeatable(spark):
    """However the rows lie in files, and with null ids, clashing columns and rows that repeat each other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("x")).withColumn("cluster", F.lit("y"))
    odd = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    docs = docs.union(odd).union(docs.where("doc_id % 3 = 0")).union(odd).cache()
    pack = dict(corpus_pipeline.STAGES)["packing"]
    once, again = (sorted(map(str, pack(spark, docs.repartition(n, "text", "doc_id"), SF).collect())) for n in (2, 7))
    assert once == again and docs.unpersist()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op1_substring", "op3_near_duplicates", "op8_mixing"])
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(oracles.ORACLES[name]).fetchall())
    got = queries.QUERIES[name](spark, SF)
    columns = [x[0] for x in con.execute(oracles.ORACLES[name]).description]
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want

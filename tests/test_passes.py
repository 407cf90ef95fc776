"""Steps that read, work out or join a thing once, where they did so several times."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscan import queries
from labelscan.functions import text
from labelscan.operators import learn, match, ocr


def test_instances_are_worked_out_once(spark):
    """The confidence model's steps read its instances from a table."""
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return i % 2

    rows = spark.range(60).select(F.col("id").cast("string").alias("code"), F.lit("milk").alias("allergen"), F.lit(0).alias("is_trace"), (F.col("id") / 60).alias("ocr_confidence"), F.lit(1).alias("extraction_found"), F.lit("en").alias("language"), F.lit(9).alias("text_length"), F.udf(counted, "int")("id").alias("correct"))
    assert learn.confidence_model(rows).count() > 0 and seen.value == 60


def test_a_text_is_spelled_out_once(spark):
    """What spells out the characters that stand for several stands in the plan once."""
    df = spark.createDataFrame([("Œufs ½ ﬁn",), ("œuf",), (None,)], "t string").select(text.normalize(F.col("t")).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1
    assert [r.n for r in df.collect()] == ["oeufs 1 2 fin", "oeuf", ""]


def test_raw_terms_meet_by_their_first_word(spark):
    labels = spark.createDataFrame([("1", "Soy -milk, x"), ("2", "soymilk"), ("3", "Noix DE coco"), ("4", "noixx de coco"), (None, None)], "code string, text string")
    vocab = spark.createDataFrame([("milk", "-milk"), ("tree_nut", "noix de coco"), ("egg", "%")], "allergen string, term string")
    assert {r.code: r.allergens for r in match.baseline_raw(labels, vocab).collect()} == {"1": ["milk"], "3": ["tree_nut"]}


@pytest.mark.parametrize("name", ["evl12_metric_deltas", "evl13_changed_predictions", "evl15_resolved_fp", "evl16_regression"])
def test_labels_are_judged_once_for_both_versions(spark, name):
    assert not [f for f in queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "documents.parquet" in f]


def test_both_sets_are_those_of_two_passes(spark):
    rows = [("1", "butter and peanut butter"), ("2", "no milk but whey"), ("3", "butter and butter whey"), ("4", "sugar"), ("5", "almond milk nuts eggs")]
    texts = spark.createDataFrame([(c, "declared", t) for c, t in rows], "code string, section string, text string")
    vocab = spark.createDataFrame([("milk", "butter"), ("milk", "milk"), ("milk", "whey"), ("tree_nut", "nuts"), ("tree_nut", "almond"), ("egg", "eggs"), ("peanut", "peanut")], "allergen string, term string")
    both = {r.code: r for r in match.detect_both(texts, vocab, ("code", "section")).collect()}
    ruled = {r.code: (r.allergens, r.matches) for r in match.detect(texts, vocab).collect()}
    plain = {r.code: r.allergens for r in match.detect(texts, vocab, negate=False, kinds=()).collect()}
    assert {c: r.unruled for c, r in both.items()} == plain and len(plain) == 4
    assert {c: (r.allergens, r.matches) for c, r in both.items() if r.allergens} == ruled and len(ruled) < 4


def test_raw_words_are_made_distinct_once(spark):
    plan = queries.QUERIES["src4_raw_vocabulary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1


def test_a_fit_has_a_task_a_core(spark, monkeypatch):
    """A step's gradients are as many as there are cores, however many chunks there are."""

    class Model:
        fit = staticmethod(lambda df: df.rdd.getNumPartitions())

    monkeypatch.setattr(learn, "clause_classifier", Model)
    assert learn.fitted(spark.range(100).repartition(40)) == spark.sparkContext.defaultParallelism


def test_texts_of_a_batch_are_not_held_twice():
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), *[pa.array(["x" * 9_999 + str(i) for i in range(500)])] * 2], ["image_id", "_r", "_p"])
    tracemalloc.start()
    found = [x for b in ocr._measured(iter([batch]), ("image_id",)) for x in b.column("cer").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [0.0] * 500 and peak < batch.nbytes / 5

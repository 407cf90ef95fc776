"""Steps whose work has to grow no faster than their input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from labelscan import queries
from labelscan.operators import learn, match, vocabulary
from tests.test_whole_job import distance


def test_near_duplicates_test_few_pairs(spark):
    """Terms that share their first half meet if they are near, not because of it."""
    terms = [("g", f"abcdef{i:04d}", 10) for i in range(600)]
    rows = spark.createDataFrame(terms, "allergen string, term string, n int")
    limit = lambda n: F.floor(0.15 * n + 1e-9).cast("int")
    near = vocabulary.near_duplicates(rows).count()
    assert near > 0 and vocabulary._met_by_deletions(rows, limit).count() < 4 * near < 600 * 599 / 2


@pytest.mark.parametrize("bar", [0.5, 0.7, 0.85])
def test_near_duplicates_of_all_lengths(spark, bar):
    pick = random.Random(7)
    base = ["".join(pick.choice("abé") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14, 15, 19, 20, 21, 27)]
    words = set(base)
    for w in base * 3:
        for _ in range(pick.randint(1, 4)):
            i = pick.randrange(len(w) + 1)
            w = pick.choice([w[:i] + pick.choice("abé") + w[i:], w[:i] + w[i + 1 :], w[:i] + pick.choice("abé") + w[i + 1 :]]) or "a"
        words.add(w)
    got = {(r.a, r.b) for r in vocabulary.near_duplicates(spark.createDataFrame([("g", w) for w in words], "allergen string, term string"), bar).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and 1 - distance(a, b) / max(len(a), len(b)) >= bar}


def test_ngrams_are_looked_up_by_chunks(spark, monkeypatch):
    """Weights in many chunks are those of the joined rows, and no n-gram comes to the driver."""

    def gathered(self):
        raise AssertionError("gathered")

    monkeypatch.setattr(type(spark.range(1)), "toArrow", gathered)
    monkeypatch.setattr(learn, "CHUNK", 40, raising=False)
    pick = random.Random(3)
    texts = [(i, " ".join(pick.choice(["a", "nuts", "nut", "éa", "milk", "𝒳y"]) for _ in range(pick.randint(0, 9)))) for i in range(50)]
    rows = spark.createDataFrame(texts, "row long, text string")
    features = learn.fit_features(rows)
    want = {(x.row, x.at): x.weight for x in learn.weights(rows, features).collect()}
    got = {(x.row, at): w for x in learn.entries(rows, features, name="x").collect() for at, w in zip(x.x["at"], x.x["weight"], strict=True)}
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)


def test_few_terms_are_looked_for_without_cutting_texts(spark, monkeypatch):
    texts = spark.createDataFrame([("1", "buttermilk and nuts"), ("1", "milky way"), (None, "coconuts"), ("2", "")], "code string, text string")
    vocab = spark.createDataFrame([("milk", "milk"), ("milk", "butter"), ("tree_nut", "nut"), ("fish", "and nuts"), ("egg", "")], "allergen string, term string")
    found = match.substring_hits(texts, vocab, ("code",))
    assert "Generate" not in found._jdf.queryExecution().toString()
    rows = lambda df: sorted((r.code or "", r.text, r.allergen, r.term) for r in df.collect())
    got = rows(found)
    monkeypatch.setattr(match, "FEW", 0)
    assert got == rows(match.substring_hits(texts, vocab, ("code",))) and len(got) == 6


@pytest.mark.parametrize("name", ["src3_union_vocab", "voc9_add_terms", "voc10_remove_term", "voc12_decisions"])
def test_the_corpus_is_read_once(spark, name):
    """What a query reads several times is the corpus vocabulary, and not the documents."""
    assert not [f for f in queries.QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "documents.parquet" in f]

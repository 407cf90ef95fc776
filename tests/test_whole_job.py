"""Queries against brute force on small tables, where a part of the input was once left out."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from labelscan import queries
from labelscan.functions import text
from labelscan.operators import embed, ocr
from labelscan.sources.fixtures import Inputs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_error_rates_of_whole_texts(spark, tmp_path):
    """Later lines, long lines, and what stands past 200 characters count."""
    words = "Milch, sucre azúcar und WHEAT flour! 50% (salt) ".split()
    texts = ["one line", "first line\nsecond line of five words\n\nlast", " ".join(words[i % 8] + str(i) for i in range(150)), "\n".join(" ".join(words[(i + j) % 8] for j in range(i)) for i in range(1, 25)), "", None, "a\nb\nc\nd", "!\n? x"]
    sf = save(spark, tmp_path, "documents", [(i, t, "en") for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string")
    cers, wers = ({r[0]: r[1] for r in queries.QUERIES[q](spark, sf).collect()} for q in ("ocr7_cer", "ocr8_wer"))
    norm = lambda s: re.sub(" +", " ", re.sub(r"[^\w %.,;:()'/+-]", " ", re.sub(r"\s+", " ", s.lower()))).strip()
    for i, t in enumerate(texts, 1):
        lines = [[w if (k + i) % 3 else w + "x" if i % 2 == 0 else None for k, w in enumerate(line.split(" "))] for line in (t or "").split("\n")]
        r, p = norm(t or ""), norm("\n".join(" ".join(w for w in line if w is not None) for line in lines))
        assert cers[i] == pytest.approx(distance(r, p) / len(r) if r else float(p != ""), abs=1e-6), t
        assert wers[i] == pytest.approx(distance(r.split(), p.split()) / len(r.split()) if r else float(p != ""), abs=1e-6), t


def test_error_rates_of_one_piece(spark):
    rows = [(1, "a b c d", "a x c"), (2, "", ""), (3, "", "x"), (4, "abc", ""), (5, "One two", "one TWO")]
    df = spark.createDataFrame(rows, "image_id int, reference string, predicted string")
    got = {r.image_id: (r.cer, r.wer) for r in ocr.error_rates(df, ("image_id",)).collect()}
    want = df.select("image_id", text.cer(F.col("reference"), F.col("predicted")).alias("c"), text.wer(F.col("reference"), F.col("predicted")).alias("w")).collect()
    assert got == {r.image_id: (r.c, r.w) for r in want}


def test_each_vector_is_a_phrase_or_a_term(spark, tmp_path):
    ids = [0, 10, 11, 2990, 2999, 3000, 3001, 5550]
    sf = save(spark, tmp_path, "embeddings", [(i, [1.0, 0.0], 1) for i in ids], "vec_id long, embedding array<float>, label int")
    terms, phrases = {0, 10, 2990}, {11, 2999, 3000, 3001, 5550}
    assert {(r.term, r.n) for r in queries.QUERIES["emb2_similarities"](spark, sf).collect()} == {(f"term {i}", len(phrases)) for i in terms}
    assert {r.pos for r in queries.QUERIES["emb3_best_per_allergen"](spark, sf).collect()} == phrases


def test_near_duplicates_of_rare_words(spark, tmp_path):
    words = ["hazelnut", "hazelnot", "hazelnuts", "chocolate", "chocolatte", "almond", "almonds", "alm", "zucker", "zuckre"]
    text_ = " ".join(words + words[:2] + words[3:4] * 5)
    sf = save(spark, tmp_path, "documents", [(1, text_, "en")], "doc_id long, text string, lang string")
    got = {(r.allergen, r.a, r.b) for r in queries.QUERIES["voc4_near_duplicates"](spark, sf).collect()}
    assert got == {("g" + a[0], a, b) for a in words for b in words if a < b and a[0] == b[0] and 1 - distance(a, b) / max(len(a), len(b)) >= 0.85}
    assert ("gh", "hazelnot", "hazelnut") in got


def test_candidates_are_negated_and_excluded(spark):
    best = spark.createDataFrame([("1", 0, "milk", "milk", 0.9), ("2", 0, "milk", "butter", 0.9), ("2", 1, "milk", "whey", 0.9), ("3", 0, "milk", "milk", 0.9), ("4", 0, "egg", "egg", 0.9), ("4", 1, "egg", "ei", 0.1)], "code string, pos long, allergen string, term string, similarity double")
    texts = spark.createDataFrame([("1", "oats no milk"), ("2", "cocoa butter"), ("3", "oats no eggs")], "code string, text string")
    hits = spark.createDataFrame([("9", "milk")], "code string, allergen string")
    got = {(r.code, r.allergen, r.term, r.pos) for r in embed.gated_candidates(best, hits, texts, 0.3).collect()}
    assert got == {("2", "milk", "whey", 1), ("3", "milk", "milk", 0), ("4", "egg", "egg", 0)}


def test_products_keep_white_space_and_nul(spark, tmp_path):
    """What stands at the ends of a cell, and a NUL beside quotes, comes back from a CSV file."""
    texts = ["space ", "line\n", "tab\t", "end\r", "both\r\n", "nul\0", 'a "quoted" \0 nul', '\0"', "é  ", "plain", '"', 'say "x", y\n"z" ']
    sf = save(spark, tmp_path, "documents", [(1 + 13 * i, t, "en", " src ") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    labels = Inputs(spark, sf).labels.select("code", "source", F.length("text"), F.md5("text"), "lang")
    assert sorted(map(tuple, queries.QUERIES["src1_read_products"](spark, sf).collect())) == sorted(map(tuple, labels.collect()))

"""Matching rules, metrics and windows on small tables, and every registered query against its SQL."""

from __future__ import annotations

import datetime
import itertools
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelscan import oracles, queries
from labelscan.functions import tags, text
from labelscan.functions.distance import distance
from labelscan.operators import curate, embed, evaluate, learn, match, ocr, risk, sample, stats, vocabulary
from labelscan.operators.order import numbered
from labelscan.sources import tables
from labelscan.sources.fixtures import Inputs
from labelscan.streaming import streams

SF = "/root/testdata/sf0.001"

CASES = [
    ("Roggen, whey, lecitina de soja", {"milk", "soy", "wheat_gluten"}, set()),  # terms of several languages
    ("water, hazelnut milk", {"tree_nut"}, set()),  # a plant drink is no milk, but its nut counts
    ("Semoule de riz, seigle. Peut contenir amandes, sésame", {"wheat_gluten"}, {"tree_nut", "sesame"}),
    ("galletas sin gluten", set(), set()),
    ("sucre, beurre de cacao", set(), set()),
    ("cashew butter, salt", {"tree_nut"}, set()),
    ("sorbet sans lait", set(), set()),
    ("biscuits. Produced in a factory that handles eggs", set(), {"egg"}),
    ("riso. Puo contenere thon", set(), {"fish"}),
    ("سكر. قد يحتوي soja", set(), {"soy"}),
    ("butter, peanut butter", {"peanut"}, set()),  # an exclusion holds for the whole section
    ("butter, peanut butter, whey", {"milk", "peanut"}, set()),  # another term still counts
    ("milk, no milk", set(), set()),  # so does a negation
    ("Zucker. Kann Haselnüsse, Milch enthalten.", set(), {"tree_nut", "milk"}),
    ("_soja_, Crème", {"soy", "milk"}, set()),
    ("milk. May contain milk", {"milk"}, {"milk"}),  # both sections may name it
    ("حليب، سكر. قد يحتوي على فول سوداني", {"milk"}, {"peanut"}),
    ("walnut butter, pistachio butter", {"tree_nut"}, set()),
    ("Kekse glutenfrei, Kakaobutter", set(), set()),
    ("bread without gluten, beurre de cacao, beurre", set(), set()),
    ("", set(), set()),
    (None, set(), set()),
]


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def test_cases(spark, inputs):
    labels = spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(CASES)], "code string, text string")
    for r in match.analyze(labels, inputs.vocab).collect():
        _, declared, trace = CASES[int(r.code)]
        assert set(r.declared_allergens) == declared and set(r.trace_allergens) == trace, r
        assert r.risk == ("AVOID" if declared else "CAUTION" if trace else "SAFE")


def test_no_python_in_the_core_plan(inputs):
    plan = inputs.analysis._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_normalize_is_idempotent(inputs):
    once = inputs.labels.select(text.normalize(F.col("text")).alias("a"))
    assert once.where(F.col("a") != text.normalize(F.col("a"))).count() == 0


def test_sections_hold_the_text(inputs):
    bare = lambda c: F.regexp_replace(c, r"\s", "")
    assert inputs.split.where(bare(F.concat("declared_text", "trace_text")) != bare(F.col("text"))).count() == 0


def test_micro_counts_are_sums_of_label_counts(inputs):
    micro = evaluate.micro_metrics(inputs.evaluated, "ref_declared", "pred_declared").first()
    each = evaluate.per_label_metrics(inputs.evaluated, "ref_declared", "pred_declared").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).first()
    assert (micro.tp, micro.fp, micro.fn) == (each.tp, each.fp, each.fn)


def test_raw_phrase(spark):
    rows = [("Milk, x", True), ("milky", False), ("a milk", True), ("buttermilk milk", True), ("milkmilk", False), ("_milk_", False), (None, False), ("(MILK)", True)]
    got = spark.createDataFrame(rows, "t string, want boolean").select("t", "want", text.raw_phrase_in(F.lit("milk"), F.col("t")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_profiles(spark):
    rows = [(None, [], []), (" ", [], []), ('["Milk", "gluten", "milk", "kiwi"]', ["milk", "wheat_gluten"], ["kiwi"]), ('"tree-nuts"', ["tree_nut"], []), ("soya, other", ["soy", "other"], []), ("[broken", [], [])]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string").select(tags.parse_profile(F.col("p")).alias("x")).collect()
    assert [(r.x.allergens, r.x.unsupported) for r in df] == [(a, b) for _, a, b in rows]


def test_personal_risk(spark):
    rows = [([], ["milk"], [], "AVOID"), (["egg"], ["milk"], [], "SAFE"), (["milk"], ["egg"], ["milk"], "CAUTION"), (["other"], ["milk"], ["egg"], "SAFE"), (["milk"], ["milk"], ["milk"], "AVOID")]
    df = spark.createDataFrame(rows, "a array<string>, d array<string>, t array<string>, want string")
    assert df.where(risk.personal_risk(F.col("a"), F.col("d"), F.col("t")) != F.col("want")).count() == 0


def test_error_rates(spark):
    rows = [("a b c d", "a x c", 2 / 4), ("", "", 0.0), ("", "x", 1.0), ("One two", "one TWO", 0.0)]
    for r, (_, _, want) in zip(spark.createDataFrame(rows, "r string, p string, w double").select(text.wer(F.col("r"), F.col("p")).alias("w")).collect(), rows, strict=True):
        assert r.w == pytest.approx(want)


def test_curation_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "code string, seq int")
    with pytest.raises(ValueError, match="missing"):
        curate.require_columns(df, ["text"])
    with pytest.raises(ValueError, match="0 of 1"):
        curate.ingest_new(df, df, 1, "seq")
    path = str(tmp_path / "out")
    tables.publish(df, path, 1)
    with pytest.raises(ValueError, match="instead of"):
        tables.publish(df.limit(0), path, 1)
    assert tables.read_published(spark, path).count() == 1
    tables.publish(df.union(df), path, 2)
    assert tables.read_published(spark, path).count() == 2


def test_a_large_vocabulary_is_joined_without_texts(spark, inputs, monkeypatch):
    small = match.vocab_hits(inputs.sections, inputs.vocab)
    monkeypatch.setattr(match, "BROADCAST_TERMS", 5)
    large = match.vocab_hits(inputs.sections, inputs.vocab)
    assert sorted(map(str, small.select(*sorted(small.columns)).collect())) == sorted(map(str, large.select(*sorted(small.columns)).collect()))


@pytest.mark.parametrize("most", [50_000, 0])
def test_rows_with_null_and_repeated_keys(spark, inputs, monkeypatch, most):
    """Each row is a text of its own, on either side of the bound."""
    monkeypatch.setattr(match, "BROADCAST_TERMS", most)
    texts = [(None, "d", "milk and egg"), (None, "d", "salt"), ("a", "d", "milk"), ("a", "d", "egg"), ("b", "d", "milk")]
    hits = match.vocab_hits(spark.createDataFrame(texts, "code string, section string, text string"), inputs.vocab)
    want = sorted((c or "", t, x) for c, _, t in texts for x in ("milk", "egg") if x in t)
    assert sorted((r.code or "", r.text, r.term) for r in hits.collect()) == want
    rows = [(None, "milk"), (None, "salt"), ("a", "milk"), ("a", "egg. May contain nuts"), ("a", None), ("a", "milk")]
    got = match.analyze(spark.createDataFrame(rows, "code string, text string"), inputs.vocab).collect()
    sets = sorted((r.code or "", r.text or "", "|".join(r.declared_allergens), "|".join(r.trace_allergens), r.risk) for r in got)
    assert sets == sorted(
        [("", "milk", "milk", "", "AVOID"), ("", "salt", "", "", "SAFE"), ("a", "milk", "milk", "", "AVOID"), ("a", "milk", "milk", "", "AVOID"), ("a", "egg. May contain nuts", "egg", "tree_nut", "AVOID"), ("a", "", "", "", "SAFE")]
    )


@pytest.mark.parametrize("most", [50_000, 0])
def test_terms_anywhere(spark, monkeypatch, most):
    """Against a test of all terms in all texts."""
    monkeypatch.setattr(match, "BROADCAST_TERMS", most)
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abé ñ") for _ in range(n))
    texts = [(i % 50 or None, word(r.randint(0, 60))) for i in range(120)]
    terms = sorted({word(r.randint(1, 6)) for _ in range(60)}) + ["", "nowhere at all"]
    vocab = spark.createDataFrame([(f"g{i % 3}", t) for i, t in enumerate(terms)], "allergen string, term string")
    hits = match.substring_hits(spark.createDataFrame(texts, "code long, text string"), vocab, ("code",))
    assert sorted((x.code or 0, x.text, x.term) for x in hits.collect()) == sorted((c or 0, t, x) for c, t in texts for x in terms if x and x in t)
    left = embed.without_term(spark.createDataFrame([(t,) for _, t in texts] + [(None,)], "phrase string"), vocab)
    assert sorted(x.phrase or "" for x in left.collect()) == sorted([t for _, t in texts if not any(x and x in t for x in terms)] + [""])


def test_clause_features(spark):
    """Weights and folds against the definition in Python."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["a", "of", "milk", "éa", "nuts", "contains"]) for _ in range(r.randint(0, 7))), i % 3 == 0) for i in range(60)]
    df = spark.createDataFrame([(i, t, int(y)) for i, t, y in rows], "row long, text string, label int")

    def grams(t):
        words = t.split()
        long = [w for w in words if len(w) > 1]
        out = ["w" + w for w in long] + ["w" + " ".join(p) for p in zip(long, long[1:], strict=False)]
        return Counter(out + [f"c{x[i : i + k]}" for w in words for x in [f" {w} "] for k in (3, 4, 5) for i in range(len(x) - k + 1)])

    def expected(ids):
        df_ = Counter(g for i in ids for g in grams(rows[i][1]))
        idf = {g: math.log((1 + len(ids)) / (1 + n)) + 1 for g, n in df_.items() if n >= 2}
        out = {}
        for i, t, _ in rows:
            w = {g: (1 + math.log(n)) * idf[g] for g, n in grams(t).items() if g in idf}
            size = {k: math.sqrt(sum(x * x for g, x in w.items() if g[0] == k)) for k in "wc"}
            out |= {(i, g): x / size[g[0]] for g, x in w.items()}
        return out

    def same(got, want):
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    features = learn.fit_features(df)
    names = {f.at: f.gram for f in features.collect()}
    assert [names[i] for i in range(len(names))] == sorted(names.values())
    want = expected(range(60))
    same({(x.row, x.gram): x.weight for x in learn.weights(df, features).collect()}, want)
    same({(x.row, names[int(i)]): float(v) for x in learn.vectors(df, features).collect() for i, v in zip(x.features.indices, x.features.values, strict=True)}, want)
    dealt = learn.folds(df, 4)
    assert sorted((r.label, r.fold, r["count"]) for r in dealt.groupBy("label", "fold").count().collect()) == [(0, i, 10) for i in range(4)] + [(1, i, 5) for i in range(4)]
    fold = {x.row: x.fold for x in dealt.collect()}
    by_fold = learn.fit_features_by_fold(dealt, 4)
    names = {f.at: f.gram for f in by_fold.collect()}
    found = learn.vectors(dealt, by_fold, 4).collect()
    assert len(found) == 240
    for k in range(4):
        got = {(x.row, names[int(i)]): float(v) for x in found if x.without == k for i, v in zip(x.features.indices, x.features.values, strict=True)}
        same(got, expected([i for i in range(60) if fold[i] != k]))


def test_places_in_order(spark):
    rows = [(g, i * 7 % 90) for g in (None, "a", "b") for i in range({None: 5, "a": 80, "b": 1}[g])]
    df = spark.createDataFrame(rows, "g string, x int").repartition(6)
    got = sorted((r.g or "", r.x, r._at, r._size) for r in numbered(df, "g", ["x"]).collect())
    want = [(g or "", x, i, len(xs)) for g in (None, "a", "b") for xs in [sorted(x for h, x in rows if h == g)] for i, x in enumerate(xs)]
    assert got == sorted(want)


def test_quota_is_a_ranking_limit(inputs):
    plan = queries.smp2_quota_sample(inputs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_average_ranks_of_many_values(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 == 0, 0.5).otherwise(F.rand(3)).alias("x"))
    df = df.checkpoint()
    got = {(r.x, r.rank_x) for r in stats.average_ranks(df, ["x"]).collect()}
    values = sorted(r.x for r in df.collect())
    want = {(x, (values.index(x) + len(values) - values[::-1].index(x) + 1) / 2) for x in set(values[:50]) | {0.5}}
    assert {g for g in got if g[0] in {w[0] for w in want}} == want and stats.average_ranks(df, ["x"]).count() == 5000


def test_nearest_terms_in_blocks(spark, monkeypatch):
    """Blocks of any size give the nearest term of each allergen, the first in order on a tie; odd vectors take no part."""
    vectors = [[float((i * 7 + j * j) % 5 - 2) for j in range(4)] for i in range(30)]
    odd = [("c", 90, "p90", None), ("c", 91, "p91", [1.0, None, 1.0, 1.0]), ("c", 92, "p92", [1.0])]
    phrases = spark.createDataFrame([("c", i, f"p{i}", v) for i, v in enumerate(vectors)] + odd, "code string, pos long, phrase string, vector array<double>")
    terms = [("ab"[i % 2], f"t{i:02}", v) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([*terms, ("a", "none", None)], "allergen string, term string, vector array<double>")
    want = []
    for i, v in enumerate(vectors):
        for a in "ab":
            d, t = min((-sum(x * y for x, y in zip(v, w, strict=True)), t) for x, t, w in terms if x == a)
            want.append((i, a, t, -d))
    for size, part in ((embed.BLOCK, embed.PART), (20, 3)):
        monkeypatch.setattr(embed, "BLOCK", size)
        monkeypatch.setattr(embed, "PART", part)
        got = embed.best_per_allergen(phrases, table).select("pos", "allergen", "term", "similarity").collect()
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_correlation_p():
    """Published values: n = 39, r = -0.2267 and -0.3457; and a table of Student's t."""
    assert stats.correlation_p(39, -0.2267) == pytest.approx(0.1652, abs=1e-4) and stats.correlation_p(39, -0.3457) == pytest.approx(0.0311, abs=1e-4)
    for dof, t in ((4, 2.776445), (10, 2.228139), (30, 2.042272), (120, 1.979930)):
        assert stats.correlation_p(dof + 2, t / math.sqrt(dof + t * t)) == pytest.approx(0.05, abs=1e-6)
    assert stats.correlation_p(100, 0.0) == 1 and stats.correlation_p(2, 1.0) == 1


def test_mann_whitney_p(spark):
    """The textbook's two groups (one-sided, exact 1/18 and with continuity correction), counts of all orders, and ties."""
    rows = [(1, x) for x in (19, 22, 16, 29, 24)] + [(0, x) for x in (20, 11, 17, 12)]
    u = stats.mann_whitney(spark.createDataFrame(rows, "g int, x int"), "g", "x").first()
    assert (u.n1, u.n0, u.u, u.ties) == (5, 4, 17, 0)
    assert stats.mann_whitney_p(5, 4, u.u) == pytest.approx(1 / 18) and stats.mann_whitney_p(5, 4, u.u, exact=0) == pytest.approx(0.1113469 / 2, abs=1e-7)
    for n1, n0 in ((3, 4), (4, 2), (1, 5)):
        scores = [sum(a > b for a in own for b in set(range(n1 + n0)) - set(own)) for own in itertools.combinations(range(n1 + n0), n1)]
        for v in range(n1 * n0 + 1):
            assert stats.mann_whitney_p(n1, n0, v) == pytest.approx(sum(s >= v for s in scores) / len(scores))
    tied = stats.mann_whitney(spark.createDataFrame([(i % 2, i // 4) for i in range(12)] + [(1, 9), (None, 3), (0, None)], "g int, x int"), "g", "x").first()
    assert tied.ties == 3 * (4**3 - 4) and math.isclose(stats.mann_whitney_p(tied.n1, tied.n0, tied.u, tied.ties), 0.5 * math.erfc(tied.z / math.sqrt(2)))


def test_ranks_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7919 % 101 if i % 9 else None, i % 5) for i in range(700)], "x int, y int")
    key = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows)
    few = key(stats.average_ranks(df, ["x", "y"]).collect())
    monkeypatch.setattr(stats, "RANKED", 3)
    assert key(stats.average_ranks(df, ["x", "y"]).collect()) == few


def test_edit_distance(spark):
    """Against the table of all cells, with edits that cross any border."""

    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    r = random.Random(2)
    for _ in range(400):
        a, b = ("".join(r.choice("abé ") for _ in range(r.randint(0, 70))) for _ in range(2))
        assert distance(a, b) == table(a, b) and distance(a.split(), b.split()) == table(a.split(), b.split())
    words = [f"w{r.randint(0, 50)}" for _ in range(200)]
    moved = words[20:] + words[:20]
    rows = [(1, " ".join(words), " ".join(moved)), (2, "", "x"), (3, None, None), (4, "x y", ""), (1, "a b c", "a c"), (5, "long " * 20_000, "lang " * 20_000)]
    got = ocr.error_rates(spark.createDataFrame(rows, "image_id long, reference string, predicted string"), ("image_id",)).collect()
    found = sorted((x.image_id, round(x.cer, 9), round(x.wer, 9)) for x in got)
    text, other = " ".join(words), " ".join(moved)
    assert found == sorted([(1, round(table(text, other) / len(text), 9), round(table(words, moved) / 200, 9)), (1, 0.4, round(1 / 3, 9)), (2, 1, 1), (3, 0, 0), (4, 1, 1), (5, round(20_000 / 99_999, 9), 1)])


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        tables.read_published(spark, path)
    for n in (3, 5, 7):
        held = tables.publish(spark.range(n), path, n)
        assert tables.read_published(spark, path).count() == n
    with pytest.raises(ValueError, match="9 rows"):
        tables.publish(spark.range(9), path, 8)
    current, known = tables.versions(spark, path)
    assert tables.read_published(spark, path).count() == 7 == held.count() and len(known) == 2 and current == known[-1]


def test_a_batch_reads_its_keys_only(spark, tmp_path):
    """Keys come once, batches that are repeated or late too; the ledger's folders hold what their keys hash to."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    schema = "code string, ts timestamp, n int"
    total: set[str] = set()
    for k in range(3):
        rows = [(f"c{i}", datetime.datetime(2024, 1, 1 + 3 * k, 0, i % 60), k) for i in range(k * 30, k * 30 + 60)] + [("c1", datetime.datetime(2024, 1, 1 + 3 * k), k)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        total |= {r[0] for r in rows}
        streams.ingest_stream(spark.readStream.schema(schema).parquet(str(source)), target, str(tmp_path / "state"), buckets=16, availableNow=True).awaitTermination()
        assert sorted(r.code for r in spark.read.parquet(target).collect()) == sorted(total)
    keys = spark.read.parquet(f"{target}_keys")
    assert {r.code for r in keys.collect()} == total and keys.where("bucket <> pmod(_hash, 16)").count() == 0


def test_word_distance_of_many_words(spark):
    words = [f"w{i}" for i in range(60_000)]
    other = words[:50] + ["x"] + words[51:]
    df = spark.createDataFrame([(words, other, list(dict.fromkeys(words + other)))], "r array<string>, p array<string>, w array<string>")
    row = df.select(F.array_position("w", F.lit("w59999")).alias("n"), text.word_distance(F.slice("r", 59_900, 100), F.slice("p", 59_900, 100), F.col("w")).alias("same"), text.word_distance(F.slice("r", 1, 100), F.slice("p", 1, 100), F.col("w")).alias("one")).first()
    assert (row.n, row.same, row.one) == (60_000, 0, 1)


def test_expanded_characters(spark):
    got = spark.createDataFrame([("ﬀ Ĳ ½ cup №5 ™ É",)], "t string").select(text.normalize(F.col("t"))).first()[0]
    assert got == "ff ij 1 2 cup no5 tm e"


def test_heading_of_several_words(spark):
    lines = spark.createDataFrame([("Liste der Zutatem",), ("lista de ingredintes: x",), ("nothing like it at all here",)], "t string")
    got = [r[0] for r in lines.select(ocr.fuzzy_heading(F.col("t"), ("liste der zutaten", "lista de ingredientes"))).collect()]
    assert got == [True, True, False]


def test_products_in_latin_letters(spark, tmp_path):
    header = ",".join(tables.PRODUCT.names)
    (tmp_path / "l.csv").write_bytes((header + "\n1,Crème,,,,,fr\n").encode("latin-1"))
    (tmp_path / "u.csv").write_bytes(b"\xef\xbb\xbf" + (header + "\n2,Crème,,,,,fr\n").encode() + b"3,\xff,,,,,\n")
    assert tables.read_products(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first().product_name == "Crème"
    assert [(r.code, r.product_name) for r in tables.read_products(spark, str(tmp_path / "u.csv")).collect()] == [("2", "Crème"), ("3", "\ufffd")]


def test_products_with_line_breaks(spark, tmp_path):
    rows = [("007", 'a "b"', "x,\ny", None, "en:milk", None, "en")]
    path = str(tmp_path / "p.csv")
    tables.write_results(spark.createDataFrame(rows, tables.PRODUCT), path)
    got = tables.read_products(spark, path).first()
    assert (got.code, got.product_name, got.ingredients_text) == ("007", 'a "b"', "x,\ny")


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"milk": ["Lait", "lait ", ""], "unknown": ["x"], "egg": "no list"}')
    assert [tuple(r) for r in tables.read_vocabulary(spark, str(tmp_path / "v.json")).collect()] == [("milk", "lait")]


def test_near_duplicate_terms(spark):
    terms = ["hazelnut", "hazelnuts", "hazelnot", "almonds", "almond", "milk", "milks", "abcdefghijkl", "abcdefghijkx", "xbcdefghijkl"]
    vocab = spark.createDataFrame([("g", t) for t in terms], "allergen string, term string")
    got = {(r.a, r.b) for r in vocabulary.near_duplicates(vocab, 0.85).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert got == {(a, b) for a in terms for b in terms if a < b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.85}


def test_greedy_sample(inputs):
    """Against a plain loop over strata."""
    got = queries.smp6_greedy_sample(inputs).collect()
    members: dict[str, set] = {}
    for r in queries._members(inputs).collect():
        members.setdefault(r.stratum, set()).add(r.id)
    place = lambda i: ((i * 48271 + 11) % 2147483647, i)
    targets = {r.stratum: r.target for r in queries._targets(inputs).collect()}
    order = sorted(targets, key=lambda s: (sample.KINDS.index(s.split(":")[0]), len(members.get(s, ())), s))
    chosen: dict[int, str] = {}
    for s in [*order, "fill"]:
        pool = set().union(*members.values()) if s == "fill" else members.get(s, set())
        most = 60 if s == "fill" else min(targets[s], len(pool), sample.PER_LANGUAGE if s.startswith("lang:") else 60)
        for i in sorted(pool - set(chosen), key=place)[: min(most, 60 - len(chosen))]:
            chosen[i] = s
    assert {r.id: r.stratum for r in got} == chosen and len(got) == 60


def test_sections_of_ocr_lines(spark):
    lines = [(1, 0, "Brand"), (1, 1, "Ingredients: milk,"), (1, 2, "sugar"), (1, 3, "Nutrition facts"), (1, 4, "x"), (2, 0, "lngredients"), (2, 1, "y" * 1600), (3, 0, "nothing")]
    got = {r.image_id: (r.section, r.found) for r in ocr.ingredient_section(spark.createDataFrame(lines, "image_id long, line_no int, text string")).collect()}
    assert got[1] == ("milk, sugar", True) and got[2][1] is False and 3 not in got


def test_shuffle_key_is_a_permutation(spark):
    keys = spark.range(10_000).select(sample.shuffle_key(F.col("id"), 5).alias("k"))
    assert keys.distinct().count() == 10_000


def _files(name):
    path = f"{SF}/{name}"
    return f"{path}/*.parquet" if os.path.isdir(path) else path


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{_files(f)}'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(oracles.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    got, want = sorted((tuple(r) for r in df.select(*columns).collect()), key=key), sorted(want.fetchall(), key=key)
    assert len(got) == len(want) and all(x == y or (isinstance(x, float) and x == pytest.approx(y, abs=2e-6)) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))

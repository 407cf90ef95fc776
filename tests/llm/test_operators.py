"""Each operator against brute force on a small table with nulls, blanks, ties, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelscan.llm import components, fm_index, media, minhash, packing, pii, quality, substring, token_files, toxicity
from labelscan.llm.mixing import mix
from labelscan.llm.neighbours import nearest
from labelscan.llm.shared import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, kept boolean, target double"


def rows() -> list[tuple]:
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    texts: list[str | None] = [None, "", " \t\n", "one", "one two three", "A\x0bB\x0cC D"]
    for _ in range(40):
        texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(5, 200))))
    for k in range(12):  # one passage in many surroundings
        texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) + " " + passage + " " + " ".join(r.choice(vocabulary) for _ in range(k * 5)))
    for _ in range(12):  # near and exact copies
        words = texts[r.randint(6, 40)].split()
        if r.random() < 0.6:
            words[r.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append("again " * 300)
    texts.append(" ".join(r.choice(vocabulary) for _ in range(20_000)))
    out = [(i * 3 % 101, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), 7, True, 1.0) for i, t in enumerate(texts)]
    return out + [(5000, "same id", "en", "a", 1, True, 1.0), (5000, "same id", "en", "a", 1, True, 1.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


def test_words_match_pattern():
    texts = [t for _, t, *_ in rows()]
    w = Words(pa.array(texts))
    assert [len(words_of(t)) for t in texts] == w.counts.tolist()
    assert [[x.encode() for x in words_of(t)] for t in texts] == [w.words(i) for i in range(w.n)]
    by_hash: dict[int, set] = {}
    for h, x in zip(w.hashes.tolist(), [x for t in texts for x in words_of(t)], strict=True):
        by_hash.setdefault(h, set()).add(x)
    assert all(len(v) == 1 for v in by_hash.values())


def expected_removal(table):
    first: dict[tuple, int] = {}
    for i, t, *_ in table:
        w = words_of(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t, *_ in table:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("hot", [2048, 2])  # with 2, common passages go the way of hot runs
def test_substring(docs, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    got = sorted(tuple(r) for r in substring.deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_text").collect())
    want = expected_removal(rows())
    assert got == want and sum(x[2] for x in want) > 500


def test_fm_index_owners():
    r = np.random.default_rng(1)
    lengths = r.integers(3, 12, 50)
    symbols = r.integers(0, 3, int(lengths.sum())).astype(np.uint64)
    owners = r.permutation(50)
    got = fm_index.FMIndex(symbols, lengths, owners, 4).owners()
    ends = np.cumsum(lengths)
    pieces = [tuple(symbols[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
    for i, p in enumerate(pieces):
        for k in range(len(p) - 3):
            assert got[i, k] == min(owners[j] for j, q in enumerate(pieces) if any(q[a : a + 4] == p[k : k + 4] for a in range(len(q) - 3)))


def expected_components(table, n):
    sets = {}
    for i, t, *_ in table:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words_of(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and label[i] != label[j]:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                        label[i] = label[j] = min(label[i], label[j])
                        changed = True
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i, *_ in table)


@pytest.mark.parametrize("pivots", [8, 1])  # with 1, most links are left to the comparison across components
def test_near_duplicates(docs, monkeypatch, pivots):
    monkeypatch.setattr(minhash, "PIVOT_BANDS", pivots)
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs, shingle=4).collect())
    want = expected_components(rows(), 4)
    assert got == want and sum(not x[3] for x in want) > 5


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(3, 70), (70, 71), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 20 for i in range(20, 61)}, 3: 3, 70: 3, 71: 3}


def test_bayes_bars():
    bars = minhash.least_equal(0.8, 1e-9)
    assert bars == sorted(bars) and 60 < bars[-1] < 102 and len(bars) == minhash.HASHES // minhash.STEP


def test_segments_are_maximal():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 14)
        positive = sorted(r.sample(range(n), r.randint(0, n)))
        scores = [r.choice([0.2, 0.5, 1.0]) for _ in positive]
        values = [toxicity.NEUTRAL] * n
        for p, s in zip(positive, scores, strict=True):
            values[p] = s
        got = toxicity.segments(np.array(positive, int), np.array(scores))
        assert sorted(p for a, b, _ in got for p in range(a, b) if values[p] > 0) == positive
        best = max((sum(values[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert max((s for *_, s in got), default=0) == pytest.approx(max(best, 0) if positive else 0)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))


def test_toxicity(spark, docs, empty):
    r = random.Random(5)
    made = [(i, " ".join([r.choice("abcdefgh") * 3 for _ in range(20)] + (["vile" + r.choice(["x", "yy", "z"])] if i % 3 == 0 else [])), i % 3 == 0) for i in range(600)]
    table = spark.createDataFrame([(i, t) for i, t, _ in made], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in made if i % 5] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = {r.doc_id: r.toxicity for r in toxicity.score(table, model).collect()}
    assert all((got[i] >= 0.5) == y for i, _, y in made)
    out = toxicity.score(docs, model)
    assert out.count() == len(rows()) and out.where("toxicity < 0 or toxicity > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    nothing = toxicity.train(table, labels.where("false"))
    assert toxicity.score(table, nothing).where("toxicity is null").count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_patched_blocks():
    r = np.random.default_rng(1)
    for ids in (np.array([], int), np.array([5]), r.integers(0, 49408, 4096), np.array([7] * 100 + [2**32 - 1]), r.integers(0, 50, 4000) * r.integers(0, 2, 4000)):
        block = token_files.pack(ids.astype(np.uint32))
        out, end = token_files.unpack(block + b"next")
        assert end == len(block) and (out == ids).all()


def test_token_files(spark, docs, empty, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    path = token_files.write(docs, tokenizer)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows())
    start = 0
    texts: dict[int, list] = {}
    for i, x, *_ in rows():
        texts.setdefault(i, []).append([*t.encode(x or "", add_special_tokens=False).ids, token_files.END])
    for r in got:
        assert r.start == start and r.ids in texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert token_files.read(spark, token_files.write(empty, tokenizer)).count() == 0


def test_encoder_equals_tokenizer(tokenizer):
    r = random.Random(3)
    letters = list("abstdmrvl'!,.019 \n\t-éßŠ<|") + ["“", "é", " ", "Σ", "İ", "×", "\x1f"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|>", "don't 'Re x'll"]
    e = token_files.Encoder(tokenizer)
    want = [[*x.ids, token_files.END] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e(pa.array(texts))] == want


def brute_spans(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(pii.PATTERNS[kind].pattern.decode(), text or ""):
            if pii.valid(kind, m[0].encode()):
                out.append((kind, m.start(), m.end()))
    return out


PERSONAL = ["a.b@c.de x", "é mail me@x.y.z, or 1.2.3.4.5 and 256.1.1.1", "card 4111 1111 1111 1111.", "12 4111111111111111", "+49 (30) 123-45 67", "@ @. 1.2.3", None, "", "+1", "tel +1 (980) 555-6268 id 5755695738806562"]


def test_personal_data(spark, docs, empty):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(PERSONAL * 20)], "doc_id long, text string, pii_base int")
    network = pii.train(table)
    got = {r.doc_id: r for r in pii.find(table, network).collect()}
    for i, t in enumerate(PERSONAL * 20):
        base = [(s.kind, s.start, s.end) for s in got[i].pii_base]
        spans = [(s.kind, s.start, s.end) for s in got[i].pii_spans]
        assert base == brute_spans(t) and set(base) <= set(spans)
        assert all(pii.plausible(k, t[a:b].encode()) for k, a, b in set(spans).difference(base))
    hidden = pii.redact(table, network).where("doc_id = 2").first().text
    assert hidden == "card <card>."
    assert pii.find(docs, network).count() == len(rows()) and pii.find(empty, network).count() == 0


def test_network_gradients():
    net = pii.Network.fresh()
    net.p = {k: v.astype(np.float64).astype(np.float32) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, pii.CLASSES, (5, 3)), r.integers(0, pii.TAGS, (5, 3))

    def loss():
        e, trans = net.emissions(x).astype(float), net.p["trans"].astype(float)
        total = 0.0
        for n in range(3):
            a = net.p["first"] + e[0, n]
            gold = net.p["first"][y[0, n]] + e[0, n, y[0, n]]
            for t in range(1, 5):
                a = np.log(np.exp(a[:, None] + trans).sum(axis=0)) + e[t, n]
                gold += trans[y[t - 1, n], y[t, n]] + e[t, n, y[t, n]]
            total += np.log(np.exp(a).sum()) - gold
        return total / 3

    g = net.gradients(x, y)
    for name in ("xf", "hb", "of", "trans", "bias", "first"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = net.p[name][at]
        net.p[name][at] = old + 1e-2
        up = loss()
        net.p[name][at] = old - 1e-2
        down = loss()
        net.p[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], rel=0.05)


def test_neighbours(spark):
    r = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in r.integers(-3, 4, 8)]) for i in range(120)]  # integers make ties
    bad = [(200, None), (220, [0.0] * 8), (240, [float("nan")] + [1.0] * 7), (260, [None] + [1.0] * 7), (280, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (300, [1.0, 2.0])]
    table = spark.createDataFrame([(*x, 1.0) for x in vectors + bad + vectors[:2]], "vec_id long, embedding array<float>, score double")
    got = [tuple(x) for x in nearest(table, F.col("vec_id") % 20 == 0, k=5).orderBy("query_id", "rank").collect()]
    want = []
    usable = [(i, v) for i, v in vectors if any(v)]
    for q, v in usable:
        if q % 20 == 0:
            near = sorted(((-float(np.dot(v, w)), i) for i, w in usable if i != q))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    assert [x for x in got if x[0] < 200] == want and not [x for x in got if x[0] in (200, 220, 240, 260, 280)]
    assert nearest(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=300, per_source=2).toPandas()
    placed = got[got.n_bin.notna()]
    sizes = {i: len(words_of(t)) for i, t, *_ in rows()}
    assert placed[placed.doc_id != 5000].groupby("doc_id").n_words.sum().to_dict() == {i: n for i, n in sizes.items() if n and i != 5000}
    assert len(got[got.doc_id == 5000]) == 2 and got[got.doc_id == 5000].n_bin.nunique() == 2
    assert (placed.groupby("n_bin").n_words.sum() <= 300).all()
    assert not placed.duplicated(["n_bin", "cluster"]).any()
    assert (placed.groupby(["n_bin", "source"], dropna=False).size() <= 2).all()
    assert packing.pack(empty).count() == 0


def test_best_fit_is_tightest():
    r = random.Random(8)
    sizes = sorted((r.randint(1, 50) for _ in range(120)), reverse=True)
    sources, clusters = [r.choice("abc") for _ in sizes], [r.randint(0, 40) for _ in sizes]
    got = packing.best_fit(sizes, sources, clusters, 60, 2)
    bins: list[dict] = []
    for s, a, c, (b, offset) in zip(sizes, sources, clusters, got, strict=True):
        fits = [(60 - x["used"], i) for i, x in enumerate(bins) if 60 - x["used"] >= s and c not in x["clusters"] and x["sources"].count(a) < 2]
        want = min(fits)[1] if fits else len(bins)
        if want == len(bins):
            bins.append({"used": 0, "clusters": set(), "sources": []})
        assert b == want and offset == bins[b]["used"]
        bins[b]["used"] += s
        bins[b]["clusters"].add(c)
        bins[b]["sources"].append(a)


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, live = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in live}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        live -= over


def test_mixing(docs, empty, spark):
    got = mix(docs).toPandas()
    sizes: dict = {}
    for _, t, _, s, *_ in rows():
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = expected_targets(sizes)
    for r in got.itertuples():
        s = None if r.source is None or r.source != r.source else r.source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r.size
    largest = max(len(words_of(t)) for _, t, *_ in rows())
    taken = got.groupby("source", dropna=False).taken.sum()
    for s, n in taken.items():
        assert abs(n - want[None if s != s else s]) <= largest / 2 + 1
    assert got.position.between(0, 1).all()
    assert mix(docs).select("doc_id", "position").orderBy("doc_id", "position").collect() == mix(docs.repartition(7)).select("doc_id", "position").orderBy("doc_id", "position").collect()
    assert mix(empty).count() == 0
    assert not [x for x in mix(docs)._jdf.queryExecution().executedPlan().toString().split() if "Python" in x or "Arrow" in x]


def test_media_round_trip(docs, empty):
    payloads = [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 5, b"\xff\x00" * 50, bytes(64 * media.STRIP + 100)]
    for p, (_, grids) in zip(payloads, media.thumbnails(media.write(payloads)), strict=True):
        assert np.concatenate(grids).tobytes() == media.padded(p)
    got = {}
    for r in media.read(media.store(docs)).collect():
        got.setdefault(r.doc_id, r)
    for i, t, *_ in rows():
        data = (t or "").encode()
        assert got[i].n_bytes == len(data) and got[i].payload_sha256 == hashlib.sha256(media.padded(data)).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(media.padded(data)[-64:])
    assert media.read(media.store(empty)).count() == 0


def colour_picture() -> tuple[bytes, np.ndarray]:
    """A 4:2:0 picture of 20 x 18 samples without restarts, with an AC coefficient in some blocks, written bit by bit."""
    dc_counts, dc_symbols, dc = media._canonical({k: 4 for k in range(9)})
    ac_counts, ac_symbols, ac = media._canonical({0x00: 1, 0x13: 2, 0xF0: 3})
    r = random.Random(1)
    luma = np.array([[r.randint(-100, 100) for _ in range(4)] for _ in range(4)])
    bits, last = "", [0, 0, 0]

    def block(component, value, noisy):
        nonlocal bits
        d, last[component] = value - last[component], value
        size = abs(d).bit_length()
        code, n = dc[size]
        bits += f"{code:0{n}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
        if noisy:
            for symbol, extra in ((0xF0, ""), (0x13, "101")):
                code, n = ac[symbol]
                bits += f"{code:0{n}b}" + extra
        code, n = ac[0]
        bits += f"{code:0{n}b}"

    for y in range(2):
        for x in range(2):
            for v in range(2):
                for h in range(2):
                    block(0, int(luma[2 * y + v, 2 * x + h]), (v + h) % 2)
            block(1, 5 * x, False)
            block(2, -7 * y, True)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0, 4] + [1] * 63)) + seg(0xC0, bytes([8, 0, 18, 0, 20, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return head + seg(0xC4, bytes([0, *dc_counts, *dc_symbols])) + seg(0xC4, bytes([0x10, *ac_counts, *ac_symbols])) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9", luma


def test_foreign_picture(spark):
    data, luma = colour_picture()
    ((pictures, (grid,)),) = media.thumbnails([data])
    assert (pictures[0].width, pictures[0].height) == (20, 18) and grid.shape == (3, 3)
    assert (grid == np.clip((luma[:3, :3] * 4 + 4) // 8 + 128, 0, 255)).all()
    table = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no picture")), (3, None)], "id long, media binary")
    got = {r.id: r for r in media.read(table).collect()}
    assert got[1].width == 20 and got[2].feature is None and got[3].feature is None


def test_quality(spark, docs, empty):
    r = random.Random(9)
    made = [(i, " ".join(("bad$$$" if i % 4 == 0 else "fine") + str(r.randint(0, 9)) + ("%%%" if i % 4 == 0 else "") for _ in range(r.randint(1, 60))), "en", f"s{i % 3}", i % 4 != 0) for i in range(400)]
    table = spark.createDataFrame([x[:4] for x in made], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(x[0], int(x[4])) for x in made if x[0] % 2] + [(0, 0), (4, 0), (8, 0), (None, 1), (16, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = {x.doc_id: x for x in quality.judge(table, model).collect()}
    assert all(got[x[0]].kept == x[4] for x in made)
    assert quality.judge(docs, model).count() == len(rows()) and quality.judge(empty, model).count() == 0
    assert set(quality.judge(docs, model).columns) >= set(SCHEMA.replace(" long", "").replace(" string", "").replace(" boolean", "").replace(" double", "").split(", "))
    neutral = quality.judge(table, quality.train(table, labels.where("false")))
    assert neutral.where("kept is null").count() == 0


def test_sites_shrink_to_what_lies_above(spark):
    paths = spark.createDataFrame([("a", "x", 1000, 900.0, 850.0), ("a", "y", 1, 0.0, 0.0), ("b", None, 500, 100.0, 60.0), (None, "x", 2, 2.0, 2.0)], "_host string, _path string, n long, s double, q double")
    got = {(r["_host"], r["_path"]): r["_a"] / r["_n"] for r in quality.posteriors(paths).collect()}
    assert got["a", "x"] == pytest.approx(0.9, abs=0.02) and 0.1 < got["a", "y"] < 0.9 and got["b", None] < 0.3 and 0.5 < got[None, "x"] < 1

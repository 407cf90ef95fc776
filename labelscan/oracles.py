"""DuckDB SQL of the registered queries, over common table expressions for the derived inputs."""

from __future__ import annotations

import re

from labelscan.functions.tags import ALIASES, ALLERGENS, DISPLAY, NAMES, TAGS
from labelscan.plans import rules
from labelscan.sources.fixtures import labels_duckdb, quoted

#: Words of a piece of a line, short enough that each of its characters or words can be one byte.
PIECE = 16
LETTER = r"\p{L}\p{N}_"


def norm(x: str, keep: str = "") -> str:
    t = f"lower(coalesce({x}, ''))"
    for a, b in (("œ", "oe"), ("æ", "ae"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        t = f"replace({t}, '{a}', '{b}')"
    return rf"trim(regexp_replace(strip_accents({t}), '[^\p{{L}}\p{{N}}{keep}]+', ' ', 'g'))"


def norm_ocr(x: str) -> str:
    t = rf"regexp_replace(lower(coalesce({x}, '')), '\s+', ' ', 'g')"
    return rf"trim(regexp_replace(regexp_replace({t}, '[^{LETTER} %.,;:()''/+-]', ' ', 'g'), ' +', ' ', 'g'))"


def norm_heading(x: str) -> str:
    return rf"trim(regexp_replace({norm(x)}, '[^\p{{L}}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def ratio(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif({b}, 0), 0)"


def metrics(by: str, source: str, ref: str, pred: str) -> str:
    """Micro metrics as flat() gives them."""
    g = f"{by}, " if by else ""
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    return f"""SELECT {g}tp, fp, fn, round({p}, 6) AS precision, round({r}, 6) AS recall, round({ratio(f'2 * {p} * {r}', f'{p} + {r}')}, 6) AS f1
      FROM (SELECT {g}sum(len(list_intersect({ref}, {pred})))::BIGINT AS tp, sum(len(list_filter({pred}, lambda x: NOT list_contains({ref}, x))))::BIGINT AS fp,
        sum(len(list_filter({ref}, lambda x: NOT list_contains({pred}, x))))::BIGINT AS fn FROM {source} {f'GROUP BY {by}' if by else ''})"""


def label_metrics(by: str, source: str, ref: str, pred: str, everything: bool) -> str:
    g = f"{by}, " if by else ""
    p, r = ratio("tp", "tp + fp"), ratio("tp", "tp + fn")
    marks = f"""SELECT {g}allergen, count(*) FILTER (list_contains({ref}, allergen) AND list_contains({pred}, allergen)) AS tp, count(*) FILTER (NOT list_contains({ref}, allergen)) AS fp,
        count(*) FILTER (NOT list_contains({pred}, allergen)) AS fn FROM (SELECT {g}{ref}, {pred}, unnest(list_distinct(list_concat({ref}, {pred}))) AS allergen FROM {source}) GROUP BY {g}allergen"""
    base = f"SELECT g.allergen, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM groups g LEFT JOIN ({marks}) m USING (allergen)" if everything else marks
    return f"SELECT {g}allergen, tp, fp, fn, round({p}, 6) AS precision, round({r}, 6) AS recall, round({ratio(f'2 * {p} * {r}', f'{p} + {r}')}, 6) AS f1, tp + fn AS support FROM ({base})"


def tag_list(x: str, dialect: str) -> str:
    t = strip(f"coalesce({x}, '')")
    items = rf"regexp_extract_all({t}, '[''\x22]([^''\x22]*)[''\x22]', 1)"
    plain = "[]::VARCHAR[]" if dialect == "sampling" else f"CASE WHEN contains({t}, '|') THEN string_split({t}, '|') WHEN contains({t}, ';') THEN string_split({t}, ';') ELSE string_split({t}, ',') END" if dialect == "ocr" else f"string_split_regex({t}, '[,;|]')"
    one = norm("regexp_replace(" + strip("x") + ", '^[a-zA-Z]{2}:', '')") if dialect.startswith("multi") or dialect == "diagnose" else f"lower({strip('x')})"
    return f"list_filter(list_transform(CASE WHEN starts_with({t}, '[') THEN {items} ELSE {plain} END, lambda x: {one}), lambda x: x <> '')"


def mapping(names: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in names.items()) + "}"


def allergen_list(x: str, dialect: str) -> str:
    tags = tag_list(x, dialect)
    if dialect.startswith("multi") or dialect == "diagnose":
        names = mapping(NAMES | {k.removesuffix("s"): v for k, v in NAMES.items()})
        bare = "rtrim(x, 's')" if dialect == "multilingual_legacy" else "regexp_replace(x, 's$', '')"
        found = f"list_transform({tags}, lambda x: coalesce({names}[x], {names}[{bare}]))"
    else:
        found = f"list_transform({tags}, lambda x: {mapping(TAGS[dialect])}[x])"
    return f"list_sort(list_distinct(list_filter({found}, lambda x: x IS NOT NULL)))"


def cut() -> str:
    out = "est"
    for p in reversed(rules.ANCHORS):
        own = f"strpos(lower(fragment), {quoted(p)})"
        out = f"CASE WHEN contains(plain, {norm(quoted(p))}) THEN CASE WHEN {own} > 0 THEN greatest(est - 30, 0) + {own} - 1 ELSE est END ELSE {out} END"
    return out


def raw_in(p: str, t: str) -> str:
    """Bounded by neither letters, digits nor underscores, for a phrase of letters and single spaces; t is marked()."""
    return "(" + " OR ".join(f"contains({t}, {x} || lower({p}) || {y})" for x in ("' '", "chr(1)") for y in ("' '", "chr(1)")) + ")"


def marked(t: str) -> str:
    """Lower case, everything but letters, digits, underscores and spaces replaced by a mark, between spaces."""
    return f"' ' || regexp_replace(lower(coalesce({t}, '')), '[^{LETTER} ]', chr(1), 'g') || ' '"


RISK = "CASE WHEN len({d}) > 0 THEN 'AVOID' WHEN len({t}) > 0 THEN 'CAUTION' ELSE 'SAFE' END"
PATTERN = "(?:" + "|".join([*rules.MARKERS, rules.GAP_MARKER]) + ")"
VALID = """NOT EXISTS (SELECT 1 FROM excluded x WHERE x.allergen = h.allergen AND x.term = h.term AND contains(' ' || h.text || ' ', ' ' || x.phrase || ' '){kind})"""
KEPT = """NOT EXISTS (SELECT 1 FROM negated n WHERE n.allergen = h.allergen AND contains(' ' || h.text || ' ', ' ' || n.phrase || ' '))"""
_LINE_TEXT = "'Produkt\n' || CASE doc_id % 3 WHEN 0 THEN 'Ingredients: ' WHEN 1 THEN 'lngredients\n' ELSE '' END || coalesce(text, '') || CASE WHEN doc_id % 2 = 0 THEN '\nNutrition facts\nsalt 1 g' ELSE '' END"
_PICK = "list_extract([" + ", ".join(map(quoted, ALLERGENS)) + "], ({}) % 9 + 1)"

CTES = {
    "labels_": labels_duckdb(),
    "groups": f"SELECT col0 AS allergen, col1 AS name FROM ({values([(a, DISPLAY[a]) for a in ALLERGENS])})",
    "raw_terms": f"SELECT DISTINCT col0 AS allergen, col1 AS term FROM ({values([(a, t) for a, ts in rules.VOCABULARY.items() for t in ts])})",
    "terms": f"SELECT DISTINCT allergen, {norm('term')} AS term FROM raw_terms",
    "negated": f"SELECT col0 AS allergen, col1 AS phrase FROM ({values(rules.NEGATIONS)})",
    "excluded": f"SELECT col0 AS allergen, col1 AS term, col2 AS phrase, col3 AS kind FROM ({values(rules.exclusion_rows())})",
    "excluded_legacy": f"SELECT col0 AS allergen, col1 AS term, col2 AS phrase, col3 AS kind FROM ({values(rules.exclusion_rows(True))})",
    "whole": f"SELECT * FROM (SELECT code, 'label' AS section, {norm('text')} AS text FROM labels_) WHERE text <> ''",
    "marked": f"SELECT code, {marked('text')} AS text FROM labels_",
    "placed": f"SELECT id, code, text, CASE WHEN regexp_matches(' ' || n || ' ', ' {PATTERN} ') THEN length(regexp_extract(' ' || n || ' ', '^(.*?) {PATTERN} ', 1)) ELSE -1 END AS place FROM (SELECT id, code, text, {norm('text')} AS n FROM labels_)",
    "fragments": "SELECT *, least(place, length(text)) AS est, substring(text, (greatest(least(place, length(text)) - 30, 0) + 1)::INT, (least(length(text), least(place, length(text)) + 60) - greatest(least(place, length(text)) - 30, 0))::INT) AS fragment FROM placed",
    "cuts": f"SELECT *, CASE WHEN place >= 0 THEN {cut()} END AS cut FROM (SELECT *, {norm('fragment')} AS plain FROM fragments)",
    "split": f"SELECT id, code, {strip('CASE WHEN cut IS NULL THEN text ELSE substring(text, 1, cut::INT) END')} AS declared_text, {strip('''CASE WHEN cut IS NULL THEN '' ELSE substring(text, cut::INT + 1, length(text)::INT) END''')} AS trace_text FROM cuts",
    "sections": f"SELECT * FROM (SELECT code, 'declared' AS section, {norm('declared_text')} AS text FROM split UNION ALL SELECT code, 'trace', {norm('trace_text')} FROM split) WHERE text <> ''",
    "hits": "SELECT s.code, s.section, s.text, t.allergen, t.term FROM sections s JOIN terms t ON contains(' ' || s.text || ' ', ' ' || t.term || ' ')",
    "whole_hits": "SELECT s.code, s.section, s.text, t.allergen, t.term FROM whole s JOIN terms t ON contains(' ' || s.text || ' ', ' ' || t.term || ' ')",
    "valid": f"SELECT * FROM hits h WHERE {KEPT} AND {VALID.format(kind='')}",
    "best": "SELECT code, section, allergen, arg_min(term, (-length(term), term)) AS matched_term FROM valid GROUP BY ALL",
    "found": "SELECT code, section, list_sort(list(allergen)) AS allergens, list(matched_term ORDER BY allergen) AS found_terms FROM best GROUP BY ALL",
    "evaluated": f"""SELECT l.id, l.code, l.lang, l.source, l.text, {allergen_list('allergens_tags', 'eval')} AS ref_declared, {allergen_list('traces_tags', 'eval')} AS ref_trace,
        coalesce(d.allergens, []) AS pred_declared, coalesce(t.allergens, []) AS pred_trace, coalesce(d.found_terms, []) AS declared_terms, coalesce(t.found_terms, []) AS trace_terms
        FROM labels_ l LEFT JOIN found d ON d.code = l.code AND d.section = 'declared' LEFT JOIN found t ON t.code = l.code AND t.section = 'trace'""",
    "plain_found": "SELECT code, list_sort(list_distinct(list(allergen))) AS p FROM hits WHERE section = 'declared' GROUP BY code",
    "plain": "SELECT e.* EXCLUDE (pred_declared), coalesce(p, []) AS pred_declared FROM evaluated e LEFT JOIN plain_found USING (code)",
    "classes": "SELECT *, CASE WHEN ref_declared = pred_declared THEN 'exact' WHEN len(pred_declared) = 0 THEN 'false_negative' WHEN len(ref_declared) = 0 THEN 'false_positive' WHEN list_has_any(ref_declared, pred_declared) THEN 'partial' ELSE 'mismatch' END AS class FROM evaluated",
    "common": f"SELECT raw, {norm('raw')} AS term FROM (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '[ \\n]')) AS raw FROM documents)",
    "corpus_raw": "SELECT 'g' || (length(term) % 9) AS allergen, raw, term FROM common WHERE term <> ''",
    "corpus": "SELECT DISTINCT allergen, term FROM corpus_raw",
    "prose": f"SELECT * FROM (SELECT doc_id::VARCHAR AS code, {norm('text')} AS text FROM documents) WHERE text <> ''",
    "words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM prose) WHERE length(word) >= 3 GROUP BY word",
    # DuckDB's levenshtein counts bytes: letters beyond ASCII become capitals, which these words don't have
    "single": "SELECT word, n, translate(word, 'ßøđłþðıħŋ', 'ABCDEFGHI') AS plain FROM words",
    "scans": "SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'SAFE' WHEN 'view' THEN 'CAUTION' WHEN 'error' THEN 'AVOID' WHEN 'purchase' THEN 'UNKNOWN' ELSE 'SAFE' END AS verdict FROM events",
    "profile_rows": """SELECT user_id, list_filter(CASE WHEN user_id % 6 = 0 THEN [] WHEN user_id % 2 = 0 THEN [one, two] WHEN user_id % 5 = 0 THEN [one, two, 'kiwi'] ELSE [one, two] END, lambda x: x <> '') AS entries
        FROM (SELECT c_custkey AS user_id, list_extract(a, c_nationkey % 9 + 1) AS one, list_extract(a, (c_custkey * 5 + 1) % 9 + 1) AS two FROM customer, (SELECT ['milk', 'gluten', 'peanuts', 'tree nuts', 'soy', 'eggs', 'fish', 'other', 'sesame'] AS a))""",
    "profiles": f"SELECT user_id, list_filter(list_transform(entries, lambda x: {mapping({k.replace('_', ' '): v for k, v in ALIASES.items()})}[x]), lambda x: x IS NOT NULL) AS mapped, list_filter(entries, lambda x: x = 'kiwi') AS unsupported FROM profile_rows",
    "people": "SELECT user_id, list_filter(mapped, lambda x, i: list_position(mapped, x) = i) AS allergies, unsupported FROM profiles",
    "personal": "SELECT s.event_id, p.allergies, e.pred_declared, e.pred_trace FROM events s JOIN people p USING (user_id) JOIN evaluated e ON e.id = s.event_id % (SELECT count(*) FROM documents)",
    "lines": f"SELECT doc_id AS image_id, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS text FROM (SELECT doc_id, string_split({_LINE_TEXT}, '\n') AS ls FROM documents)",
    "headed": f"SELECT *, {norm_heading('text')} AS h FROM lines",
    "fuzzy": "SELECT image_id, line_no, text, h, len(ws) <= 2 AND len(list_filter(ws, lambda w: " + " OR ".join(f"1 - levenshtein(w, '{t}')::DOUBLE / greatest(length(w), {len(t)}) >= CASE WHEN length(w) <= 8 THEN 0.85 ELSE 0.8 END" for t in ("ingredients", "ingredient", "zutaten", "ingredientes", "ingredienti")) + ")) > 0 AS near FROM (SELECT *, list_filter(string_split(h, ' '), lambda w: length(w) >= 5) AS ws FROM headed)",
    "headings": r"SELECT image_id, min(line_no) AS heading FROM fuzzy WHERE near OR contains(h, 'ingredien') OR regexp_matches(h, '^(ingredient|ingredients|zutaten|ingredientes|ingredienti)\b') GROUP BY image_id",
    "run_lines": "SELECT *, CASE WHEN line_no = heading THEN regexp_replace(text, '^[^:]*:? *', '') ELSE text END AS own, (line_no > heading AND (" + " OR ".join(f"starts_with(h, '{s}')" for s in ("nutrition", "nahrwerte", "valeurs nutritionnelles", "storage", "informacion nutricional")) + "))::INT AS stop FROM headed JOIN headings USING (image_id) WHERE line_no >= heading",
    "ended": "SELECT *, max(stop) OVER (PARTITION BY image_id ORDER BY line_no) AS ended FROM run_lines",
    "summed": "SELECT *, coalesce(sum(length(own) + 1) OVER (PARTITION BY image_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ended WHERE ended = 0 OR stop = 1",
    "ingredient": "SELECT image_id, trim(coalesce(string_agg(own, ' ' ORDER BY line_no) FILTER (ended = 0 AND before < 1500), '')) AS section, max(ended) = 1 OR coalesce(sum(length(own) + 1) FILTER (ended = 0), 0) <= 1500 AS found FROM summed GROUP BY image_id",
    # every line in pieces of PIECE words: as words are only dropped or lengthened, the distances of the pieces add up to that of the whole
    "piece_words": f"SELECT image_id, lang, k, list_slice(ws, k + 1, k + {PIECE}) AS part FROM (SELECT image_id, lang, ws, unnest(range(0, len(ws), {PIECE})) AS k FROM (SELECT doc_id AS image_id, lang, string_split(unnest(string_split(coalesce(text, ''), chr(10))), ' ') AS ws FROM documents))",
    "pairs": "SELECT image_id, lang, array_to_string(part, ' ') AS reference, array_to_string(list_filter(list_transform(part, lambda w, i: CASE WHEN (k + i - 1 + image_id) % 3 <> 0 THEN w WHEN image_id % 2 = 0 THEN w || 'x' END), lambda w: w IS NOT NULL), ' ') AS predicted FROM piece_words",
    "normed": f"SELECT image_id, lang, {norm_ocr('reference')} AS r, {norm_ocr('predicted')} AS p FROM pairs",
    "ended_pairs": "SELECT image_id, lang, CASE WHEN r = '' THEN '' ELSE r || ' ' END AS r, CASE WHEN p = '' THEN '' ELSE p || ' ' END AS p FROM normed",
    # DuckDB's levenshtein counts bytes: each distinct character or word of a pair becomes one byte
    "coded": "SELECT *, list_distinct(string_split(r || p, '')) AS cs, list_distinct(list_concat(rw, pw)) AS ws FROM (SELECT *, list_filter(string_split(r, ' '), lambda w: w <> '') AS rw, list_filter(string_split(p, ' '), lambda w: w <> '') AS pw FROM ended_pairs)",
    "distances": "SELECT image_id, lang, r, p, rw, levenshtein("
    + ", ".join(f"array_to_string(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: chr(20 + list_position(cs, c)::INT)), '')" for x in "rp")
    + ") AS d, levenshtein("
    + ", ".join(f"array_to_string(list_transform({x}w, lambda w: chr(20 + list_position(ws, w)::INT)), '')" for x in "rp")
    + ") AS wd FROM coded",
    "summed_pairs": "SELECT image_id, lang, sum(d)::DOUBLE AS d, sum(length(r))::DOUBLE AS n, max((p <> '')::INT)::DOUBLE AS said, sum(wd)::DOUBLE AS wd, sum(len(rw))::DOUBLE AS wn FROM distances GROUP BY ALL",
    "rates": "SELECT image_id, lang, CASE WHEN n = 0 THEN said ELSE (d - CASE WHEN said > 0 THEN 0 ELSE 1 END) / (n - 1) END AS cer, CASE WHEN n = 0 THEN said ELSE wd / wn END AS wer FROM summed_pairs",
    "flagged": f"SELECT id, code, len(ref_declared) > 0 AS has_declared, len(ref_trace) > 0 AS has_trace, len(ref_declared) >= 2 OR len(ref_trace) >= 2 AS multi, {' OR '.join(f'''contains(' ' || {norm('text')} || ' ', ' {p} ')''' for p in ('gluten free', 'almond milk', 'no milk'))} AS context FROM evaluated",
    "stratified": "SELECT *, CASE WHEN multi THEN 'multi' WHEN has_trace AND NOT has_declared THEN 'trace_only' WHEN has_declared THEN 'declared' WHEN context THEN 'context' ELSE 'plain' END AS stratum FROM flagged",
    "quota": f"SELECT id, stratum, rank FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY (id * 48271 + 42) % 2147483647, id) AS rank FROM stratified JOIN (SELECT col0 AS stratum, col1 AS quota FROM ({values([('multi', 30), ('trace_only', 10), ('declared', 20), ('context', 10), ('plain', 10)])})) USING (stratum)) WHERE rank <= quota",
    "members": "SELECT id, unnest(list_concat(list_transform(ref_declared, lambda a: 'allergen:' || a), list_filter([CASE WHEN len(ref_trace) > 0 THEN 'trace' WHEN len(ref_declared) = 0 THEN 'control' END, CASE WHEN lang IN ('de', 'fr') THEN 'lang:' || lang END], lambda x: x IS NOT NULL))) AS stratum FROM evaluated",
    "missed": f"SELECT code, lang, {norm('text')} AS text, unnest(list_filter(ref_declared, lambda x: NOT list_contains(pred_declared, x))) AS allergen FROM evaluated",
    "causes": "SELECT code, lang, allergen, CASE WHEN text = '' THEN 'no_text' WHEN m AND t THEN 'marker_and_term' WHEN t THEN 'term_only' WHEN m THEN 'marker_only' ELSE 'no_evidence' END AS cause FROM (SELECT *, "
    + " OR ".join(f"contains(text, '{m}')" for m in ("contain", "contenir", "enthalten", "contener", "trace"))
    + " AS m, EXISTS (SELECT 1 FROM terms v WHERE v.allergen = s.allergen AND contains(s.text, v.term)) AS t FROM missed s)",
    "methods": f"""SELECT e.code, m.method, e.ref_declared, coalesce(p, []) AS pred FROM evaluated e CROSS JOIN (SELECT unnest(['raw', 'keyword', 'negation', 'context', 'full']) AS method) m LEFT JOIN (
        SELECT code, method, list_sort(list_distinct(list(allergen))) AS p FROM (
          SELECT code, allergen, 'keyword' AS method FROM whole_hits UNION ALL SELECT code, allergen, 'negation' FROM whole_hits h WHERE {KEPT}
          UNION ALL SELECT code, allergen, 'context' FROM whole_hits h WHERE {VALID.format(kind='')} UNION ALL SELECT code, allergen, 'full' FROM whole_hits h WHERE {KEPT} AND {VALID.format(kind='')}
          UNION ALL SELECT code, allergen, 'raw' FROM marked JOIN raw_terms ON {raw_in('term', 'text')}) GROUP BY ALL) f ON f.code = e.code AND f.method = m.method""",
    "versions": f"{metrics('version', '''(SELECT 'before' AS version, ref_declared, pred_declared FROM plain UNION ALL SELECT 'after', ref_declared, pred_declared FROM evaluated)''', 'ref_declared', 'pred_declared').replace('round(', '(').replace(', 6)', ')')}",
    "deltas": "SELECT metric, max(value) FILTER (version = 'before') AS before, max(value) FILTER (version = 'after') AS after FROM (UNPIVOT (SELECT version, precision, recall, f1 FROM versions) ON precision, recall, f1 INTO NAME metric VALUE value) GROUP BY metric",
    "phrases": "SELECT (vec_id % 200)::VARCHAR AS code, vec_id AS pos, 'phrase ' || vec_id AS phrase, embedding AS vector FROM embeddings WHERE vec_id % 10 <> 0 OR vec_id >= 3000",
    "term_rows": f"SELECT {_PICK.format('abs(label)')} AS allergen, 'term ' || vec_id AS term, embedding AS vector FROM embeddings WHERE vec_id % 10 = 0 AND vec_id < 3000",
    "sims": "SELECT p.code, p.pos, p.phrase, t.allergen, t.term, round(list_inner_product(p.vector::DOUBLE[], t.vector::DOUBLE[]), 9) AS s FROM phrases p, term_rows t",
    "near": "SELECT code, pos, phrase, allergen, arg_min(term, (-s, term)) AS term, max(s) AS s FROM sims GROUP BY ALL",
    "rule_hits": f"SELECT DISTINCT code, {_PICK.format('pos')} AS allergen FROM phrases WHERE pos % 3 = 0",
    "vector_sets": f"SELECT code, ref, coalesce(p, []) AS pred FROM (SELECT code, list_sort(list_distinct(list({_PICK.format('pos % 7')}))) AS ref FROM phrases GROUP BY code) LEFT JOIN (SELECT code, list_sort(list(allergen)) AS p FROM rule_hits GROUP BY code) USING (code)",
    "gained": "SELECT code, allergen, max(s) AS s FROM near GROUP BY ALL",
    "swept": "SELECT v.code, v.ref, b.bar, list_distinct(list_concat(v.pred, coalesce((SELECT list(allergen) FROM gained g WHERE g.code = v.code AND g.s >= b.bar), []))) AS pred FROM vector_sets v, (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS bar) b",
    "vector_sets2": f"SELECT code, ref, coalesce(p, []) AS pred FROM (SELECT code, list_sort(list_distinct(list({_PICK.format('pos % 5')}))) AS ref FROM phrases GROUP BY code) LEFT JOIN (SELECT code, list_sort(list(allergen)) AS p FROM rule_hits GROUP BY code) USING (code)",
    "swept2": "SELECT v.code, v.ref, b.bar, list_distinct(list_concat(v.pred, coalesce((SELECT list(allergen) FROM gained g WHERE g.code = v.code AND g.s >= b.bar), []))) AS pred FROM vector_sets2 v, (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS bar) b",
    "scores": "SELECT doc_id, quality AS y, ((doc_id * 37 % 100)::DOUBLE / 100.0 * 0.6::DOUBLE + quality * 0.3::DOUBLE) AS p, (doc_id % 97)::DOUBLE / 97.0 AS x FROM labels WHERE quality IS NOT NULL",
    "ranked": "SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, count(*) OVER (PARTITION BY p) AS tp, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx FROM scores",
    "u_test": "SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(rp) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0 AS u, sum(tp * tp - 1)::DOUBLE AS ties FROM ranked",
}
# the matcher's expressions again over the spoilt texts
_CHAIN = ("labels_", "placed", "fragments", "cuts", "split", "sections", "hits", "valid", "best", "found")
_SPOILT = "array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1 + id) % 3 <> 0 THEN w ELSE w || 'x' END), ' ')"
CTES |= {"o_labels_": f"SELECT id, code, {_SPOILT} AS text FROM labels_"} | {f"o_{k}": re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"o_\1", CTES[k]) for k in _CHAIN[1:]}
CTES["ocr_sets"] = f"""SELECT e.code, e.ref_declared, e.ref_trace, e.pred_declared AS clean_declared, e.pred_trace AS clean_trace, coalesce(d.allergens, []) AS ocr_declared, coalesce(t.allergens, []) AS ocr_trace
    FROM evaluated e LEFT JOIN o_found d ON d.code = e.code AND d.section = 'declared' LEFT JOIN o_found t ON t.code = e.code AND t.section = 'trace'"""
_MATERIAL = {"o_labels_", "o_sections", "o_hits", "o_valid", "o_found", "ocr_sets", "labels_", "marked", "sections", "hits", "whole", "whole_hits", "valid", "found", "evaluated", "prose", "common", "near", "swept", "normed", "methods"}


def _with(sql: str) -> str:
    """sql with the expressions before it that it and they name."""
    needed, text = [], sql
    for k, v in reversed(CTES.items()):
        if re.search(rf"\b{k}\b", text):
            needed.append(f"{k} AS {'MATERIALIZED ' if k in _MATERIAL else ''}({v})")
            text += " " + v
    return f"WITH {', '.join(reversed(needed))} {sql}" if needed else sql


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = _with(sql)


def bar(x: str) -> str:
    return f"array_to_string({x}, '|')"


oracle("src1_read_products", "SELECT code, source AS product_name, length(nullif(text, ''))::INT AS n_chars, md5(nullif(text, '')) AS digest, lang FROM labels_")
oracle("src2_read_vocabulary", f"SELECT DISTINCT {_PICK.replace('% 9', '% 10').format('length(term)')} AS allergen, {norm('raw')} AS term FROM corpus_raw WHERE length(term) % 10 <> 9")
oracle("src3_union_vocab", "SELECT allergen, term FROM corpus")
oracle("src4_raw_vocabulary", "SELECT DISTINCT allergen, raw AS term FROM corpus_raw")
oracle("src5_require_columns", "SELECT code, lang FROM labels_")
oracle("src6_backfill", "SELECT code, CASE WHEN id % 4 = 0 THEN 'pending' ELSE lang END AS status, '' AS notes FROM labels_")
oracle("snk1_write_results", f"SELECT code, {bar('ref_declared')} AS ref_declared, {bar('pred_declared')} AS pred_declared FROM evaluated")
oracle("snk2_publish", "SELECT code, lang FROM labels_")
oracle("snk3_summary_report", f"SELECT '{{\"tp\":' || tp || ',\"fp\":' || fp || ',\"fn\":' || fn || '}}' AS report FROM ({metrics('', 'evaluated', 'ref_declared', 'pred_declared')})")
oracle("cur1_dedup_first", "SELECT code, lang, source, id * 2 AS seq FROM labels_")
oracle("cur2_drop_unusable", "SELECT code, nullif(traces_tags, ',') AS traces FROM labels_ WHERE text <> '' OR traces_tags <> ','")
oracle("cur3_null_report", "SELECT 'code' AS \"column\", 0::BIGINT AS n_null UNION ALL SELECT 'text', count(*) FILTER (text = '') FROM labels_ UNION ALL SELECT 'traces', count(*) FILTER (traces_tags = ',') FROM labels_")
oracle("cur4_with_text", "SELECT code, lang FROM labels_ WHERE trim(text) <> ''")
oracle("cur5_ingest_new", "SELECT code, lang, id AS seq FROM labels_ WHERE id % 3 = 0 AND id % 2 = 1 ORDER BY id LIMIT 20")
oracle("cur6_merge_keep_existing", "SELECT code, CASE WHEN id % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM labels_ WHERE id % 2 = 0 OR id % 3 = 0")
oracle("cur7_exclude_codes", "SELECT code, lang FROM labels_ WHERE id % 4 <> 0")
oracle("cur8_clean_keys", "SELECT '00' || code AS code, lang FROM labels_")
_EDITED = "SELECT code, CASE WHEN (id % 3 = 0 AND id % 9 = 0) OR (id % 3 <> 0 AND id % 2 = 1) THEN 'pending' ELSE 'complete' END AS status, CASE WHEN id % 9 = 0 THEN ' ' WHEN id % 3 = 0 THEN upper(source) WHEN id % 2 = 0 THEN source ELSE '' END AS transcription FROM labels_"
oracle("cur9_apply_annotations", _EDITED)
oracle("cur10_completed_only", f"SELECT count(*) AS kept FROM ({_EDITED}) WHERE status = 'complete'")
oracle("txt1_normalize", f"SELECT code, md5({norm('text')}) AS digest FROM labels_")
oracle("txt2_normalize_legacy", f"SELECT code, md5({norm('text', '_')}) AS digest FROM labels_")
oracle("txt3_normalize_latin", "SELECT code, trim(regexp_replace(lower(source || ' - x_' || lang), '[^a-z0-9]+', ' ', 'g')) AS tag FROM labels_")
oracle("txt4_normalize_ocr", f"SELECT code, md5({norm_ocr('text')}) AS digest FROM labels_")
oracle("txt5_normalize_heading", f"SELECT code, md5({norm_heading('text')}) AS digest FROM labels_")
_CLEAN = strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ([,.;:)])', '\1', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
oracle("txt13_clean_ocr_text", f"SELECT code, md5({_CLEAN}) AS digest FROM labels_")
oracle("txt6_phrase_in", "SELECT code, contains(' ' || text || ' ', ' milk powder ') AS a, contains(' ' || text || ' ', ' the ') AS b FROM whole")
oracle("txt7_any_phrase", "SELECT code, contains(' ' || text || ' ', ' almond milk ') OR contains(' ' || text || ' ', ' may contain ') OR contains(' ' || text || ' ', ' of the ') AS \"any\" FROM whole")
oracle("txt8_raw_phrase_in", "SELECT code, " + ", ".join(f"{raw_in(quoted(p), 'text')} AS {n}" for p, n in (("Milk", "a"), ("soja", "b"), ("œufs", "c"))) + f" FROM (SELECT code, {marked('text')} AS text FROM labels_)")
_DIALECTS = ("multilingual", "multilingual_legacy", "eval", "ocr", "sampling", "collect", "diagnose")
oracle("txt9_parse_tags", "SELECT code, " + ", ".join(f"{bar(tag_list('allergens_tags', d))} AS {d}" for d in _DIALECTS) + " FROM labels_")
oracle("txt10_tags_to_allergens", "SELECT code, " + ", ".join(f"{bar(allergen_list('allergens_tags', d))} AS {d}" for d in _DIALECTS) + " FROM labels_")
_PHRASES = f"list_filter(list_transform(string_split_regex(text, '[,;،؛]'), lambda x: {norm('x')}), lambda x: length(x) >= 3 AND contains(x, ' '))"
oracle("txt11_ingredient_phrases", f"SELECT code, md5({bar(_PHRASES)}) AS digest, len({_PHRASES})::BIGINT AS n FROM labels_")
_CLAUSES = f"list_filter(list_transform(string_split_regex({{}}, '[.;]'), lambda x: {strip('x')}), lambda x: length(x) >= 3)"
oracle("txt12_clauses", f"SELECT code, md5({bar(_CLAUSES.format('text'))}) AS digest, len({_CLAUSES.format('text')})::BIGINT AS n FROM labels_")
oracle("txt14_parse_profile", f"SELECT user_id, {bar('allergies')} AS allergens, {bar('unsupported')} AS unsupported FROM people")
_SET = f"list_sort(list_distinct(list_filter(list_transform(string_split({{}}, ','), lambda x: {strip('x')}), lambda x: x <> '')))"
oracle("txt15_parse_set", f"SELECT code, {bar(_SET.format('allergens_tags'))} AS \"all\", {bar('list_filter(' + _SET.format('traces_tags') + ''', lambda x: x IN ('en:milk', 'en:nuts'))''')} AS some FROM labels_")
oracle("mat1_trace_start", "SELECT code, place AS \"at\" FROM placed JOIN whole USING (code)")
oracle("mat2_split_declared_trace", "SELECT code, md5(declared_text) AS declared, trace_text FROM split")
_HIT = "SELECT code, section, allergen, term FROM hits h"
oracle("mat3_vocab_hits", _HIT)
oracle("mat4_drop_negated", f"{_HIT} WHERE {KEPT}")
for _n, _k in ((5, "nut butter"), (6, "plant milk"), (7, "cocoa butter"), (8, "coconut"), (9, "gluten free")):
    oracle(f"mat{_n}_exclude_{_k.replace(' ', '_')}", f"{_HIT} WHERE {VALID.format(kind=f' AND x.kind = {quoted(_k)}')}")
oracle("mat10_best_term", "SELECT code, section, allergen, matched_term FROM best")
oracle("mat11_detect", f"SELECT code, section, {bar('allergens')} AS allergens, {bar('found_terms')} AS terms FROM found")
_RISK = RISK.format(d="pred_declared", t="pred_trace")
_JUDGED = f"{bar('pred_declared')} AS declared, {bar('pred_trace')} AS trace, {_RISK} AS risk FROM evaluated"
oracle("mat12_analyze", f"SELECT code, {_JUDGED} UNION ALL SELECT NULL, {_JUDGED} WHERE id % 10 = 0 UNION ALL SELECT (id - 3)::VARCHAR, {_JUDGED} WHERE id % 7 = 3")
oracle("mat13_analyze_products", f"SELECT code, {bar('pred_declared')} AS declared, {bar('ref_declared')} AS reference_declared, {bar('ref_trace')} AS reference_trace FROM evaluated")
_ALL = "list_sort(list_distinct(list(allergen)))"
oracle("mat14_detect_legacy", f"SELECT code, section, {bar(_ALL)} AS allergens FROM hits h WHERE {KEPT} AND {VALID.format(kind='').replace('excluded x', 'excluded_legacy x')} GROUP BY code, section")
oracle(
    "mat15_diagnose_tags",
    f"""SELECT CASE WHEN g.allergen IS NULL THEN 'unsupported' WHEN f.allergen IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS status, tag, count(*) AS n
      FROM (SELECT code, tag, {allergen_list('tag', 'diagnose')}[1] AS allergen FROM (SELECT code, unnest(list_distinct({tag_list('allergens_tags', 'diagnose')})) AS tag FROM labels_)) g
      LEFT JOIN (SELECT DISTINCT code, allergen FROM whole_hits h WHERE {KEPT} AND {VALID.format(kind='')}) f ON f.code = g.code AND f.allergen = g.allergen GROUP BY ALL""",
)
for _name, _terms in (("mat16_baseline_raw", "raw_terms"), ("mat17_baseline_raw_normalized_vocab", "terms")):
    oracle(_name, f"SELECT code, {bar(_ALL)} AS allergens FROM marked JOIN {_terms} ON {raw_in('term', 'text')} GROUP BY code")
oracle("mat18_baseline_substring", f"SELECT code, method, {bar(_ALL)} AS allergens FROM (SELECT code, 'lower' AS method, lower(text) AS t FROM labels_ UNION ALL SELECT code, 'normalized', {norm('text')} FROM labels_) JOIN terms ON contains(t, term) GROUP BY code, method")
for _name, _where in (("mat19_baseline_normalized", "true"), ("mat20_normalized_negation", KEPT), ("mat21_normalized_context", VALID.format(kind=""))):
    oracle(_name, f"SELECT code, {bar(_ALL)} AS allergens FROM whole_hits h WHERE {_where} GROUP BY code")
oracle("entry", f"SELECT {_RISK} AS risk, lang, count(*) AS n FROM evaluated GROUP BY ALL")
oracle("rsk1_general_risk", f"SELECT code, {RISK.format(d='ref_declared', t='ref_trace')} AS risk FROM evaluated")
oracle("rsk2_extraction_status", "SELECT code, CASE WHEN trim(text) = '' THEN 'no_text' WHEN id % 5 = 0 THEN 'section_not_found' WHEN id % 3 = 0 THEN 'section_empty' ELSE 'ok' END AS status FROM labels_")
oracle("rsk3_personal_risk", f"SELECT event_id, CASE WHEN len(allergies) = 0 THEN {_RISK} WHEN list_has_any(allergies, pred_declared) THEN 'AVOID' WHEN list_has_any(allergies, pred_trace) THEN 'CAUTION' ELSE 'SAFE' END AS risk FROM personal")
_NAMES = mapping(DISPLAY)
oracle("rsk4_relevant", f"SELECT event_id, {bar(f'list_transform(CASE WHEN len(allergies) = 0 THEN pred_declared ELSE list_filter(pred_declared, lambda x: list_contains(allergies, x)) END, lambda a: {_NAMES}[a])')} AS relevant FROM personal")

def _why(a: str, t: str, end: str) -> str:
    return f"list_transform(list_zip({a}, {t}), lambda z: {_NAMES}[z[1]] || ' {end}: ''' || z[2] || '''.')"


_D, _T = _why("pred_declared", "declared_terms", "is listed as an ingredient"), _why("pred_trace", "trace_terms", "is named in a precautionary statement")
oracle("rsk5_explain", f"SELECT code, {bar(_D)} AS declared, {bar(_T)} AS trace FROM evaluated")
_JSON = lambda xs: "'[' || array_to_string(list_transform(" + xs + ", lambda x: '\"' || x || '\"'), ',') || ']'"
oracle("rsk6_response", f"""SELECT code, '{{"code":"' || code || '","risk":"' || {_RISK} || '","declared_allergens":' || {_JSON('pred_declared')} || ',"trace_allergens":' || {_JSON('pred_trace')} || ',"declared_names":' || {_JSON(f'list_transform(pred_declared, lambda a: {_NAMES}[a])')} || ',"declared_why":' || {_JSON(_D)} || ',"trace_why":' || {_JSON(_T)} || '}}' AS response FROM evaluated""")
oracle("rsk7_allergens", "SELECT allergen, name, coalesce(n, 0) AS n FROM groups LEFT JOIN (SELECT unnest(ref_declared) AS allergen, count(*) AS n FROM evaluated GROUP BY 1) USING (allergen)")
_V = "SELECT coalesce(nullif(verdict, 'UNKNOWN'), CASE WHEN event_id % 2 = 0 THEN 'SAFE' END, 'UNKNOWN') AS verdict FROM scans"
oracle("rsk8_history_counts", f"SELECT verdict, count(*) AS n FROM ({_V}) GROUP BY verdict UNION ALL SELECT 'all', count(*) FROM scans")
_TAGGED = f"(SELECT code, {tag_list('allergens_tags', 'eval')} AS tags FROM labels_)"
oracle("agg1_tag_counts", f"SELECT unnest(tags) AS tag, count(*) AS n FROM {_TAGGED} GROUP BY 1")
oracle("agg2_top_tags", "SELECT tag, n FROM (SELECT unnest(string_split(text, ' ')) AS tag, count(*) AS n FROM prose GROUP BY 1) ORDER BY n DESC, tag LIMIT 30")
oracle("agg3_dataset_summary", f"SELECT count(*) AS rows, count(*) FILTER (len(tags) > 0) AS with_tags, sum(len(tags))::BIGINT AS tags, (SELECT count(DISTINCT u) FROM (SELECT unnest(tags) AS u FROM {_TAGGED})) AS distinct_tags FROM {_TAGGED}")
oracle("agg4_risk_distribution", f"SELECT level, coalesce(n, 0) AS n FROM (SELECT unnest(['SAFE', 'CAUTION', 'AVOID', 'UNKNOWN']) AS level) LEFT JOIN (SELECT {_RISK} AS level, count(*) AS n FROM evaluated GROUP BY 1) USING (level)")
oracle("agg5_language_counts", "SELECT CASE WHEN id % 9 = 0 THEN 'unknown' ELSE lang END AS lang, count(*) AS n FROM labels_ GROUP BY 1")
oracle("agg6_status_counts", "SELECT event_type AS status, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share, round((SELECT count(*) FROM events WHERE event_type = 'click')::DOUBLE / (SELECT count(*) FROM events), 6) AS success_rate FROM events GROUP BY 1")
oracle("agg7_coverage", "SELECT allergen, count(*) FILTER (c = 1) AS ref_declared, count(*) FILTER (c = 2) AS ref_trace FROM (SELECT 1 AS c, unnest(ref_declared) AS allergen FROM evaluated UNION ALL SELECT 2, unnest(ref_trace) FROM evaluated) GROUP BY allergen")
oracle("evl1_micro_metrics", metrics("lang", "evaluated", "ref_declared", "pred_declared"))
oracle("evl2_exact_agreement", "SELECT lang, count(*) AS n, round(avg((ref_declared = pred_declared)::INT), 6) AS exact FROM evaluated GROUP BY lang")
oracle("evl3_per_label_metrics", label_metrics("", "evaluated", "ref_declared", "pred_declared", True))
oracle("evl4_error_class", "SELECT code, class FROM classes")
_DIFF = "SELECT 'missed' AS kind, unnest(list_filter(ref_declared, lambda x: NOT list_contains(pred_declared, x))) AS allergen FROM evaluated UNION ALL SELECT 'extra', unnest(list_filter(pred_declared, lambda x: NOT list_contains(ref_declared, x))) FROM evaluated UNION ALL SELECT 'correct', unnest(list_intersect(ref_declared, pred_declared)) FROM evaluated"
oracle("evl5_set_diffs", f"SELECT kind, allergen, count(*) AS n FROM ({_DIFF}) GROUP BY ALL")
oracle("evl6_class_shares", "SELECT class, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM classes), 6) AS percent FROM classes GROUP BY class")
_EXTRA, _MISS = (f"(len(list_filter({a}_declared, lambda x: NOT list_contains({b}_declared, x))) > 0 OR len(list_filter({a}_trace, lambda x: NOT list_contains({b}_trace, x))) > 0)" for a, b in (("pred", "ref"), ("ref", "pred")))
oracle("evl7_two_section_status", f"SELECT code, CASE WHEN {_EXTRA} AND {_MISS} THEN 'mismatch' WHEN {_EXTRA} THEN 'false_positive' WHEN {_MISS} THEN 'false_negative' ELSE 'exact' END AS status FROM evaluated")
oracle("evl8_risk_accuracy", f"SELECT lang, count(*) AS n, round(avg(({RISK.format(d='ref_declared', t='ref_trace')} = {_RISK})::INT), 6) AS accuracy FROM evaluated GROUP BY lang")
oracle("evl9_compare_methods", label_metrics("method", "methods", "ref_declared", "pred", False))
oracle("evl10_ablation", f"SELECT * FROM ({metrics('method', 'methods', 'ref_declared', 'pred')}) JOIN (SELECT method, round(avg((ref_declared = pred)::INT), 6) AS exact FROM methods GROUP BY method) USING (method)")
_ONLY = "list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
_A, _B = _ONLY.format(a="ref_declared", b="pred_declared"), _ONLY.format(a="pred_declared", b="ref_declared")
oracle("evl11_disagreements", f"SELECT code, {bar(_A)} AS metadata_only, {bar(_B)} AS text_only FROM evaluated WHERE len({_A}) > 0 OR len({_B}) > 0 ORDER BY code LIMIT 50")
oracle("evl12_metric_deltas", "SELECT metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS delta FROM deltas")
_G, _L = _ONLY.format(a="e.pred_declared", b="p.pred_declared"), _ONLY.format(a="p.pred_declared", b="e.pred_declared")
oracle("evl13_changed_predictions", f"SELECT e.code, {bar(_G)} AS gained, {bar(_L)} AS lost, {bar(f'list_filter({_G}, lambda x: NOT list_contains(e.ref_declared, x))')} AS new_false_positives FROM evaluated e JOIN plain p USING (code) WHERE e.pred_declared <> p.pred_declared")
oracle("evl14_recovery", "SELECT cause, count(*) AS n, count(*) FILTER (list_contains(p.pred_declared, c.allergen)) AS recovered FROM causes c JOIN plain p USING (code) GROUP BY cause")
_M = "list_contains({}, 'milk')"
oracle("evl15_resolved_fp", f"SELECT count(*) FILTER ({_M.format('p.pred_declared')} AND NOT {_M.format('e.ref_declared')}) AS fp_before, count(*) FILTER ({_M.format('e.pred_declared')} AND NOT {_M.format('e.ref_declared')}) AS fp_after, count(*) FILTER ({_M.format('p.pred_declared')} AND NOT {_M.format('e.ref_declared')} AND NOT {_M.format('e.pred_declared')}) AS resolved FROM evaluated e JOIN plain p USING (code)")
oracle("evl16_regression", "SELECT metric, CASE WHEN round(after - before, 6) > 0 THEN 'IMPROVED' WHEN round(after - before, 6) < 0 THEN 'WORSENED' ELSE 'NO EFFECT' END AS verdict FROM deltas")
oracle("evl17_fn_causes", "SELECT code, allergen, cause FROM causes")
oracle(
    "evl18_cause_summary",
    """SELECT source, allergen, cause, n, round(100.0::DOUBLE * n / max(n) OVER (PARTITION BY source, allergen), 6) AS percent, languages, round(uncovered, 6) AS uncovered
      FROM (SELECT source, allergen, cause, count(*) AS n, count(DISTINCT lang) AS languages, avg((coalesce(lang, '') NOT IN ('en', 'fr'))::INT) AS uncovered
        FROM (SELECT *, CASE WHEN code::BIGINT % 4 = 0 THEN 'heldout' ELSE 'dev' END AS source FROM causes)
        GROUP BY GROUPING SETS ((source, cause), (source), (allergen, cause), (allergen), (cause), ()))""",
)
oracle("evl19_examples", "SELECT cause, code, allergen, rank FROM (SELECT *, row_number() OVER (PARTITION BY cause ORDER BY code, allergen) AS rank FROM causes) WHERE rank <= 4")
oracle("evl20_fn_records", f"SELECT CASE WHEN id % 4 = 0 THEN 'heldout' ELSE 'dev' END AS source, code, allergen, lang, length(text)::INT AS n_chars FROM (SELECT id, code, lang, text, unnest({_A}) AS allergen FROM evaluated)")
oracle("smp1_sampling_flags", "SELECT code, has_declared, has_trace, multi, context FROM flagged")
oracle("smp2_quota_sample", "SELECT id, stratum, rank FROM quota")
oracle("smp3_top_up", "SELECT id, 'quota' AS origin FROM quota UNION ALL SELECT * FROM (SELECT id, 'top-up' FROM labels_ WHERE id NOT IN (SELECT id FROM quota) ORDER BY (id * 48271 + 7) % 2147483647, id LIMIT greatest(0, 120 - (SELECT count(*) FROM quota)))")
oracle("smp4_strata", "SELECT id, stratum FROM members")
_TARGETS = f"(SELECT col0 AS stratum, col1 AS target FROM ({values([('allergen:sesame', 20), ('allergen:milk', 30), ('trace', 10), ('control', 15), ('lang:de', 5), ('lang:xx', 5)])}))"
oracle("smp5_attainable", f"SELECT stratum, target, coalesce(n, 0) AS available, least(target, coalesce(n, 0)) AS attainable FROM {_TARGETS} LEFT JOIN (SELECT stratum, count(DISTINCT id) AS n FROM members GROUP BY 1) USING (stratum)")
_TURNS, _DONE = [], []
for _l, _q in (("de", 10), ("en", 25), ("fr", 10), ("xx", 3)):
    _not = "".join(f" AND id NOT IN (SELECT id FROM q_{x})" for x in _DONE)
    _TURNS.append(f"q_{_l} AS (SELECT id, '{_l}' AS language, row_number() OVER (ORDER BY id % 5 DESC, (id * 48271 + 3) % 2147483647, id) AS rank, {_q} AS target FROM labels_ WHERE (lang = '{_l}'{" OR id % 3 = 0" if _l == 'en' else ''}){_not} QUALIFY rank <= {_q})")
    _DONE.append(_l)
_SHORT = f"(SELECT col0 AS language, col1 AS target FROM ({values([('de', 10), ('en', 25), ('fr', 10), ('xx', 3)])}))"
_ALL_TURNS = " UNION ALL ".join(f"SELECT id, language, rank FROM q_{x}" for x in _DONE)
oracle(
    "smp7_language_quota",
    f"SELECT id, language, rank, short FROM (WITH {', '.join(_TURNS)}, taken AS ({_ALL_TURNS}) SELECT t.id, q.language, t.rank, (q.target - (SELECT count(*) FROM taken x WHERE x.language = q.language))::BIGINT AS short FROM {_SHORT} q LEFT JOIN taken t ON t.language = q.language)",
)
oracle("smp8_sampling_report", "SELECT stratum, available, coalesce(sampled, 0) AS sampled FROM (SELECT stratum, count(*) AS available FROM stratified GROUP BY 1) LEFT JOIN (SELECT stratum, count(*) AS sampled FROM quota GROUP BY 1) USING (stratum)")
oracle("smp9_best_image", "SELECT code, CASE WHEN id % 3 = 0 THEN 'en' WHEN id % 3 = 1 THEN 'de' ELSE 'nl' END AS image FROM labels_")
_PASS = "SELECT image_id, unnest([1, 2]) AS pass, line_no FROM lines"
oracle("ocr1_best_pass", f"SELECT image_id, pass, round(confidence, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, pass) AS r FROM (SELECT image_id, pass, avg(((image_id * 31 + line_no * pass) % 100)::DOUBLE / 100) AS confidence FROM ({_PASS}) GROUP BY ALL)) WHERE r = 1")
_KEPT_LINES = "SELECT image_id, line_no, text, h FROM headed QUALIFY row_number() OVER (PARTITION BY image_id, h ORDER BY line_no) = 1"
oracle("ocr2_dedup_lines", f"SELECT image_id, unnest([1, 2])::INT AS pass, line_no::INT AS line_no FROM ({_KEPT_LINES})")
oracle("ocr3_image_text", f"SELECT image_id, md5(string_agg(text, chr(10) ORDER BY line_no)) AS raw_text, round(avg(((image_id * 31 + line_no) % 100)::DOUBLE / 100), 6) AS confidence, count(*) AS n_lines FROM ({_KEPT_LINES}) GROUP BY image_id")
oracle("ocr4_heading_line", "SELECT image_id, heading::BIGINT AS heading FROM headings")
oracle("ocr5_fuzzy_headings", "SELECT image_id, line_no::BIGINT AS line_no FROM fuzzy WHERE near")
oracle("ocr6_ingredient_section", "SELECT image_id, md5(section) AS section, found FROM ingredient")
oracle("ocr7_cer", "SELECT image_id, round(cer, 6) AS cer FROM rates")
oracle("ocr8_wer", "SELECT image_id, round(wer, 6) AS wer FROM rates")
_TARGETED = " UNION ALL ".join(f"SELECT '{c}' AS condition, '{s}' AS target, ref_{s} AS ref, {c}_{s} AS pred FROM ocr_sets" for c in ("ocr", "clean") for s in ("declared", "trace"))
_TARGETED += "".join(f" UNION ALL SELECT '{c}', 'risk', [{RISK.format(d='ref_declared', t='ref_trace')}], [{RISK.format(d=f'{c}_declared', t=f'{c}_trace')}] FROM ocr_sets" for c in ("ocr", "clean"))
_SCORED = metrics("condition, target", f"({_TARGETED})", "ref", "pred")
_AGREE = f"SELECT condition, target, round(avg((ref = pred)::INT), 6) AS exact FROM ({_TARGETED}) GROUP BY condition, target"
oracle("ocr9_ocr_vs_clean", f"SELECT s.condition, s.target, s.tp, s.fp, s.fn, s.precision, s.recall, s.f1, a.exact FROM ({_SCORED}) s JOIN ({_AGREE}) a ON a.condition = s.condition AND a.target = s.target")
oracle("ocr10_quality_by", "SELECT lang, count(*) AS n, round(avg(cer), 6) AS cer, round(avg(wer), 6) AS wer FROM rates GROUP BY lang")
oracle("ocr11_worst", "SELECT image_id, round(cer, 6) AS cer FROM rates ORDER BY round(cer, 6) DESC, image_id LIMIT 10")
_IN = "list_contains({}, allergen)"
_R, _O, _C = (_IN.format(x) for x in ("ref", "ocr", "clean"))
_ORIGINS = " UNION ALL ".join(f"SELECT '{s}' AS section, ref_{s} AS ref, ocr_{s} AS ocr, clean_{s} AS clean FROM ocr_sets" for s in ("declared", "trace"))
oracle("ocr12_error_origin", f"SELECT section, allergen, count(*) FILTER ({_R} AND NOT {_O} AND {_C}) AS ocr_fn, count(*) FILTER ({_R} AND NOT {_O} AND NOT {_C}) AS matcher_fn, count(*) FILTER (NOT {_R} AND {_O} AND NOT {_C}) AS ocr_fp, count(*) FILTER (NOT {_R} AND {_O} AND {_C}) AS matcher_fp FROM groups CROSS JOIN ({_ORIGINS}) GROUP BY section, allergen")
oracle("ocr13_extraction_failures", "SELECT code FROM labels_ LEFT JOIN ingredient ON image_id = id WHERE NOT coalesce(found, false)")
oracle("ocr14_expansion", "SELECT code, 'ok' AS quality, lang FROM labels_ WHERE id % 3 <> 0 AND id % 2 = 0")
oracle("voc1_corpus_words", "SELECT word, n FROM words")
oracle("voc2_unused_terms", "SELECT allergen, term FROM terms t WHERE NOT EXISTS (SELECT 1 FROM prose p WHERE contains(' ' || p.text || ' ', ' ' || t.term || ' '))")
oracle("voc3_duplicate_terms", "SELECT allergen, term, count(*) AS n FROM corpus_raw GROUP BY ALL HAVING count(*) > 1")
# words of up to 13 letters differ in one place at most, which leaves their first or last three letters as they are
_CLOSE = "a.word < b.word AND abs(length(a.word) - length(b.word)) <= 0.15 * greatest(length(a.word), length(b.word)) AND 1 - levenshtein(a.plain, b.plain)::DOUBLE / greatest(length(a.word), length(b.word)) >= 0.85"
_NEAR = " UNION ".join(
    f"SELECT 'g' || substring(a.word, 1, 1) AS allergen, a.word AS a, b.word AS b FROM single a JOIN single b ON substring(a.word, 1, 1) = substring(b.word, 1, 1) AND {on} AND {_CLOSE}"
    for on in ("left(a.word, 3) = left(b.word, 3)", "right(a.word, 3) = right(b.word, 3)", "length(a.word) >= 12 AND length(b.word) >= 12 AND greatest(length(a.word), length(b.word)) >= 14")
)
oracle("voc4_near_duplicates", _NEAR)
oracle("voc5_conflicts", "SELECT term, 2::BIGINT AS n FROM corpus WHERE length(term) = 3")
_KEYS = f"SELECT DISTINCT unnest(string_split({norm('text')}, ' ')) AS term FROM benchmark"
_INFLECTED = f"SELECT c.allergen, c.term, w.word, w.n FROM (SELECT 'g' || (length(term) % 9) AS allergen, term FROM ({_KEYS})) c JOIN words w ON left(w.word, 4) = left(c.term, 4) AND starts_with(w.word, c.term) AND length(w.word) - length(c.term) BETWEEN 1 AND 5 WHERE length(c.term) >= 4 AND NOT contains(c.term, ' ') AND w.word NOT IN ({_KEYS})"
oracle("voc6_inflections", _INFLECTED)
_GAPS = f"SELECT DISTINCT keyword FROM (SELECT unnest(string_split({norm('text')}, ' ')) AS keyword FROM benchmark) WHERE keyword <> '' AND keyword IN (SELECT unnest(string_split(text, ' ')) FROM prose) AND keyword NOT IN (SELECT unnest(string_split(term, ' ')) FROM terms)"
oracle("voc7_coverage_gaps", _GAPS)
_AUDIT = {
    "terms": "SELECT 1 FROM corpus",
    "duplicates": "SELECT 1 FROM corpus_raw GROUP BY allergen, term HAVING count(*) > 1",
    "near duplicates": _NEAR,
    "conflicts": "SELECT 1 FROM corpus WHERE length(term) = 3",
    "unused": "SELECT 1 FROM terms t WHERE NOT EXISTS (SELECT 1 FROM prose p WHERE contains(' ' || p.text || ' ', ' ' || t.term || ' '))",
    "inflections": _INFLECTED,
    "gaps": _GAPS,
}
oracle("voc8_audit_counts", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM ({q})" for k, q in _AUDIT.items()))
oracle("voc9_add_terms", "SELECT allergen, term FROM corpus UNION SELECT 'g1', term FROM corpus WHERE length(term) = 4")
oracle("voc10_remove_term", "SELECT allergen, term FROM corpus WHERE (term, allergen) <> (SELECT (term, allergen) FROM corpus ORDER BY term, allergen LIMIT 1)")
oracle("voc11_match_versions", f"SELECT version, code, section, {bar(_ALL)} AS allergens FROM (SELECT 'v2' AS version, * FROM valid UNION ALL SELECT 'v1', * FROM valid WHERE length(term) <> 4) GROUP BY version, code, section")
oracle("voc12_decisions", "SELECT allergen, term, CASE WHEN length(term) <= 2 THEN 'approved' WHEN length(term) >= 6 THEN 'removed' ELSE 'kept' END AS decision FROM corpus")
oracle("emb1_term_vectors", "SELECT 'milk' AS allergen, 't' || vec_id AS term, len(embedding)::BIGINT AS dim FROM embeddings WHERE length('t' || vec_id) >= 3")
oracle("emb2_similarities", "SELECT term, count(*) AS n, round(avg(s), 5) AS mean FROM sims GROUP BY term")
oracle("emb3_best_per_allergen", "SELECT pos, allergen, term, round(s, 4) AS similarity FROM near")
oracle(
    "emb4_gated_candidates",
    f"""SELECT code, allergen, arg_min(term, (pos, term)) AS term, min(pos) AS pos
      FROM (SELECT n.code, n.allergen, n.term, n.pos, n.s, coalesce(w.text, '') AS text FROM near n LEFT JOIN whole w ON w.code = n.code) h
      WHERE s >= 0.3 AND NOT EXISTS (SELECT 1 FROM rule_hits r WHERE r.code = h.code AND r.allergen = h.allergen) AND {KEPT} AND {VALID.format(kind='')} GROUP BY code, allergen""",
)
oracle("emb5_threshold_sweep", metrics("bar", "swept", "ref", "pred"))
_F1 = lambda by, source: metrics(by, source, "ref", "pred").replace("round(", "(").replace(", 6)", ")")
oracle(
    "emb6_pick_threshold",
    f"""SELECT bar, round(gain, 6) AS gain FROM (SELECT bar, min(g) AS least, sum(g) AS gain FROM (
        SELECT bar, f1 - (SELECT f1 FROM ({_F1('', 'vector_sets')})) AS g FROM ({_F1('bar', 'swept')}) UNION ALL
        SELECT bar, f1 - (SELECT f1 FROM ({_F1('', 'vector_sets2')})) AS g FROM ({_F1('bar', 'swept2')})) GROUP BY bar) WHERE least >= -0.005 ORDER BY round(gain, 9) DESC, bar LIMIT 1""",
)
oracle(
    "emb7_synonym_proposals",
    """SELECT allergen, phrase, term, round(s, 4) AS similarity, products, codes, rank FROM (SELECT *, row_number() OVER (PARTITION BY allergen ORDER BY s DESC, phrase) AS rank FROM (
        SELECT allergen, phrase, arg_min(term, (-s, term)) AS term, max(s) AS s, count(DISTINCT code) AS products, array_to_string(list_slice(list_sort(list_distinct(list(code))), 1, 5), '|') AS codes
        FROM near n WHERE s >= 0.2 AND NOT (contains(phrase, '77') OR contains(phrase, '3') OR contains(phrase, 'hrase 12')) AND NOT EXISTS (SELECT 1 FROM rule_hits r WHERE r.code = n.code AND r.allergen = n.allergen) GROUP BY allergen, phrase)) WHERE rank <= 15""",
)
oracle("emb8_without_term", "SELECT code FROM prose p WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE length(t.term) > 3 AND contains(p.text, t.term))")
_CL = lambda c, y: f"SELECT code, unnest(generate_series(0, len(x) - 1))::BIGINT AS pos, md5(unnest(x)) AS text, {y} AS label FROM (SELECT code, {_CLAUSES.format(c)} AS x FROM split) WHERE len(x) > 0"
oracle("mlc1_weak_clauses", f"{_CL('declared_text', 0)} UNION ALL {_CL('trace_text', 1)}")
_GRAMS = """SELECT r, 'w' || unnest(w) AS gram FROM split_clauses UNION ALL SELECT r, 'w' || w[i] || ' ' || w[i + 1] FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM split_clauses)
    UNION ALL SELECT r, 'c' || substring(t, i, k) FROM (SELECT r, t, k, unnest(range(1, length(t) - k + 2)) AS i FROM (SELECT r, ' ' || unnest(ws) || ' ' AS t FROM split_clauses), (SELECT unnest([3, 4, 5]) AS k))"""
oracle(
    "mlc2_clause_features",
    f"""SELECT code, pos, label, n, round(total, 6) AS total, round(top, 6) AS top FROM (WITH clauses AS MATERIALIZED (
        SELECT row_number() OVER () AS r, * FROM (SELECT code, unnest(generate_series(0, len(x) - 1))::BIGINT AS pos, {norm('unnest(x)')} AS text, label
          FROM (SELECT code, {_CLAUSES.format('declared_text')} AS x, 0 AS label FROM split UNION ALL SELECT code, {_CLAUSES.format('trace_text')}, 1 FROM split) WHERE len(x) > 0)),
      split_clauses AS (SELECT r, ws, list_filter(ws, lambda w: length(w) >= 2) AS w FROM (SELECT r, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM clauses)),
      tfs AS MATERIALIZED (SELECT r, gram, count(*) AS tf FROM ({_GRAMS}) GROUP BY ALL),
      idfs AS (SELECT gram, ln((1 + (SELECT count(*) FROM clauses))::DOUBLE / (1 + count(*))) + 1 AS idf FROM tfs GROUP BY gram HAVING count(*) >= 2),
      raw AS MATERIALIZED (SELECT r, gram, (1 + ln(tf)) * idf AS w FROM tfs JOIN idfs USING (gram)),
      lengths AS (SELECT r, gram[1] AS kind, sqrt(sum(w * w)) AS l FROM raw GROUP BY ALL)
      SELECT c.code, c.pos, c.label, count(*) AS n, sum(w / l) AS total, max(w / l) AS top FROM raw JOIN lengths ON lengths.r = raw.r AND kind = gram[1] JOIN clauses c ON c.r = raw.r GROUP BY c.r, c.code, c.pos, c.label)""",
)
_CI = lambda s, y: f"SELECT code, allergen, '{s}' AS section, {y} AS is_trace, round((id * 31 % 100)::DOUBLE / 100, 6) AS ocr_confidence, (id % 4 <> 0)::INT AS extraction_found, lang AS language, length(text)::INT AS text_length, list_contains(ref_{s}, allergen)::INT AS correct FROM (SELECT id, code, lang, text, ref_{s}, unnest(pred_{s}) AS allergen FROM evaluated)"
oracle("mlc6_confidence_instances", f"{_CI('declared', 0)} UNION ALL {_CI('trace', 1)}")
oracle("mlc8_brier_auc", "SELECT count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y) * (1 - avg(y)), 6) AS naive_brier, (SELECT round(u / (n1 * n0), 6) FROM u_test) AS auc FROM scores")
oracle("mlc9_calibration", "SELECT CASE WHEN p < 0.4 THEN '0.0-0.4' WHEN p < 0.7 THEN '0.4-0.7' ELSE '0.7-1.01' END AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM scores GROUP BY 1")
oracle("sta1_pearson", "SELECT count(*) AS n, round(corr(p, x), 6) AS r FROM scores")
oracle("sta2_spearman", "SELECT count(*) AS n, round(corr(rp, rx), 6) AS r FROM ranked")
_SPREAD = "sqrt(n1::DOUBLE * n0 / 12 * (n1 + n0 + 1 - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1))))"
oracle("sta3_mann_whitney", f"SELECT n1, n0, u, ties, round((u - n1::DOUBLE * n0 / 2 - 0.5::DOUBLE) / {_SPREAD}, 6) AS z FROM u_test")
oracle("sta4_cutoff_means", "SELECT cut, round(avg(x) FILTER (p < cut), 6) AS below, round(avg(x) FILTER (p >= cut), 6) AS above FROM scores, (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS cut) GROUP BY cut")
# beyond 1.959964 and its corrections for n - 2 degrees of freedom Student's t has a two-sided p below 0.05, beyond 1.644854 a normal statistic a one-sided one
_T = "(1.959964::DOUBLE + 2.372271::DOUBLE / (n - 2) + 2.822501::DOUBLE / ((n - 2) * (n - 2)))"
_RULE = f"""SELECT '{{name}}' AS scores, n, CASE WHEN r < -0.2 AND abs(r) * sqrt((n - 2) / (1 - r * r)) > {_T} AND (u - n1 * n0 / 2 - 0.5) / {_SPREAD} > 1.644854 THEN 'use' ELSE 'do not use' END AS decision
    FROM (SELECT count(*) AS n, corr(q, x) AS r, (count(*) FILTER (y = 1))::DOUBLE AS n1, (count(*) FILTER (y = 0))::DOUBLE AS n0, sum(rank) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0 AS u, sum(same * same - 1)::DOUBLE AS ties
      FROM (SELECT *, rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS rank, count(*) OVER (PARTITION BY q) AS same FROM (SELECT y, {{sign}} * p + y * 0.5::DOUBLE AS q, 1 - y AS x FROM scores)))"""
oracle("sta5_decide", " UNION ALL ".join(_RULE.format(name=n, sign=i) for n, i in (("as it is", 1), ("turned", -1))))
oracle("str1_score_stream", f"SELECT code, {bar('pred_declared')} AS declared, {bar('pred_trace')} AS trace, {_RISK} AS risk FROM evaluated")
oracle("str2_ingest_stream", "SELECT DISTINCT user_id::VARCHAR AS code FROM events")
oracle("str3_verdict_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, verdict, count(*) AS n FROM scans WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM scans) GROUP BY ALL")
oracle("str4_scan_sessions", "SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, CASE max(CASE verdict WHEN 'AVOID' THEN 3 WHEN 'CAUTION' THEN 2 WHEN 'SAFE' THEN 1 ELSE 0 END) WHEN 3 THEN 'AVOID' WHEN 2 THEN 'CAUTION' WHEN 1 THEN 'SAFE' ELSE 'UNKNOWN' END AS worst FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::INT AS new FROM scans)) GROUP BY user_id, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM scans)")

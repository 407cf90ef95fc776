"""DuckDB SQL for those operators that SQL can express."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w),
f AS (SELECT *, 2 * source_size <= level * weight AS filled FROM l),
o AS (SELECT level FROM f WHERE NOT filled ORDER BY source_size / weight, source IS NULL, source LIMIT 1),
t AS (
  SELECT source, source_size, weight,
         CASE WHEN filled THEN (2 * source_size)::DOUBLE ELSE (SELECT level FROM o) * weight END AS target,
         (weight - 2) / 2.0::DOUBLE AS slope
  FROM f),
p AS (
  SELECT d.*, t.source_size, t.target, t.slope, t.target / nullif(t.source_size, 0) AS ratio,
         (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + size / 2) / nullif(t.source_size, 0) AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE floor(ratio) + (middle < ratio - floor(ratio))::INT END * size)::BIGINT AS taken,
       CASE WHEN size = 0 THEN 1.0
            WHEN slope = 0 THEN middle
            ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * middle) - (1 - slope)) / (2 * slope) END AS position
FROM p
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
s AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
f AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
q AS (SELECT i, item_id, term, count(*) AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
m AS (SELECT r, doc_id, 25 + (75 * len(terms) * docs) // total AS m FROM d, s),
p AS (SELECT i, item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"


def _record(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# crc32 bit by bit: its last bit tells which rows are tampered with
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda e, z: xor(e >> 1, (e & 1) * 3988292384)))"
MERKLE = f"""
WITH RECURSIVE l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS r
  FROM (SELECT doc_id, source, {_record('text')} AS leaf, CASE WHEN ({_CRC} & 1) = 1 THEN {_record("replace(text, chr(10), '')")} ELSE {_record('text')} END AS tampered FROM documents)),
u AS (
  SELECT source, 0 AS level, p, n, leaf AS h FROM l
  UNION ALL
  SELECT source, level + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM u WHERE n > 1 GROUP BY source, level, p // 3, n),
s AS MATERIALIZED (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (
  SELECT 0 AS level, p, n, subroot AS h FROM s
  UNION ALL
  SELECT level + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY p)) FROM v WHERE n > 1 GROUP BY level, p // 3, n),
steps AS (
  SELECT r, level, coalesce(string_agg(u.h, '' ORDER BY u.p) FILTER (u.p < l.p // (3 ** level)::BIGINT), '') AS a, coalesce(string_agg(u.h, '' ORDER BY u.p) FILTER (u.p > l.p // (3 ** level)::BIGINT), '') AS b
  FROM l JOIN u ON u.source IS NOT DISTINCT FROM l.source AND u.n > 1 AND u.p // 3 = l.p // (3 ** (level + 1))::BIGINT GROUP BY r, level
  UNION ALL
  SELECT r, 1000 + level, coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p < s.p // (3 ** level)::BIGINT), ''), coalesce(string_agg(v.h, '' ORDER BY v.p) FILTER (v.p > s.p // (3 ** level)::BIGINT), '')
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN v ON v.n > 1 AND v.p // 3 = s.p // (3 ** (level + 1))::BIGINT GROUP BY r, level),
ways AS (SELECT r, string_agg(a || b, '' ORDER BY level) AS proof, list(a || '|' || b ORDER BY level) AS way FROM steps GROUP BY r),
o AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM v WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(tampered, coalesce(way, [])), lambda own, x: sha256(split_part(x, '|', 1) || own || split_part(x, '|', 2))) AS folded_root
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN ways USING (r))
SELECT *, folded_root = root AS verified FROM o
"""

NEAR = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, w, len(w) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(n - 3, 1) + 1)) AS i FROM d WHERE n > 0)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * p.n >= 80 * (a.n + b.n - p.n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS near FROM d UNION SELECT e.y, r.near FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, m.least AS component_id, d.doc_id = m.least AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT node, min(near) AS least FROM r GROUP BY node) m ON m.node = d.doc_id
"""

SUBSTRING = r"""
WITH d AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)),
v AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, n - 48)) AS i FROM d WHERE n >= 50)),
f AS (SELECT h, min(doc_id) AS least FROM v GROUP BY h),
g AS MATERIALIZED (SELECT DISTINCT doc_id, i + unnest(range(50)) AS i FROM v JOIN f USING (h) WHERE least < doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, n + 1)) AS i FROM d WHERE n > 0) a WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = a.doc_id AND g.i = a.i) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, (n - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {
    "op1_substring": SUBSTRING,
    "op3_near_duplicates": NEAR,
    "op8_mixing": MIXING,
    "op11_ranked_search": RANKED,
    "op13_merkle_manifest": MERKLE,
}

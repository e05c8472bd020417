"""DuckDB SQL for the queries that SQL can express on whole tables."""

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

MIXING = rf"""
WITH RECURSIVE d AS (SELECT doc_id, text, source, {_WORDS} AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size AS room, 3.0::DOUBLE * source_size / weight AS fills FROM w),
c AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(room) OVER o, 0) AS before, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_
  FROM r WINDOW o AS (ORDER BY fills, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN fills >= (total - before) / left_ THEN (total - before) / left_ END) OVER () AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN room ELSE least(room, level * weight) END AS target FROM l),
e AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
  least(3.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS x,
  (('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(x) AS sure, x - floor(x) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) ELSE u / (1 - u) * 1e18 END AS rank_,
  sure < 3 AND size > 0 AS open_ FROM f),
g AS (SELECT *, target - sum(size * sure) OVER (PARTITION BY source) AS wanted,
  sum(CASE WHEN open_ THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank_, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through
  FROM q)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN open_ AND (through <= wanted OR (through - size < wanted AND through - wanted < wanted - (through - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g
"""

DECONTAMINATION = r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
shingles AS (SELECT DISTINCT side, r, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) >= 5),
n AS (SELECT r, count(*) AS item_shingles FROM shingles WHERE side = 'b' GROUP BY r)
SELECT d.id AS doc_id, b.id AS item_id, n.item_shingles::BIGINT AS item_shingles, count(*)::BIGINT AS shared
FROM shingles b JOIN shingles d ON d.s = b.s AND d.side = 'd' JOIN n ON n.r = b.r
WHERE b.side = 'b'
GROUP BY d.r, b.r, d.id, b.id, n.item_shingles HAVING 5 * count(*) >= 4 * n.item_shingles
UNION ALL
SELECT d.id, b.id, 1, 1 FROM words b JOIN words d ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
WHERE b.side = 'b' AND d.side = 'd' AND len(b.w) BETWEEN 1 AND 4
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS keeper FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT >> (5 * (7 - i % 8))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s
  FROM words WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

LINE_DEDUP = r"""
WITH RECURSIVE pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM pieces),
l AS (SELECT * FROM lines WHERE length(line) > 0),
u AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM l)),
pairs AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.id <> b.id
  WHERE a.n >= 40 AND b.n >= 40 AND levenshtein(a.line, b.line) <= 2),
reach AS (SELECT id AS a, id AS b FROM u UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON pairs.a = reach.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
deg AS (SELECT a AS id, count(*) AS n_links FROM pairs GROUP BY a),
o AS (SELECT l.doc_id, l.line_no, r.root, coalesce(deg.n_links, 0)::BIGINT AS n_links FROM l JOIN u USING (line) JOIN root r ON r.id = u.id LEFT JOIN deg ON deg.id = u.id),
f AS (SELECT *, first_value(doc_id) OVER w AS class_doc_id, first_value(line_no) OVER w AS class_line_no FROM o
  WINDOW w AS (PARTITION BY root ORDER BY doc_id, line_no))
SELECT doc_id, line_no, class_doc_id, class_line_no, n_links, doc_id = class_doc_id AND line_no = class_line_no AS kept FROM f
"""

ORACLES = {"op2_source_mixing": MIXING, "op3_line_dedup": LINE_DEDUP, "op4_decontamination": DECONTAMINATION, "op6_warc": WARC, "op7_exact_topk": TOPK, "op10_near_dedup": NEAR_DEDUP}

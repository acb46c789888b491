"""SQL that expresses some of the queries, for checks on small tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

TOP_K = """WITH v AS (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.rn <> c.rn AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

JACCARD = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_WORD}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w),
v AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, hash(concat_ws(' ', x, x1, x2, x3, x4)) AS x FROM v WHERE x4 IS NOT NULL UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
e AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents LEFT JOIN (SELECT doc_id, max(n) AS n FROM e GROUP BY doc_id) USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""

LINES = """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
full_lines AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS copy, length(line) AS size FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
first AS (SELECT * FROM full_lines WHERE copy = 1 AND size >= 10),
keys AS (
  SELECT first.*, m, part, CASE WHEN part = 0 THEN left(line, m // 2) ELSE substr(line, m // 2 - (m - size) + 1) END AS half
  FROM (SELECT *, unnest([size, size + 1]) AS m FROM first) AS first, (VALUES (0), (1)) p(part)),
near AS (
  SELECT DISTINCT b.doc_id, b.n FROM keys a JOIN keys b ON a.m = b.m AND a.part = b.part AND a.half = b.half AND (a.doc_id, a.n) < (b.doc_id, b.n)
  WHERE abs(a.size - b.size) <= 1 AND len(list_filter(range(greatest(a.size, b.size)), lambda k: left(a.line, k) = left(b.line, k)
    AND substr(a.line, k + 1 + (a.size >= b.size)::INT) = substr(b.line, k + 1 + (b.size >= a.size)::INT))) > 0),
marks AS (SELECT l.doc_id, l.n, l.line, f.copy, near.n AS close FROM l LEFT JOIN full_lines f USING (doc_id, n) LEFT JOIN near USING (doc_id, n)),
kept AS (
  SELECT doc_id, count(copy)::INTEGER AS n_lines, count(*) FILTER (copy > 1)::INTEGER AS n_exact, count(close)::INTEGER AS n_near,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (coalesce(copy, 1) = 1 AND close IS NULL), '') AS t FROM marks GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_exact, 0)::INTEGER AS n_exact, coalesce(n_near, 0)::INTEGER AS n_near, length(t)::INTEGER AS kept_chars, sha256(t) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)"""

SUFFIXES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, n, j, size, substr(h, 400 * j + 1, 398 + 2 * size) AS c FROM (SELECT doc_id, h, n, size, unnest(range((n - size) // 200 + 1)) AS j FROM d, (VALUES (400), (256)) s(size) WHERE n >= size)),
w AS (SELECT doc_id, size, 200 * j + k AS i, hash(substr(c, 2 * k + 1, 2 * size)) AS x FROM (SELECT *, unnest(range(200)) AS k FROM p) WHERE 200 * j + k + size <= n),
hit AS (SELECT doc_id, size, i FROM w SEMI JOIN (SELECT size, x FROM w GROUP BY size, x HAVING count(*) > 1) r USING (size, x)),
run AS (SELECT doc_id, size, i, sum(fresh) OVER (PARTITION BY doc_id, size ORDER BY i) AS g FROM (SELECT doc_id, size, i, (i - lag(i, 1, -1000) OVER (PARTITION BY doc_id, size ORDER BY i) > size)::INT AS fresh FROM hit)),
span AS (SELECT doc_id, size, min(i) AS a, max(i) + size AS b FROM run GROUP BY doc_id, size, g),
part AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM span WHERE size = 400),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS z, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k FROM part JOIN d USING (doc_id) GROUP BY doc_id),
told AS (SELECT doc_id, sum(b - a)::BIGINT AS n_passage FROM span WHERE size = 256 GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256, coalesce(n_passage, 0)::BIGINT AS n_passage
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN told USING (doc_id)"""

_SHARES = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
REPETITION = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT doc_id, line, list_sum(list_transform(regexp_extract_all(line, '{_WORD}'), lambda x: length(x))) AS size, count(*) OVER (PARTITION BY doc_id, line) AS copies
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
lines AS (SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, coalesce(sum(size) FILTER (copies > 1), 0)::BIGINT AS dup_line_chars FROM l GROUP BY doc_id),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
v AS (SELECT *, length(x) AS size, {", ".join(f"lead(x, {j}) OVER o AS x{j}" for j in range(1, 10))} FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, k, i, count(*) OVER (PARTITION BY doc_id, k, h) AS copies FROM (
  {" UNION ALL ".join(f"SELECT doc_id, {k} AS k, i, hash(concat_ws(' ', x, {', '.join(f'x{j}' for j in range(1, k))})) AS h FROM v WHERE x{k - 1} IS NOT NULL" for k in (3, *_SHARES))})),
c AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM g WHERE copies > 1),
s AS (SELECT doc_id, {", ".join(f"sum(size) FILTER (k = {k}) AS s{k}" for k in _SHARES)}, count(*) FILTER (k = 3) AS n3 FROM c JOIN v USING (doc_id, i) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
    {", ".join(f"coalesce(s{k}, 0)::BIGINT AS dup_{k}" for k in _SHARES)} FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND dup_line_chars <= 0.30::DOUBLE * word_chars AND n_symbols <= 0.10::DOUBLE * word_chars AND {" AND ".join(f"dup_{k} <= {x:.2f}::DOUBLE * word_chars" for k, x in _SHARES.items())} AS kept FROM m"""

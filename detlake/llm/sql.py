"""DuckDB SQL that gives the same rows as operators 1, 2, 7 and 9."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


# The patterns are spelled out here once more, so that a wrong one in the operator shows.
_ASSIGN = """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FOUND = " UNION ALL ".join(
    f"SELECT rk, {kind} AS kind, unnest(generate_series(1, len(m))) AS pos, unnest(p[:len(m)]) AS gap, unnest(m) AS hit, unnest(v) AS value FROM (SELECT rk, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v FROM d)"
    for kind, pattern, group in ((0, _ASSIGN, 2), (1, "AKIA[A-Z0-9]+", 0), (2, "[0-9a-f]+", 0), (3, "[A-Za-z0-9+/_-]{20,}", 0))
)
_LIVE = "(regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND len(list_distinct(string_split(value, ''))) >= 9 AND NOT regexp_matches(lower(value), 'example|sample|changeme|placeholder|dummy|test|xxxx|0000|1234'))"
_NAME = """(['assign', 'access', 'hex', 'bare'][kind + 1] || ':' || start || ':' || "end")"""
OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS rk, doc_id, source, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
s AS (SELECT rk, kind, value, sum(length(gap) + length(hit)) OVER (PARTITION BY rk, kind ORDER BY pos) AS "end", length(hit) AS size FROM f),
c AS (SELECT s.rk, doc_id, source, kind, value, ("end" - size)::BIGINT AS start, "end"::BIGINT AS "end", {_LIVE} AS live FROM s JOIN d USING (rk)
      WHERE length(value) >= [12, 18, 16, 20][kind + 1] AND (kind < 3 OR {_LIVE})),
o AS (SELECT value, CASE WHEN count(DISTINCT source) >= 3 THEN 'copied' WHEN count(DISTINCT source) <= 1 AND count(DISTINCT doc_id) <= 20 THEN 'own' ELSE 'shared' END AS standing FROM c GROUP BY value),
j AS (SELECT c.*, standing FROM c JOIN o USING (value)),
u AS (SELECT * FROM j WHERE kind < 3 OR (standing = 'own' AND NOT EXISTS (SELECT 1 FROM j b WHERE b.rk = j.rk AND b.kind < 3 AND b.start < j."end" AND b."end" > j.start)))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({_NAME}, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg({_NAME}, ',' ORDER BY start, kind), '') AS spans,
  count(*) FILTER (kind = 3) AS n_bare, count(*) FILTER (standing = 'copied') AS n_copied, count(*) FILTER (standing = 'shared') AS n_shared, count(*) FILTER (standing = 'own') AS n_own, count(*) FILTER (standing = 'own' AND live) AS n_live
FROM d LEFT JOIN u USING (rk) GROUP BY d.rk, d.doc_id
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]) WHEN len(ws) = 1 THEN ws ELSE [] END) AS items FROM w),
n AS (SELECT doc_id, len(items)::BIGINT AS n FROM s),
c AS (SELECT min(doc_id) AS rep, list_sort(items) AS items, list(doc_id) AS members FROM s WHERE len(items) > 0 GROUP BY list_sort(items)),
x AS (SELECT rep, len(items) AS n, unnest(items) AS item FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node),
k AS (SELECT unnest(members) AS doc_id, root FROM c JOIN m ON m.node = c.rep)
SELECT n.doc_id, n.n AS n_shingles, coalesce(k.root, n.doc_id) AS component_id, n.doc_id = coalesce(k.root, n.doc_id) AS kept FROM n LEFT JOIN k USING (doc_id)
"""

OP9 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, pos, array_to_string(ws[pos:pos + 12], ' ') AS item FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS pos FROM w)),
f AS (SELECT item, min(doc_id) AS lead FROM s GROUP BY item),
g AS (SELECT s.doc_id, list(DISTINCT s.pos + j) AS gone FROM s JOIN f USING (item) CROSS JOIN generate_series(0, 12) t(j) WHERE f.lead < s.doc_id GROUP BY s.doc_id),
x AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, ws, gone FROM w LEFT JOIN g USING (doc_id)),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, n_words)) AS pos FROM x),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM u LEFT JOIN (SELECT doc_id, unnest(gone) AS pos, true AS gone FROM g) y USING (doc_id, pos) WHERE y.gone IS NULL GROUP BY u.doc_id)
SELECT x.doc_id, n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM x LEFT JOIN k USING (doc_id)
"""

OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + 50], ' ')) AS item FROM (SELECT doc_id, ws, unnest(generate_series(0, len(ws) - 50)) AS pos FROM w)),
f AS (SELECT item, min(doc_id) AS lead FROM s GROUP BY item HAVING min(doc_id) < max(doc_id)),
h AS (SELECT s.doc_id, s.pos, f.lead < s.doc_id AS again FROM s JOIN f USING (item)),
m AS (SELECT doc_id, pos, any_value(pos) - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM h GROUP BY doc_id, pos),
v AS (SELECT doc_id, pos, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m),
p AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM v GROUP BY doc_id, grp),
m2 AS (SELECT doc_id, pos, any_value(pos) - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM h WHERE again GROUP BY doc_id, pos),
v2 AS (SELECT doc_id, pos, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM m2),
p2 AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM v2 GROUP BY doc_id, grp),
x AS (SELECT doc_id, sum(b - a)::BIGINT AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS passages FROM p GROUP BY doc_id),
y AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removable, string_agg(a || ':' || b, ',' ORDER BY a) AS removable FROM p2 GROUP BY doc_id)
SELECT x.doc_id, n_repeated, coalesce(n_removable, 0)::BIGINT AS n_removable, passages, coalesce(removable, '') AS removable FROM x LEFT JOIN y USING (doc_id)
"""

"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sets by a list of word runs, links by an equi-join on shingles, components by closure.
NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(h) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)
"""

#: Every window of 200 bytes by the MD5 of its hex form; runs of covered bytes by gaps.
REPEATS = """
WITH h AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 200)) AS i FROM h WHERE length(h) >= 400)),
d AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM d),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM g) GROUP BY doc_id, g),
t AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM r GROUP BY doc_id),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b, 1 AS o FROM r UNION ALL SELECT doc_id, 0, min(a), 0 FROM r GROUP BY doc_id),
x AS (SELECT k.doc_id, string_agg(substr(h.h, CAST(2 * k.a + 1 AS BIGINT), CAST(2 * (coalesce(k.b, length(h.h) // 2) - k.a) AS BIGINT)), '' ORDER BY k.a) AS kept FROM k JOIN h USING (doc_id) GROUP BY k.doc_id)
SELECT h.doc_id, CAST(length(h.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.c, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN t.n IS NULL THEN h.h ELSE coalesce(x.kept, '') END)) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id) LEFT JOIN x USING (doc_id)
"""

#: The bisected exponent, quotas, the cut of the last permutation, and a row for each draw.
MIXING = """
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, source, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS n FROM documents),
s AS MATERIALIZED (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY source),
m AS MATERIALIZED (SELECT CAST(sum(tokens) AS DOUBLE) AS total, min(tokens) / CAST(sum(tokens) AS DOUBLE) AS low, max(tokens) / CAST(sum(tokens) AS DOUBLE) AS high FROM s),
b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
    SELECT i + 1, CASE WHEN far THEN mid ELSE lo END, CASE WHEN far THEN hi ELSE mid END FROM (SELECT b.*, (lo + hi) / 2 AS mid, (pow(low, (lo + hi) / 2) / low) / (pow(high, (lo + hi) / 2) / high) > 2.0 AS far FROM b, m WHERE i < 30)),
p AS (SELECT source, tokens, tokens / total AS share, pow(tokens / total, hi) AS p FROM s, m, b WHERE b.i = 30),
w AS MATERIALIZED (SELECT source, tokens, p / sum(p) OVER () AS weight, greatest(tokens, CAST(floor(round(tokens * (p / share / min(p / share) OVER ()), 3)) AS BIGINT)) AS quota FROM p),
d AS MATERIALIZED (SELECT t.*, w.weight, w.quota // w.tokens AS whole, w.quota % w.tokens AS rest, w.quota / CAST(w.tokens AS DOUBLE) AS scale, md5(t.doc_id || ':' || (w.quota // w.tokens) || ':17') AS h FROM t JOIN w USING (source)),
c AS (SELECT source, max(h) AS cut FROM (SELECT source, h, rest, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM d) WHERE f < rest GROUP BY source),
e AS (SELECT d.*, unnest(generate_series(0, whole - CASE WHEN h <= cut THEN 0 ELSE 1 END)) AS epoch FROM d LEFT JOIN c USING (source))
SELECT doc_id, source, CAST(n AS BIGINT) AS n_tokens, CAST(epoch AS INTEGER) AS epoch, round(weight, 8) AS weight, round(least((epoch + CAST('0x' || substr(md5(doc_id || ':' || epoch || ':17'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE) / scale, 1 - pow(2, -40)), 8) AS place FROM e
"""

#: CRC-32 as a fold over bytes, with its table made by the shift rule.
SHARDING = """
WITH k AS MATERIALIZED (SELECT list_transform(generate_series(0, 255), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size, [CAST(4294967295 AS BIGINT)] || list_transform(generate_series(1, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM h),
c AS MATERIALIZED (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32 FROM b, k),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM c),
s AS (SELECT *, CAST(least(23, (2 * before + size) * 24 // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, rank - min(rank) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

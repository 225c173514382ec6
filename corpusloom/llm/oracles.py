"""SQL of the training-data queries, for DuckDB on the same tables."""

from __future__ import annotations

LINE_DEDUP = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS MATERIALIZED (
  SELECT r, i, l AS line, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM d)
), common AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), kept AS (
  SELECT r, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '') AS kept
  FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY r
)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM kept JOIN d USING (r)
"""

SOURCE_DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), found AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS MATERIALIZED (
  SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT r) >= 3
), counted AS MATERIALIZED (
  SELECT f.lang, f.source, f.term, count(*) AS n FROM found f JOIN kept k ON f.lang = k.lang AND f.term = k.term GROUP BY ALL
), langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang
), grps AS MATERIALIZED (
  SELECT g.lang, g.source, l.v, l.n AS lang_n, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN langs l ON g.lang = l.lang
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counted GROUP BY ALL) c ON g.lang = c.lang AND g.source = c.source
), shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // (g.n + g.v) AS BIGINT) AS p,
         CAST(1 + (1000000000 * CAST(k.n + 1 AS HUGEINT)) // (g.lang_n + g.v) AS BIGINT) AS q
  FROM grps g JOIN kept k ON g.lang = k.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), priced AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), ahead AS (
  SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM pairs
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
         CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM ahead
) WHERE rank <= 200
"""


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    nearest = """
  SELECT r, part, arg_min(entry, (dist, entry)) AS entry, min(dist) AS dist FROM (
    SELECT p.r, p.part, b.entry, CAST(list_dot_product(p.z, p.z) - 2 * list_dot_product(p.z, b.z) + list_dot_product(b.z, b.z) AS BIGINT) AS dist
    FROM p JOIN b{k} b ON p.part = b.part
  ) GROUP BY r, part"""
    better = """
  SELECT b.part, b.entry, coalesce(m.z, b.z) AS z FROM b{k} b LEFT JOIN (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS z FROM (
      SELECT part, entry, i, sum(CAST(x AS BIGINT)) AS s, count(*) AS n FROM (
        SELECT a.part, a.entry, unnest(p.z) AS x, unnest(range(len(p.z))) AS i FROM a{k} a JOIN p ON a.r = p.r AND a.part = p.part
      ) GROUP BY part, entry, i
    ) GROUP BY part, entry
  ) m ON b.part = m.part AND b.entry = m.entry"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k)})")
        if k < rounds:
            steps.append(f"b{k + 1} AS MATERIALIZED ({better.format(k=k)})")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT r, part, q[1 + part * len(q) // {parts} : (part + 1) * len(q) // {parts}] AS z FROM v, range({parts}) t(part)
), b0 AS (SELECT part, r - 1 AS entry, z FROM p WHERE r <= {entries}),
{", ".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY r
), books AS (
  SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS h
  FROM (SELECT part, entry, unnest(z) AS x, unnest(range(len(z))) AS i FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM books) AS codebooks_sha256
FROM v JOIN coded USING (r)
"""

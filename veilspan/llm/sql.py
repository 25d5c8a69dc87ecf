"""DuckDB SQL for the operators of this subpackage that SQL can express."""

OP6 = r"""
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 3, '0') AS shard FROM range(32) t(k)
), prefs AS (
  SELECT k, shard,
    ('0x' || substr(md5('offset:' || shard), 1, 12))::BIGINT % 4099 AS first,
    ('0x' || substr(md5('skip:' || shard), 1, 12))::BIGINT % 4098 + 1 AS skip
  FROM shards
), orders AS (
  SELECT list(list_transform(range(4099), lambda j: (first + j * skip) % 4099) ORDER BY k) AS by_shard FROM prefs
), turns AS (
  SELECT 0 AS turn, []::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, list_filter(by_shard[turn % 32 + 1], lambda s: NOT list_contains(taken, s))[1])
  FROM turns, orders WHERE turn < 4099
), slots AS (
  SELECT unnest(taken) AS slot, unnest(range(4099)) % 32 AS k FROM turns WHERE turn = 4099
)
SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, slot::INTEGER AS slot, shard
FROM (SELECT doc_id, text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % 4099 AS slot FROM documents) d
JOIN slots USING (slot) JOIN shards USING (k)
"""

#: Mixing {docs} (doc_id, source, size, and whatever else) to rows with copies.
MIX = r"""
sized AS (
  SELECT *, (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM {docs}
), sources AS (
  SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS n
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), levels AS (
  SELECT *, sum(source_size) OVER () * 150 - coalesce(sum(source_size) OVER before, 0) * 200 AS remains,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS rest, row_number() OVER (ORDER BY source_size * (10 // w), n) AS place
  FROM sources WINDOW before AS (ORDER BY source_size * (10 // w), n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stops AS (
  SELECT *, source_size::HUGEINT * 200 * rest <= remains::HUGEINT * w AS stops FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN stops THEN (source_size * 2)::DOUBLE ELSE
    ((SELECT arg_min(remains, place) FROM stops WHERE NOT stops) * w)::DOUBLE / ((SELECT arg_min(rest, place) FROM stops WHERE NOT stops) * 100)::DOUBLE END AS target
  FROM stops
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals
), ranked AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS need,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN shares g ON d.source IS NOT DISTINCT FROM g.source
), mixed AS (
  SELECT *, whole + (need > 0 AND before + size / 2.0::DOUBLE <= need)::BIGINT AS copies FROM ranked
)
"""

SIZES = r"""SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents"""

OP8 = "WITH docs AS (" + SIZES + "), " + MIX.format(docs="docs") + "SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mixed"

#: Whole tables are searched: every query against every row.
OP2 = r"""
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

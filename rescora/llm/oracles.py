"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), c AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) AS class FROM s
), w AS (
  SELECT *, CASE class WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt,
         CAST(source_size * 3 AS DOUBLE) AS cap FROM c
), l AS (
  SELECT *, cap / wt AS fill, row_number() OVER (ORDER BY cap / wt, source NULLS LAST) AS place,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w
), t AS (
  SELECT *, least((SELECT level FROM l WHERE level <= fill ORDER BY place LIMIT 1) * wt, cap) AS target FROM l
), p AS (
  SELECT d.*, t.source_size, t.target, t.class,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e,
         coalesce(floor(target / nullif(t.source_size, 0)), 0)::BIGINT AS full_passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, target - full_passes * source_size AS rest FROM p
), g AS (
  SELECT source, any_value(rest) - coalesce(sum(size) FILTER (WHERE e <= rest), 0) AS gap FROM q GROUP BY source
), m AS (
  SELECT coalesce('=' || q.source, '') AS k, h, doc_id, size, e, gap, FALSE AS took
  FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source WHERE e > rest AND size > 0
  UNION ALL
  SELECT k, h, doc_id, size, e, gap - sum(CASE WHEN upto <= gap THEN size ELSE 0 END) OVER (PARTITION BY k), upto <= gap
  FROM (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM m WHERE NOT took AND size <= gap)
), f AS (
  SELECT k, e FROM m WHERE took
), r AS (
  SELECT q.*, least(full_passes + CASE WHEN q.e <= rest OR f.e IS NOT NULL THEN 1 ELSE 0 END, 3) AS n,
         coalesce((q.e - size) / nullif(target, 0), 0) AS share
  FROM q LEFT JOIN f ON coalesce('=' || q.source, '') = f.k AND q.e = f.e AND size > 0
)
SELECT doc_id, size, source_size, target, CAST(size * n AS BIGINT) AS taken,
  CASE WHEN n > 0 THEN round(least(CASE class
    WHEN 0 THEN 2 * (share * 5) / (7 + sqrt(greatest(49 - 8 * (share * 5), 0)))
    WHEN 1 THEN share
    ELSE CASE WHEN share <= 0.25 THEN share * 2
      ELSE 0.5 + 2 * (share - 0.25) / (0.5 + sqrt(0.25 + 8 * (share - 0.25))) END END, 1.0), 6) END AS position
FROM r
"""

ORACLES["op6_lines"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY r
"""

ORACLES["op9_decontam"] = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bw
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dw AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), hits AS (
  SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM dw) x JOIN win USING (n, s)
), spots AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), its AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN its USING (r)
"""

ORACLES["op10_warc"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), q AS (
  SELECT *, first_id IS NOT NULL AND (page_id IS NULL OR page_id > first_id) AS again FROM f
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((('0x' || substr(h, 1 + 5 * CAST(k // 4 AS INT), 5))::INT >> (15 - 5 * CAST(k % 4 AS INT))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM q
"""

ORACLES["op8_rotation"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS n, turn IS NOT NULL AS k,
    CASE WHEN coalesce(role, '') = '' THEN 'unknown' ELSE regexp_replace(role, '[^\p{L}\p{N}_-]', '_', 'g') END AS who,
    replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n, k, who, said) AS i FROM t
), f AS (
  SELECT conv_id, coalesce(min(i) FILTER (WHERE who <> 'system'), 9223372036854775807) AS first FROM o GROUP BY conv_id
), p AS (
  SELECT DISTINCT conv_id, who AS speaker FROM o WHERE who <> 'system'
), parts AS (
  SELECT DISTINCT conv_id, CAST((i - 1) // 512 AS BIGINT) AS part FROM o
), m AS (
  SELECT conv_id, CAST((i - 1) // 512 AS BIGINT) AS part, i, who, said, TRUE AS own_part FROM o
  UNION ALL
  SELECT o.conv_id, parts.part, i, who, said, FALSE FROM o JOIN f ON o.conv_id IS NOT DISTINCT FROM f.conv_id
    JOIN parts ON o.conv_id IS NOT DISTINCT FROM parts.conv_id WHERE i < first AND i <= part * 512
), r AS (
  SELECT m.conv_id, m.part, p.speaker, i, own_part, who = speaker AS own,
    '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant' ELSE 'user name=' || who END || chr(10) AS head,
    said || '<|im_end|>' AS body
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, speaker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS pos FROM r
)
SELECT conv_id, part, speaker, string_agg(head || body || chr(10), '' ORDER BY i) AS text,
  coalesce(string_agg(CAST(pos AS BIGINT)::VARCHAR || '-' || CAST(pos + length(body) AS BIGINT)::VARCHAR, ',' ORDER BY i) FILTER (WHERE own), '') AS mask,
  count(*) FILTER (WHERE own_part) AS n_turns, count(*) FILTER (WHERE own) AS n_spoken
FROM s GROUP BY conv_id, part, speaker
"""

ORACLES["op13_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d
), l AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN coalesce(w.doc_id > first_id, FALSE) THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, fails
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o
), r AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS own, fails, n, good, toxic,
    contains(fails, substr(filter_order, step, 1)) AS hit,
    len(translate(fails, substr(filter_order, 1, step - 1), '')) < len(fails) AS gone
  FROM c, s
), t AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""

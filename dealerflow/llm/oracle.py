"""SQL twins of the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

OP4 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + 12)) AS h, list_slice(w, i, i + 12) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (
  SELECT g, min(doc_id) AS first FROM s GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM (SELECT s.doc_id, s.i, unnest(range(0, 13)) AS k FROM s JOIN f USING (g) WHERE f.first < s.doc_id)
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY p) AS text
  FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id
), n AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

_MIX_PASS = """
, fit{k} AS (
  SELECT left{k}.* FROM left{k} JOIN room{k} ON left{k}.source IS NOT DISTINCT FROM room{k}.source WHERE size > 0 AND size <= room
), run{k} AS (
  SELECT fit{k}.*, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM fit{k}
), got{k} AS (
  SELECT run{k}.doc_id, run{k}.source, size FROM run{k} JOIN room{k} ON run{k}.source IS NOT DISTINCT FROM room{k}.source WHERE upto <= room
), left{n} AS (
  SELECT * FROM left{k} WHERE doc_id NOT IN (SELECT doc_id FROM got{k})
), room{n} AS (
  SELECT source, room - coalesce((SELECT sum(size) FROM got{k} WHERE got{k}.source IS NOT DISTINCT FROM room{k}.source), 0) AS room FROM room{k}
)"""

OP6 = (
    r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), b AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM d
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM d GROUP BY source
), rising AS (
  SELECT *, row_number() OVER o AS rank,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per WINDOW o AS (ORDER BY cap / weight, turn)
), target AS (
  SELECT source, source_size,
         least((SELECT arg_min(level, rank) FROM rising WHERE level * weight <= cap) * weight, cap::DOUBLE) AS target
  FROM rising
), c AS (
  SELECT source, bits, sum(size)::BIGINT AS words FROM b GROUP BY source, bits
), lv AS (
  SELECT c.*, source_size, target,
         (target - 3 * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(bits * words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::DOUBLE AS level
  FROM c JOIN target ON c.source IS NOT DISTINCT FROM target.source
), common AS (
  SELECT source, arg_max(level, bits) AS level FROM lv WHERE level * bits <= 3 GROUP BY source
), e AS (
  SELECT lv.* EXCLUDE (level), CASE WHEN bits = 0 THEN 0 ELSE least(coalesce(common.level * bits, 3), 3) END::DOUBLE AS copies
  FROM lv LEFT JOIN common ON lv.source IS NOT DISTINCT FROM common.source
), p AS (
  SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies)::BIGINT AS part FROM e
), room0 AS (
  SELECT source, max(target) - sum(whole * words)::DOUBLE AS room FROM p GROUP BY source
), left0 AS (
  SELECT doc_id, b.source, size, (u / (1 - u)) / (part / (1 - part)) AS q
  FROM (SELECT *, (('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM b) b
  JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.bits = p.bits WHERE part > 0
)"""
    + "".join(_MIX_PASS.format(k=k, n=k + 1) for k in range(4))
    + r"""
, got AS (SELECT doc_id FROM got0 UNION ALL SELECT doc_id FROM got1 UNION ALL SELECT doc_id FROM got2 UNION ALL SELECT doc_id FROM got3)
SELECT b.doc_id, b.size, p.source_size, p.target,
       ((p.whole + CASE WHEN got.doc_id IS NULL THEN 0 ELSE 1 END) * b.size)::BIGINT AS taken
FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source AND b.bits = p.bits LEFT JOIN got ON b.doc_id = got.doc_id
"""
)

OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k
  FROM c
), marked AS (
  -- One character more for every backslash, every number sign before two others, and every mark that closes a turn.
  SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
            + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(text, '#{3,}')]), 0)
            + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS said,
         CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
              ELSE 8 + length(role) + length(role) - length(replace(replace(role, '\', ''), ']', ''))
                   + coalesce(list_sum([length(x) - 2 for x in regexp_extract_all(role, '#{3,}')]), 0)
                   + (length(role) - length(replace(role, '</turn>', ''))) // 7 END AS opening,
         lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS before,
         row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS last
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       sum(opening + said + 8)::BIGINT AS formatted_chars,
       bool_and(CASE coalesce(before, '') WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
       AND max(CASE WHEN last = 1 THEN role END) = 'assistant' AS valid
FROM marked GROUP BY conv_id
"""

OP10 = r"""
WITH r AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r
), p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM h
), rules(host, path, verdict, base) AS (
  VALUES ('net', '/', 'block', true), ('example.net', '/en/', 'allow', true),
         ('example.com', '/de/', 'block', true), ('org', '/fr/', 'allow', true),
         ('cheap-pills.example.com', '/', 'block', false), ('spam-farm.example.org', '/', 'block', false)
), best AS (
  SELECT p.page_id, p.host, p.path, rules.host || rules.path AS rule, verdict, base,
         row_number() OVER (PARTITION BY p.page_id ORDER BY base DESC, length(rules.host || rules.path) DESC, length(rules.host) DESC) AS k
  FROM p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
)
SELECT page_id, host, path, CASE WHEN base THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE k = 1
"""

OP13 = r"""
WITH words AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM documents
), tf AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term
), docs AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), facts AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs
), asked AS (
  SELECT DISTINCT item_id, term
  FROM (SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
                                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM benchmark)
), weight AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM facts) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term
), scored AS (
  SELECT asked.item_id, tf.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * facts.docs) // facts.terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN docs USING (doc_id) CROSS JOIN facts
  GROUP BY asked.item_id, tf.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {"op4_recompression": OP4, "op5_radix_dedup": OP5, "op6_source_mixing": OP6, "op7_chat_formatting": OP7, "op10_url_filter": OP10, "op13_max_sketch_search": OP13}

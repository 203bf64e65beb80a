"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

from lumenstack.llm.common import LOWER, UPPER

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) AS t(o) WHERE n > 1 GROUP BY 1),
l AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
o AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY 1),
m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, lines, coalesce(top, 0) AS top, len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS bare
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars NOT BETWEEN 2 * n_words AND 15 * n_words OR 10 * n_dup_lines > 3 * lines OR 5 * bare > n_words OR 5 * top > n_words) AS kept
FROM b
"""

OP8_DECONTAM = rf"""
WITH i AS (SELECT item_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM benchmark),
it AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM it)),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY 1),
d AS (SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
e AS (SELECT DISTINCT doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k))
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM e JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) >= 0.8 * item_shingles
"""

#: The checksum comes from its polynomial, bit by bit and then byte by byte; the edits from a program over audit strings.
OP11_REPAIR = r"""
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS bytes),
k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda x, y: xor(x >> 8, bytes[(xor(x, y) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM k, c),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text), copy) AS i FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
g(a, run, b, added) AS (VALUES ('', 0, '', ''), ('', 1, 'u', 'user:'), ('', 2, 'a', 'user:' || chr(10) || 'assistant:'), ('s', 0, 's', ''), ('s', 1, 'u', 'user:'), ('s', 2, 'a', 'user:' || chr(10) || 'assistant:'),
    ('u', 0, 'u', ''), ('u', 1, 'a', 'assistant:'), ('u', 2, 'u', 'assistant:' || chr(10) || 'user:'), ('a', 0, 'a', ''), ('a', 1, 'u', 'user:'), ('a', 2, 'a', 'user:' || chr(10) || 'assistant:')),
m AS (SELECT a, run, b, added, edit, CASE WHEN edit = 'D' THEN b WHEN edit = 'S' THEN 's' WHEN b = 'u' THEN 'a' ELSE 'u' END AS z, 3 * run + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END AS price
    FROM g, (VALUES ('D'), ('K'), ('R'), ('S')) AS v(edit) WHERE edit <> 'S' OR b = ''),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM n
  UNION ALL
  SELECT p.conv_id, f.i, z, cost + price + CASE WHEN fault = 'truncated' AND edit <> 'D' THEN 3 ELSE 0 END AS c, audit || repeat('I', run) || replace(edit, 'S', 'K') AS w,
    list_concat(lines, CASE WHEN run > 0 THEN [added] ELSE [] END, CASE edit WHEN 'D' THEN [] WHEN 'R' THEN [CASE z WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] ELSE [role || ':' || text] END)
  FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN m ON m.a = p.state
  WHERE edit = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (edit = 'R' OR initial = z))
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, z ORDER BY c, w) = 1),
q AS (SELECT p.conv_id, n.* EXCLUDE (conv_id), cost + 3 * run AS cost, audit || repeat('I', run) AS audit, list_concat(lines, CASE WHEN run > 0 THEN [added] ELSE [] END) AS lines
  FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = n.n JOIN g ON g.a = state AND (g.b = 'a' OR state = '' AND run = 0)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY cost + 3 * run, audit || repeat('I', run)) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM a.conv_id
"""

OP13_AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 'E' ELSE '' END AS fails FROM d),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
v(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM v a, v b, v c, v d, v e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT *, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda y: y <> ''), lambda y: strpos(filter_order, y))), 6) AS gone FROM c, o),
s AS (SELECT r.*, step, filter_order[step] AS x FROM r, (SELECT unnest(range(1, 6)) AS step)),
t AS (SELECT part, filter_order, step, x, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed, coalesce(sum(n) FILTER (gone < step AND contains(fails, x)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = x), 0) AS unique_fails, coalesce(sum(n) FILTER (gone = step AND good), 0) AS good_lost, coalesce(sum(n) FILTER (gone = step AND toxic), 0) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM t
"""

"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_ESCAPED = "length({0}) + length({0}) - length(translate({0}, '\\<>', ''))"

_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

# CRC32 of a number's decimal digits, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
  [CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda held, byte: list_reduce([xor(held, byte), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda rest, zero: CASE WHEN rest % 2 = 1 THEN xor(rest // 2, 3988292384) ELSE rest // 2 END)))"""

SQL = {
    "op2_decontamination": f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS words FROM benchmark
  WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS n,
    array_to_string(words[s:s + least(len(words), 10) - 1], ' ') AS said
  FROM items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(s) WHERE len(words) > 0),
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
spans AS (
  SELECT row, s, n, array_to_string(words[s:s + n - 1], ' ') AS said
  FROM docs, (SELECT DISTINCT n FROM windows) AS l, unnest(range(1, len(words) - n + 2)) AS u(s)),
hits AS (SELECT row, s, spans.n, item_id FROM spans JOIN windows USING (said)),
covered AS (
  SELECT row, count(DISTINCT w) AS n_hit FROM hits, unnest(range(s, s + n)) AS u(w) GROUP BY row),
named AS (
  SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
  FROM (SELECT DISTINCT row, item_id FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (row) LEFT JOIN named USING (row)""",
    "op10_chat": f"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + {_ESCAPED.format('role')} + 2 + {_ESCAPED.format('text')} + 8) AS BIGINT)
    AS formatted_chars
FROM all_turns GROUP BY conv_id""",
    "op12_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY p) AS said FROM turns GROUP BY conv_id),
starts AS (
  SELECT conv_id, said, {_CRC32.format('conv_id')} % 4 AS h, conv_id - conv_id % 20 AS base FROM own),
built AS (
  SELECT s.conv_id, list_concat(coalesce(b.said, [])[1:s.h], s.said[s.h + 1:]) AS said
  FROM starts AS s LEFT JOIN own AS b ON b.conv_id = s.base),
places AS (
  SELECT conv_id, d, len(said) = d AS ends, said[1:d] AS path
  FROM built, unnest(range(0, len(said) + 1)) AS u(d)),
nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN any_value(d) = 0 THEN 0 ELSE
      len(regexp_extract_all(any_value(path[d]).text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM places GROUP BY path),
children AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT n.path[:d] AS path, count(*) FILTER (c.n IS NULL) AS n_leaves, sum(n.saved) AS saved
  FROM nodes AS n LEFT JOIN children AS c USING (path), unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s USING (path) LEFT JOIN children AS c USING (path)
LEFT JOIN nodes AS above ON n.depth > 0 AND above.path = n.path[:n.depth - 1]""",
}

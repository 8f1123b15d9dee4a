"""SQL texts of the conversation operators."""

from __future__ import annotations

#: Fixed value: the reversed polynomial of the usual crc32.
POLYNOMIAL = 3988292384

#: A table of one row with the 256 steps of the checksum.
CRC_TABLE = f"""
steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, {POLYNOMIAL}) ELSE c // 2 END)) AS step
)"""


def crc32(text: str) -> str:
    """Checksum of an ASCII text; the table ``steps`` must be in the FROM clause."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))"
    return (
        f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), "
        "lambda c, b: xor(c // 256, step[1 + xor(c, b) % 256])), 4294967295)"
    )


TRIE = f"""
WITH {CRC_TABLE},
own AS (
  SELECT conv_id, d, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, '')) AS size,
               md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
        FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
  SELECT conv_id, n, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h, conv_id - conv_id % 5 AS base
  FROM (SELECT conv_id, count(*) AS n FROM own GROUP BY conv_id), steps
),
built AS (
  SELECT c.conv_id, o.pos AS depth, o.d, o.size FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.pos - c.h, o.d, o.size
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN convs b ON b.conv_id = c.base
),
paths AS (
  SELECT conv_id, depth, size, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved
  FROM paths GROUP BY node, depth
),
kids AS (SELECT left(node, length(node) - 32) AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT p.node,
         sum(CASE WHEN n.node IS NOT NULL AND k.node IS NULL THEN 1 ELSE 0 END) OVER w AS leaves,
         sum(coalesce(n.saved, 0)) OVER w AS saved
  FROM paths p LEFT JOIN nodes n ON n.node = p.node AND n.conv_id = p.conv_id LEFT JOIN kids k ON k.node = p.node
  WINDOW w AS (PARTITION BY p.conv_id ORDER BY p.depth DESC)
),
sums AS (SELECT node, sum(leaves) AS leaves, sum(saved) AS saved FROM below GROUP BY node),
last AS (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM last GROUP BY node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs,
       CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.h, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN ends e ON e.node = n.node
LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.node = left(n.node, length(n.node) - 32)
"""

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _more(best: str, cost: int, letter: str) -> str:
    """A best end with one more edit before it: nine digits of cost, then the edits."""
    return f"lpad(CAST(CAST(left({best}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({best}, 10)"


def _more_late(best: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(left({best}, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({best}, 10)"


def _consumed(state: int) -> str:
    """Cheapest end from a state whose next edit takes the row; states: start, after s, after u, after a."""
    turn = 3 if state == 2 else 2
    keep = {0: f"CASE r.initial WHEN 's' THEN {_more_late('q.b1', 'r.cut', 'K')} WHEN 'u' THEN {_more_late('q.b2', 'r.cut', 'K')} END",
            1: f"CASE r.initial WHEN 'u' THEN {_more_late('q.b2', 'r.cut', 'K')} END",
            2: f"CASE r.initial WHEN 'a' THEN {_more_late('q.b3', 'r.cut', 'K')} END",
            3: f"CASE r.initial WHEN 'u' THEN {_more_late('q.b2', 'r.cut', 'K')} END"}[state]
    change = _more_late(f"q.b{turn}", "2 + r.cut", "R")
    return f"least({_more(f'q.b{state}', 3, 'D')}, CASE WHEN NOT r.gone THEN {change} END, CASE WHEN NOT r.gone THEN {keep} END)"


REPAIR = f"""
WITH RECURSIVE {CRC_TABLE},
ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("CAST(conv_id AS VARCHAR) || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS draw
  FROM conversations, steps WHERE conv_id IS NOT NULL
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
         CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE draw <> 0
),
told AS (
  SELECT *, md5(strlen(role) || ':' || role || text) AS g, rtrim(text, {BLANKS}) AS shown FROM damaged
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, g, copy) AS pos FROM told
),
rows_ AS (
  SELECT conv_id, turn, role, text, pos, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial,
         CASE WHEN shown = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, g ORDER BY pos) > 1 THEN 'duplicate'
              WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
),
r AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM rows_),
best(conv_id, pos, b0, b1, b2, b3) AS (
  SELECT conv_id, max(pos), '000000000', '000000004II', '000000002I', '000000000' FROM r GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos,
         least(c0, {_more('c2', 2, 'I')}, {_more(f"({_more('c3', 2, 'I')})", 2, 'I')}),
         least(c1, {_more('c2', 2, 'I')}, {_more(f"({_more('c3', 2, 'I')})", 2, 'I')}),
         least(c2, {_more('c3', 2, 'I')}), least(c3, {_more('c2', 2, 'I')})
  FROM (SELECT q.conv_id, q.pos - 1 AS pos, {_consumed(0)} AS c0, {_consumed(1)} AS c1, {_consumed(2)} AS c2, {_consumed(3)} AS c3
        FROM best q JOIN r ON r.conv_id = q.conv_id AND r.pos = q.pos WHERE q.pos > 0)
),
solved AS (SELECT conv_id, CAST(left(b0, 9) AS BIGINT) AS cost, substr(b0, 10) AS audit FROM best WHERE pos = 0),
edits AS (
  SELECT conv_id, j, audit[j] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM solved)
),
lined AS (
  SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER w AS pos, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER w AS line
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)
),
heads AS (
  SELECT l.conv_id FROM lined l JOIN r ON r.conv_id = l.conv_id AND r.pos = l.pos
  WHERE l.line = 1 AND l.letter = 'K' AND r.initial = 's'
),
written AS (
  SELECT l.conv_id, l.j, CASE WHEN l.letter = 'K' THEN r.role
           WHEN (l.line - CASE WHEN h.conv_id IS NULL THEN 0 ELSE 1 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN l.letter = 'I' THEN '' ELSE r.text END AS line
  FROM lined l LEFT JOIN r ON r.conv_id = l.conv_id AND r.pos = l.pos AND l.letter <> 'I'
  LEFT JOIN heads h ON h.conv_id = l.conv_id WHERE l.letter <> 'D'
),
hashes AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS h FROM written GROUP BY conv_id),
pairs AS (
  SELECT conv_id, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM r) GROUP BY conv_id
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated
  FROM r GROUP BY conv_id
)
SELECT i.conv_id, CAST(coalesce(c.gaps, 0) AS BIGINT) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(p.illegal, 0) AS illegal, coalesce(s.cost, 0) AS cost,
       coalesce(s.audit, '') AS audit, coalesce(h.h, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN counts c ON c.conv_id = i.conv_id LEFT JOIN pairs p ON p.conv_id = i.conv_id
LEFT JOIN solved s ON s.conv_id = i.conv_id LEFT JOIN hashes h ON h.conv_id = i.conv_id
"""

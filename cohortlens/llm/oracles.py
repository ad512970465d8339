"""SQL that two of the queries must agree with, written for DuckDB."""

from __future__ import annotations

from cohortlens.llm.chat import BUDGET, CLOSE, CONTROLS, HISTORY, OPEN

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), listed AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM listed),
shingles AS (SELECT doc_id, unnest(s) AS g FROM listed),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (g)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y
  WHERE 100 * c >= 75 * (sx.n + sy.n - c)
), edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, edges.y FROM reach JOIN edges ON edges.x = reach.y
)
SELECT doc_id, n AS n_shingles, (SELECT min(y) FROM reach WHERE x = doc_id) AS component_id FROM sizes
"""


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for control in CONTROLS:
        sql = f"replace({sql}, '{control}', '{control[0]}\\{control[1:]}')"
    return sql


_SAID = "</s>[INST] ok [/INST]"
_CLOSED = CLOSE.replace("\n", "")

CHAT_FORMAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'
), marked AS (
  SELECT *, '{OPEN}' || replace({_escaped("role")}, chr(10), '\\' || chr(10)) || chr(10) || {_escaped("text")}
    || '{_CLOSED}' || chr(10) AS body FROM said
), counted AS (
  SELECT *, len(regexp_extract_all(body, '[^ \\t\\n\\r]+')) AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, body) AS seq FROM marked
), system_turn AS (
  SELECT *, seq = 1 AND role = 'system' AS is_system FROM counted
), placed AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE tokens END AS fresh,
    sum(CASE WHEN is_system THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY seq) AS upto,
    sum(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS kept FROM system_turn
), roomy AS (
  SELECT *, upto - fresh AS since, greatest({BUDGET} - {HISTORY} - kept, {HISTORY}, 1) AS room FROM placed
), owned AS (
  SELECT *, CASE WHEN NOT is_system THEN 2 * (since // room)
    + CASE WHEN (upto - 1) // room > since // room THEN 1 ELSE 0 END END AS own FROM roomy
), spans AS (
  SELECT conv_id, coalesce(own, 0) AS own, min(since) AS since FROM owned
  WHERE NOT is_system OR conv_id NOT IN (SELECT conv_id FROM owned WHERE NOT is_system) GROUP BY 1, 2
), repeated AS (
  SELECT s.conv_id, sum(length(o.body)) AS chars FROM spans s JOIN owned o ON o.conv_id = s.conv_id
  WHERE o.is_system OR o.own = s.own OR (o.upto <= s.since AND o.since >= s.since - {HISTORY}) GROUP BY 1
), n_spans AS (SELECT conv_id, count(*) AS n_windows FROM spans GROUP BY 1)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(chars) AS BIGINT) AS formatted_chars, any_value(n_windows) AS n_windows
FROM owned JOIN repeated USING (conv_id) JOIN n_spans USING (conv_id) GROUP BY 1
"""

#: CRC-32 of a conversation's decimal id, by a table of the 256 bytes.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc[1 + (xor(a, b) & 255)]))"""

PREFIX_TRIE = f"""
WITH crcs AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda a, i: xor(a >> 1, (a & 1) * 3988292384))) AS crc
), said AS (
  SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) - 1 AS i FROM said
), convs AS (
  SELECT c, c - c % 100 AS base, xor({_CRC}, 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM said), crcs
), rebuilt AS (
  SELECT v.c, 0 AS own, i, chars, digest FROM convs v JOIN turns t ON t.c = v.base AND t.i < v.h
  UNION ALL SELECT v.c, 1, i, chars, digest FROM convs v JOIN turns t ON t.c = v.c AND t.i >= v.h
), steps AS (
  SELECT c, 0 AS depth, '' AS node, 0 AS chars FROM convs
  UNION ALL SELECT c, row_number() OVER w, sha256(string_agg(digest, '') OVER w), chars FROM rebuilt
  WINDOW w AS (PARTITION BY c ORDER BY own, i)
), ended AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY c) AS is_end FROM steps
), nodes AS (
  SELECT depth, node, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM ended GROUP BY 1, 2
), parents AS (
  SELECT n.*, s.node AS parent FROM nodes n LEFT JOIN steps s ON s.c = n.conv_id AND s.depth = n.depth - 1
), children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY 1, 2
), full_nodes AS (
  SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN children USING (depth, node)
), below AS (
  SELECT s.depth, s.node, sum(f.saved) AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves
  FROM full_nodes f JOIN steps s ON s.c = f.conv_id AND s.depth <= f.depth GROUP BY 1, 2
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b ON b.depth = f.depth AND b.node = f.node
LEFT JOIN nodes p ON p.depth = f.depth - 1 AND p.node = f.parent
"""

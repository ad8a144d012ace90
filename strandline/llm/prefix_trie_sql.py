"""The conversation prefix trie as DuckDB SQL, with the CRC-32 of the ids bit by bit."""

from __future__ import annotations

#: Unsigned CRC-32 of a decimal number; 3988292384 is the reversed polynomial.
_CRC = """xor(list_reduce(
    list_concat([4294967295::BIGINT],
                list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
    4294967295::BIGINT)"""


def prefix_trie_sql(stride: int = 20, starts: int = 4) -> str:
    crc = _CRC.format(c="c")
    return f"""
WITH said AS (
    SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT c, md5(length(role) || ':' || role || text) AS id,
           len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words,
           row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS k
    FROM said),
convs AS (SELECT c, c - c % {stride} AS base, {crc} % {starts} AS h FROM (SELECT DISTINCT c FROM own)),
rebuilt AS (
    SELECT convs.c, k, id, words FROM convs JOIN own ON own.c = base AND k <= h
    UNION ALL SELECT own.c, k, id, words FROM own JOIN convs USING (c) WHERE k > h),
placed AS (
    SELECT c, words, row_number() OVER w AS d, md5(string_agg(id, '') OVER w) AS p
    FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY k)),
members AS (SELECT c, 0 AS d, '' AS p, 0 AS words FROM convs UNION ALL SELECT c, d, p, words FROM placed),
linked AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS parent FROM members),
nodes AS (
    SELECT p, d, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
           (count(*) - 1) * min(words) AS saved
    FROM linked GROUP BY p, d),
children AS (SELECT parent AS p, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (
    SELECT DISTINCT a.p AS top, b.p FROM members a JOIN members b ON a.c = b.c AND b.d >= a.d),
sums AS (
    SELECT top, count(*) FILTER (WHERE n IS NULL) AS n_leaves, sum(saved) AS saved_tokens
    FROM under JOIN nodes USING (p) LEFT JOIN children USING (p) GROUP BY top),
last AS (SELECT c, arg_max(p, d) AS p FROM members GROUP BY c),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM last GROUP BY p)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs,
       coalesce(children.n, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes LEFT JOIN nodes up ON up.p = nodes.parent LEFT JOIN children ON children.p = nodes.p
JOIN sums ON top = nodes.p LEFT JOIN ends ON ends.p = nodes.p
"""

"""The divergence rules as DuckDB SQL, from the same fixed values."""

from __future__ import annotations

from strandline.llm.quality_rules import CLASSES, COMMON_WORDS


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def divergence_sql(
    min_words: int = 50,
    min_texts: int = 20,
    class_limit: float = 0.12,
    class_slack: float = 0.9,
    word_limit: float = 0.08,
    word_slack: float = 2.9,
) -> str:
    every = _listed(sorted({w for known in COMMON_WORDS.values() for w in known}))
    cases = " ".join(f"WHEN '{name}' THEN {_listed(w)}" for name, w in COMMON_WORDS.items())
    classes = ", ".join(
        f"length(text) - length(regexp_replace(text, '{c.replace(chr(39), chr(39) * 2)}+', '', 'g'))" for c in CLASSES
    )
    half = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(kind: str) -> str:
        return f"""
{kind}_pairs AS (
    SELECT row, lang, i, n * 1.0 / sum(n) OVER (PARTITION BY row) AS p,
           ref * 1.0 / sum(ref) OVER (PARTITION BY row) AS q
    FROM (SELECT b.row, b.lang, b.i, b.n, r.ref FROM {kind}_bins b
          JOIN {kind}_refs r ON b.lang = r.lang AND b.i = r.i WHERE b.n_words >= {min_words})),
{kind}_distance AS (
    SELECT row, sqrt(greatest(sum({half.format(a="p", b="q")} + {half.format(a="q", b="p")}) / 2, 0)) AS far
    FROM {kind}_pairs GROUP BY row)"""

    def bins(kind: str) -> str:
        return f"""
{kind}_bins AS (
    SELECT row, lang, n_words, base_failed, unnest({kind}) AS n, generate_subscripts({kind}, 1) AS i
    FROM (SELECT row, lang, n_words, base_failed, list_append({kind}, rest_{kind}) AS {kind} FROM counted)),
{kind}_refs AS (
    SELECT lang, i, sum(floor(n * 1000000.0 / greatest(total, 1)))::BIGINT AS ref
    FROM (SELECT *, sum(n) OVER (PARTITION BY row) AS total FROM {kind}_bins)
    WHERE NOT base_failed AND n_words >= {min_words}
    GROUP BY lang, i HAVING count(*) >= {min_texts})"""

    return rf"""
WITH split AS (
    SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
           coalesce(lang, '') AS lang,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')
               AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
grams AS (
    SELECT row, i, array_to_string(words[i:i + 7], ' ') AS g
    FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
again AS (
    SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM grams)
    WHERE c > 1),
covered AS (
    SELECT row, count(DISTINCT i + k) AS n FROM again, range(8) AS t(k) GROUP BY row),
base AS (
    SELECT s.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words,
           len(words) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(words) AS base_failed,
           [{classes}] AS classes,
           list_transform(CASE lang {cases} ELSE {every} END,
                          lambda v: len(list_filter(words, lambda x: x = v))) AS common
    FROM split s LEFT JOIN covered c ON s.row = c.row),
counted AS (
    SELECT *, length(text) - list_sum(classes)::BIGINT AS rest_classes,
           n_words - list_sum(common)::BIGINT AS rest_common
    FROM base),{bins("classes")},{bins("common")},{distance("classes")},{distance("common")}
SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words,
       b.base_failed,
       NOT b.base_failed
           AND coalesce(c.far, 0) <= {class_limit} + {class_slack} / sqrt(greatest(b.n_words, 1))
           AND coalesce(w.far, 0) <= {word_limit} + {word_slack} / sqrt(greatest(b.n_words, 1)) AS kept
FROM base b LEFT JOIN classes_distance c ON b.row = c.row
LEFT JOIN common_distance w ON b.row = w.row
"""

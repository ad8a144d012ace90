"""Quality rules by distribution divergence.

A text has two histograms: character classes, and the common words of its language (with all
other words as one more bin). Each language's reference is the mean histogram of its texts that
pass the base rules and are long enough, every text with the same weight. A text is rejected if
the Jensen-Shannon distance (base 2, 0 to 1) to its language's reference exceeds a limit that
widens as ``slack / sqrt(words)`` for short texts, whose histograms are noisy. Texts below
``min_words`` and languages with fewer than ``min_texts`` texts are not judged.

Built-in column functions only. References are summed as integers, so they do not depend on the
order of rows; they are one row per language, counted before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.arrays import gram_hash, let, positions, split_words
from strandline.llm.staging import staged

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Shares are summed in parts per million.
UNIT = 1_000_000
#: References beyond this many languages are joined without a broadcast.
BROADCAST_ROWS = 10_000

# The commonest words of four languages, and character classes as patterns.
COMMON_WORDS = {
    "en": "the of and to a in is that it for was on with be as by this at are from".split(),
    "fr": "de la le et les des en un du une est que pour qui dans au sur pas par avec".split(),
    "de": "der die und in den von zu das sich mit des auf für ist nicht im eine dem ein als".split(),
    "es": "de la que el en y a los se del un las por con no para una su es al".split(),
}
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{N}", r"[\x20\x09-\x0D]", r"[.,;:?'()-]")


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of eight that occur twice or more in the text."""

    def covered(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        repeated = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, i: F.struct(
                (i + WINDOW).alias("end"),
                (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n"),
            ),
            lambda acc: acc["n"],
        )

    def count(grams: Column) -> Column:
        pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        once = F.size(F.array_distinct(grams)) == F.size(grams)
        return F.when(once, 0).otherwise(let(F.array_sort(pairs), covered))

    at = positions(F.size(words) - (WINDOW - 1))
    return let(F.transform(at, lambda i: gram_hash(words, i, WINDOW)), count)


def _word_counts(words: Column, lang: Column) -> Column:
    every = sorted({w for known in COMMON_WORDS.values() for w in known})
    listed = F.array(*[F.lit(w) for w in every])
    for name, known in COMMON_WORDS.items():
        listed = F.when(lang == name, F.array(*[F.lit(w) for w in known])).otherwise(listed)
    common = F.filter(words, lambda w: w.isin(every))
    counts = let(
        common, lambda c: F.transform(listed, lambda v: F.size(F.filter(c, lambda x: x == v)))
    )
    return let(counts, lambda n: F.concat(n, F.array(F.size(words) - _total(n))))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, n: a + n)


def _class_counts(text: Column) -> Column:
    of = [F.length(text) - F.length(F.regexp_replace(text, f"{c}+", "")) for c in CLASSES]
    return let(F.array(*of), lambda n: F.concat(n, F.array(F.length(text) - _total(n))))


def shares(counts: Column) -> Column:
    """Counts as parts per million of their sum, rounded down."""
    return let(
        counts,
        lambda c: F.transform(
            c, lambda n: F.floor(n.cast("double") * UNIT / F.greatest(_total(c), F.lit(1)))
        ),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two non-negative arrays; each is normalised."""

    def of(pair: Column) -> Column:
        total = lambda side: F.aggregate(
            pair, F.lit(0.0), lambda a, x: a + x[side].cast("double")
        )
        part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
        half = lambda sums: F.aggregate(
            pair,
            F.lit(0.0),
            lambda acc, x: acc
            + part(x["p"] / sums["p"], x["q"] / sums["q"])
            + part(x["q"] / sums["q"], x["p"] / sums["p"]),
        )
        sums = F.struct(
            F.greatest(total("p"), F.lit(1e-9)).alias("p"),
            F.greatest(total("q"), F.lit(1e-9)).alias("q"),
        )
        return F.sqrt(F.greatest(let(sums, half) / 2, F.lit(0.0)))

    return let(F.zip_with(p, q, lambda a, b: F.struct(a.alias("p"), b.alias("q"))), of)


def measured(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """One row per row of ``docs``: the base counts, ``base_failed``, and both histograms."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang = F.coalesce(F.col(lang_col), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            _word_counts(words, lang).alias("words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        lang.alias("lang"),
        let(split_words(text, BLANKS), of_words).alias("of"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _class_counts(text).alias("classes"),
    ).select(
        "doc_id", "lang", "of.n_words", "of.word_chars", "n_symbols", "n_dup_lines",
        "of.n_repeat_words",
        ((F.col("of.n_words") < 20) | (100 * F.col("of.n_repeat_words") > 30 * F.col("of.n_words")))
        .alias("base_failed"),
        "classes", "of.words",
    )


def references(rows: DataFrame, min_words: int, min_texts: int) -> DataFrame:
    """(lang, ref_classes, ref_words) from all texts that pass the base rules."""
    n_words = 1 + max(len({w for k in COMMON_WORDS.values() for w in k}), 20)
    summed = lambda name, n: F.array(
        *[F.coalesce(F.sum(F.get(name, i)), F.lit(0)) for i in range(n)]
    )
    return (
        rows.where(~F.col("base_failed") & (F.col("n_words") >= min_words))
        .select("lang", shares(F.col("classes")).alias("c"), shares(F.col("words")).alias("w"))
        .groupBy("lang")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            summed("c", len(CLASSES) + 1).alias("ref_classes"),
            summed("w", n_words).alias("ref_words"),
        )
        .where(F.col("texts") >= min_texts)
        .drop("texts")
    )


def judged(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    min_texts: int = 20,
    class_limit: float = 0.12,
    class_slack: float = 0.9,
    word_limit: float = 0.08,
    word_slack: float = 2.9,
) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance (NULL where not judged).

    A NULL text counts as empty, so it fails the base rule on length. A NULL language is a
    language of its own. Rows with a NULL id and repeated rows are rows like any other. Other
    columns are not read.
    """
    rows = staged(measured(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    refs = staged(references(rows, min_words, min_texts))
    if refs.count() <= BROADCAST_ROWS:
        refs = F.broadcast(refs)
    long_enough = F.col("n_words") >= min_words
    size = F.size("words")
    distances = rows.join(refs, "lang", "left").select(
        "*",
        F.when(long_enough, js_distance(F.col("classes"), F.col("ref_classes"))).alias("class_distance"),
        F.when(long_enough, js_distance(F.col("words"), F.slice("ref_words", 1, size))).alias("word_distance"),
    )
    over = lambda name, limit, slack: F.coalesce(
        F.col(name) > limit + slack / F.sqrt("n_words"), F.lit(False)
    )
    rejected = over("class_distance", class_limit, class_slack) | over(
        "word_distance", word_limit, word_slack
    )
    return distances.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"),
        "class_distance", "word_distance",
    )

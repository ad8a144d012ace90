"""Benchmark decontamination with SimHash over windows of an item's size.

A window has as many words as the item it may match. Its similarity to an item is
sum(w * min) / sum(w * max) over the multisets of five-word shingles, where a shingle weighs its
code points. Steps:

1. Windows. Every window that reaches the similarity holds one of the item's seed shingles
   (those that fewest items have, until their weight exceeds the share that may be missing), at any offset:
   words may be inserted, left out or moved before it. So wherever a text meets a seed, all
   windows of the item's size that hold it are laid, each once. A bitmap of fixed size, whatever
   the benchmark's, thins the texts' shingles in the scan; the exact join follows.
2. Fingerprints. Windows and items get a 64-bit SimHash of their weighted shingles. Windows that
   touch are fingerprinted together: the 64 sums slide by one shingle from window to window.
3. Multi-index. A fingerprint is cut into ``BLOCKS`` blocks; block b has a threshold t_b, and the
   sum of t_b + 1 is radius + 1, so two fingerprints within the radius agree in some block up to
   its threshold. Every item is indexed under (size, block, value) for all such values; distinct
   fingerprints of windows look their own blocks up, which finds all items of the window's size
   within ``radius`` bits. Shingle sets at a similarity of 0.8 differ in 9 bits on average; 3 in
   10,000 exceed the radius of 20.
4. Verification by the exact similarity.

Everything is built-in column functions and joins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.arrays import free_names, gram_hash, let, positions, split_words
from strandline.llm.staging import staged

SEPARATORS = r"[^\p{L}\p{N}]+"
BITS = 64
BLOCKS = 4
WIDTH = BITS // BLOCKS
#: Two 32-bit lanes in a long: bit j of a hash counts in the lower one, bit j + 32 in the upper.
LANES = (1 << 32) + 1
#: log2 of the bitmap's size at most: half a megabyte.
MAX_BITMAP = 22


def words_of(text: Column) -> Column:
    return split_words(F.lower(text), SEPARATORS)


def shingles(words: Column, size: int) -> Column:
    return F.transform(
        positions(F.size(words) - (size - 1)),
        lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)]),
    )


def weights(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda total, s: total + F.length(s))


def weighted(parts: Column) -> Column:
    return F.transform(parts, lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).alias("w")))


def simhash(pairs: Column) -> Column:
    """64 bits over hashes and weights; a bit is set if parts of over half the weight have it."""

    def of(pairs: Column) -> Column:
        total = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x["w"])

        def bit(acc: Column, b: Column) -> Column:
            ones = F.aggregate(
                pairs,
                F.lit(0),
                lambda n, x: n
                + F.when(_shift_right(x["h"], b).bitwiseAND(F.lit(1)) == 1, x["w"]).otherwise(0),
            )
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), b)
            return F.when(2 * ones > total, acc.bitwiseOR(mask)).otherwise(acc)

        return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), bit)

    return let(pairs, of)


def _shift_right(value: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, by)


def _shift_left(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by)


def sliding_simhashes(pairs: Column, first: Column, last: Column, width: Column) -> Column:
    """The ``simhash`` of the windows of ``width`` parts that start at ``first`` .. ``last``, in
    order. Starts may be negative and windows may pass the end of ``pairs``: what lies outside is
    not in them. A window's weight must be below 2**30.

    One pass over the parts: the part that enters is added, the one that leaves is taken off.
    """
    none = F.lit(0).cast("long")
    lanes = F.lit(LANES)

    def share(h: Column, w: Column, j: Column) -> Column:
        return _shift_right(h, j).bitwiseAND(lanes) * w

    def moved(at: Column) -> Column:
        new, old = F.get(pairs, at), F.get(pairs, at - width)
        return F.struct(
            *[
                F.coalesce(x[part].cast("long"), none).alias(name)
                for x, part, name in [(new, "h", "h"), (new, "w", "w"), (old, "h", "g"), (old, "w", "v")]
            ]
        )

    def fingerprint(sums: Column, total: Column) -> Column:
        """Bit 30 of a lane of 2 * sum - total - 1 + 2**30 is set if the sum is over half."""
        half = (F.lit(1 << 30) - F.lit(1) - total) * lanes
        bits = F.transform(
            sums,
            lambda x, j: _shift_left(
                _shift_right(_shift_left(x, F.lit(1)) + half, F.lit(30)).bitwiseAND(lanes), j
            ),
        )
        return F.aggregate(bits, none, lambda acc, x: acc.bitwiseOR(x))

    def step(acc: Column, at: Column) -> Column:
        def added(x: Column) -> Column:
            sums = F.transform(
                acc["sums"], lambda s, j: s + share(x["h"], x["w"], j) - share(x["g"], x["v"], j)
            )
            return F.struct(sums.alias("sums"), (acc["total"] + x["w"] - x["v"]).alias("total"))

        def out(now: Column) -> Column:
            full = F.concat(acc["out"], F.array(fingerprint(now["sums"], now["total"])))
            return F.struct(
                now["sums"].alias("sums"),
                now["total"].alias("total"),
                F.when(at >= first + width - 1, full).otherwise(acc["out"]).alias("out"),
            )

        return let(let(moved(at), added), out)

    start = F.struct(
        F.array_repeat(none, 32).alias("sums"),
        none.alias("total"),
        F.array().cast("array<bigint>").alias("out"),
    )
    steps = F.sequence(F.greatest(first, F.lit(0)), last + width - 1)
    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def thresholds(radius: int) -> list[int]:
    """Of every block; -1: the block is not looked at."""
    each, more = divmod(radius + 1, BLOCKS)
    return [each + (b < more) - 1 for b in range(BLOCKS)]


def _block(fp: Column, b: Column | int) -> Column:
    by = F.lit(b * WIDTH) if isinstance(b, int) else b * WIDTH
    return _shift_right(fp, by).bitwiseAND(F.lit((1 << WIDTH) - 1))


def near_items(prints: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(size, fp, item_fp): all pairs of ``prints`` and ``items``, both (size, fp), of equal size
    that differ in at most ``radius`` bits, each once."""
    most = [min(t, WIDTH) for t in thresholds(radius)]
    flips = sorted((x for x in range(1 << WIDTH) if x.bit_count() <= max(most)), key=int.bit_count)
    known = F.from_json(F.lit(json.dumps(flips)), "array<bigint>")
    blocks = [
        F.struct(F.lit(b).alias("block"), F.lit(sum(x.bit_count() <= t for x in flips)).alias("n"))
        for b, t in enumerate(most)
        if t >= 0
    ]
    index = (
        items.select("size", F.col("fp").alias("item_fp"))
        .distinct()
        .select("size", "item_fp", F.inline(F.array(*blocks)))
        .select("size", "item_fp", "block", F.explode(F.slice(known, F.lit(1), F.col("n"))).alias("flip"))
        .select(
            "size", "block", "item_fp",
            _block(F.col("item_fp"), F.col("block")).bitwiseXOR(F.col("flip")).alias("value"),
        )
    )
    own = [
        F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value"))
        for b, t in enumerate(most)
        if t >= 0
    ]
    probes = prints.select("size", "fp").distinct().select("size", "fp", F.inline(F.array(*own)))
    # The planner sees the size of the items' table, not of the index made from it, and would
    # broadcast all of the index through the driver.
    return (
        probes.join(index.hint("merge"), ["size", "block", "value"])
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        .select("size", "fp", "item_fp")
        .distinct()
    )


def prepared_items(
    items: DataFrame, *, id_col: str, text_col: str, shingle: int
) -> DataFrame:
    """(item_id, size, parts, weight, fp). Items below ``shingle`` words have no shingle and are
    left out, as are rows without an id; repeated rows count once."""
    return (
        items.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
        .where(F.size("words") >= shingle)
        .distinct()
        .select("item_id", F.size("words").alias("size"), shingles(F.col("words"), shingle).alias("parts"))
        .select("*", weights(F.col("parts")).alias("weight"), simhash(weighted(F.col("parts"))).alias("fp"))
    )


def seeds(items: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(h, item_id, size): shingles of every item, those that fewest items have first and among
    these the heaviest, until what is left out weighs less than the similarity needs. A phrase that
    many items share is thus a seed only of items that have little else."""
    each = items.select("item_id", "size", "weight", F.explode("parts").alias("s"))
    spread = each.groupBy("s").agg(F.count_distinct("item_id", "size").alias("n_items"))
    ranked = F.array_sort(
        F.collect_list(F.struct("n_items", (-F.length("s")).alias("lighter"), "s"))
    )
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("taken"))
    spare = (1 - similarity + 1e-9) * F.col("weight")  # rounding may not end the list early
    counted = F.aggregate(
        "ranked",
        start,
        lambda acc, x: F.struct(
            (acc["sum"] - x["lighter"]).alias("sum"),
            (acc["taken"] + F.when(acc["sum"] <= spare, 1).otherwise(0)).alias("taken"),
        ),
    )
    return (
        each.join(spread, "s")
        .groupBy("item_id", "size", "weight")
        .agg(ranked.alias("ranked"))
        .select("item_id", "size", F.inline(F.slice("ranked", 1, counted["taken"])))
        .select(
            let(F.split("s", " "), lambda w: gram_hash(w, F.lit(0), shingle)).alias("h"), "item_id", "size"
        )
        .distinct()
    )


def _places(h: Column, log2: int) -> list[tuple[Column, Column]]:
    """The two (slot, bit) places of a key in a bitmap of 2**log2 bits."""
    mask = F.lit((1 << log2) - 1)
    halves = [h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)]
    return [
        (F.shiftright(x, 6).cast("int"), x.bitwiseAND(F.lit(63)).cast("int")) for x in halves
    ]


def bitmap(keys: DataFrame, log2: int) -> list[int]:
    """A Bloom filter of 2**log2 bits as longs; what is collected has a fixed size."""
    one = F.lit(1).cast("long")
    places = F.array(
        *[
            F.struct(slot.alias("slot"), F.call_function("shiftleft", one, low).alias("bit"))
            for slot, low in _places(F.col("h"), log2)
        ]
    )
    found = keys.select(F.inline(places)).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    out = [0] * (1 << (log2 - 6))
    for r in found.collect():
        out[r.slot] = r.bits
    return out


def matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 20,
) -> DataFrame:
    """One row per row of ``docs`` and item that match: doc_id, text_hash, item_id, similarity
    (of the best window), n_windows, first_word (the earliest window's start).

    Words are runs of letters and digits in lower case. Texts that are NULL, empty or below
    ``shingle`` words match nothing. Rows with a NULL id are searched like any other; repeated
    rows are one. Windows end at the text's ends. Other columns are not read.
    """
    known = staged(
        prepared_items(items, id_col=item_id_col, text_col=item_text_col, shingle=shingle)
    )
    wanted = staged(seeds(known, similarity, shingle))
    log2 = min(MAX_BITMAP, max(12, (512 * wanted.count()).bit_length()))
    bits = F.from_json(F.lit(json.dumps(bitmap(wanted, log2))), "array<bigint>")

    def marked(h: Column) -> Column:
        first, second = (
            _shift_right(F.get(bits, slot), low).bitwiseAND(F.lit(1)) == 1
            for slot, low in _places(h, log2)
        )
        return first & second

    def hits(words: Column) -> Column:
        hashes = F.transform(
            positions(F.size(words) - (shingle - 1)), lambda i: gram_hash(words, i, shingle)
        )
        found = F.transform(
            hashes, lambda h, i: F.when(marked(h), F.struct(i.alias("pos"), h.alias("h")))
        )
        return F.struct(
            words.alias("words"), F.filter(found, lambda x: x.isNotNull()).alias("hits")
        )

    read = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.xxhash64(text_col).alias("text_hash"),
            let(words_of(F.col(text_col)), hits).alias("found"),
        )
        .where(F.size("found.hits") > 0)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", "found.*")
    )
    laid = (
        read.select("row", F.inline("hits"))
        .join(wanted, "h")
        .groupBy("row", "size")
        .agg(F.array_sort(F.collect_set("pos")).alias("pos"))
    )
    # A hit is in the windows that start in the `width` places up to its own. Runs of such starts
    # that touch are cut into stretches, so that what is held at once grows with the item alone.
    width = F.col("size") - (shingle - 1)
    long = 2 * width + 64

    def runs(heads: Column) -> Column:
        return F.transform(
            heads,
            lambda i, k: F.struct(
                (F.get("pos", i) - width + 1).alias("low"),
                F.get("pos", F.coalesce(F.get(heads, k + 1), F.size("pos")) - 1).alias("high"),
            ),
        )

    def stretches(run: Column) -> Column:
        return F.transform(
            F.sequence(run["low"], run["high"], long),
            lambda low: F.struct(low.alias("low"), F.least(low + long - 1, run["high"]).alias("high")),
        )

    def with_words(x: Column) -> Column:
        base = F.greatest(x["low"], F.lit(0))
        length = F.least(x["high"] + F.col("size"), "n_words") - base
        return F.struct(x["low"], x["high"], base.alias("base"),
                        F.slice("words", base + 1, length).alias("near"))

    heads = F.filter(
        positions(F.size("pos")),
        lambda i: (i == 0) | (F.get("pos", i) - F.get("pos", i - 1) > width),
    )
    spans = staged(
        laid.join(read.drop("hits"), "row")
        .withColumn("n_words", F.size("words"))
        .select("doc_id", "text_hash", "size", "n_words",
                F.inline(F.transform(F.flatten(F.transform(let(heads, runs), stretches)), with_words)))
        .select(
            F.monotonically_increasing_id().alias("span"), "*",
            let(
                weighted(shingles(F.col("near"), shingle)),
                lambda pairs: sliding_simhashes(
                    pairs, F.col("low") - F.col("base"), F.col("high") - F.col("base"), width
                ),
            ).alias("fps"),
        )
    )
    windows = spans.select("span", "size", F.posexplode("fps").alias("k", "fp"))
    start = F.col("low") + F.col("k")
    first = F.greatest(start, F.lit(0))
    inside = F.slice("near", first - F.col("base") + 1, F.least(start + F.col("size"), "n_words") - first)
    candidates = (
        windows.join(near_items(windows, known, radius), ["size", "fp"])
        .select("span", "k", "item_fp")
        .join(spans.drop("fps"), "span")
        .join(
            known.select("size", F.col("fp").alias("item_fp"), "item_id",
                         F.col("parts").alias("item_parts"), F.col("weight").alias("item_weight")),
            ["size", "item_fp"],
        )
    )
    times = lambda parts, s: F.size(F.filter(parts, lambda x: x == s))

    def similar(parts: Column) -> Column:
        item = F.col("item_parts")
        common = F.array_intersect(parts, item)
        single = [F.size(F.array_distinct(x)) == F.size(x) for x in (parts, item)]
        several = F.aggregate(
            common,
            F.lit(0),
            lambda total, s: total + F.length(s) * F.least(times(parts, s), times(item, s)),
        )
        shared = F.when(single[0] | single[1], weights(common)).otherwise(several)
        both = weights(parts) + F.col("item_weight")
        return let(shared, lambda n: n / (both - n))

    return (
        candidates.select("doc_id", "text_hash", "item_id", first.alias("first"),
                          let(let(inside, lambda x: shingles(x, shingle)), similar).alias("similarity"))
        .where(F.col("similarity") >= similarity)
        .groupBy("doc_id", "text_hash", "item_id")
        .agg(
            F.max("similarity").alias("similarity"),
            F.count_distinct("first").alias("n_windows"),
            F.min("first").cast("long").alias("first_word"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text matches an item; all columns pass."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    own, hashed = free_names(docs, "match_id", "match_hash")
    found = matches(docs, items, **options).select(
        F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)
    )
    same = F.col(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(text_col) == F.col(hashed))
    return docs.join(found.distinct(), same, "left_anti")

"""Line deduplication over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, keep), bucketed and sorted by the two hashes, so that joining
and merging runs moves no rows. Batches of documents arrive in descending id order. Each
batch's keys are merge-joined with all runs: a key that no run holds (the anti-join) is met
for the first time and so names its largest document; a known key only adds its count. The
result becomes a run of level 0, and ``fanout`` runs of one level are merged into one of the
next. After the last batch the runs hold every key's number of documents and largest document.

Keys are two 64-bit hashes, and rows of a batch are counted per task before they are shuffled,
so a line that a third of all documents share is one row per task.
"""

from __future__ import annotations

import functools
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.arrays import free_names
from strandline.llm.staging import staged, staging_dir

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h1", "h2"]


class Runs:
    """The levels of sorted runs. ``levels[k]`` lists the runs of level k, oldest first."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"llm_run_{uuid4().hex}"
        (
            keys.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY)
            .sortBy(*KEY)
            .option("path", f"{staging_dir(self.spark)}/{name}")
            .saveAsTable(name)
        )
        return name

    def _push(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(old)))
            self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """One run of several: a key is once in each, so an outer merge join adds them up."""

        def both(a: DataFrame, name: str) -> DataFrame:
            b = self.spark.table(name).select(
                *KEY, F.col("n_docs").alias("more"), F.col("keep").alias("other")
            )
            zero = F.lit(0)
            return a.join(b.hint("merge"), KEY, "full").select(
                *KEY,
                (F.coalesce("n_docs", zero) + F.coalesce("more", zero)).alias("n_docs"),
                F.greatest("keep", "other").alias("keep"),
            )

        return functools.reduce(both, names[1:], self.spark.table(names[0]))

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, keys: DataFrame) -> None:
        """Merge-join the batch's keys (h1, h2, n_docs, keep) with the runs and add them."""
        known = F.lit(False)
        for i, name in enumerate(self.names):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"in{i}"))
            keys = keys.join(run.hint("merge"), KEY, "left")
            known = known | F.col(f"in{i}").isNotNull()
        self._push(
            0, self._write(keys.select(*KEY, "n_docs", F.when(~known, F.col("keep")).alias("keep")))
        )

    def repeated(self, least: int) -> DataFrame:
        """(h1, h2, keep) of keys in at least ``least`` documents, as a table of its own; the
        runs are gone afterwards."""
        if not self.names:
            raise ValueError("no batch was added")
        found = staged(self._merged(self.names).where(F.col("n_docs") >= least).drop("n_docs"))
        self._drop(self.names)
        self.levels = []
        return found


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the sorted positions ``dropped``, joined, in one pass over both."""
    ends = F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines)))

    def between(end: Column) -> Column:
        return F.transform(
            F.slice(end, 2, F.size(end) - 1),
            lambda stop, i: F.slice(lines, F.get(end, i) + 2, stop - F.get(end, i) - 1),
        )

    return F.array_join(F.flatten(F.get(F.transform(F.array(ends), between), 0)), "\n")


def drop_repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fanout: int = 2,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """``docs`` with the text's repeated lines dropped, and its lines and dropped lines counted
    in two columns named by ``counts``, which replace columns of these names.

    A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose their lines except
    in the largest id holding them. A NULL text is one empty line; a text that lost nothing
    stays NULL or as it was. Rows with a NULL id are counted in no key and lose nothing.
    Repeated rows of an id are one document and are treated alike. Ids must be numbers. All
    other columns pass.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.NumericType):
        raise TypeError(f"ids must be numbers, {id_col} is {docs.schema[id_col].dataType.simpleString()}")
    line = F.btrim(F.col("col"), F.lit(BLANKS))
    lines = staged(
        docs.where(F.col(id_col).isNotNull())
        .select(
            F.col(id_col).alias("doc"),
            F.xxhash64(text_col).alias("row"),
            F.posexplode(lines_of(F.col(text_col))),
        )
        .select("doc", "row", "pos", line.alias("line"))
        .where(F.length("line") >= min_chars)
        .select("doc", "row", "pos", F.translate("line", UPPER, UPPER.lower()).alias("line"))
        .select(
            "doc",
            "row",
            "pos",
            F.xxhash64("line").alias("h1"),
            F.xxhash64(F.lit(1), F.col("line")).alias("h2"),
        )
    )
    shares = [k / batches for k in range(1, batches)]
    cuts = lines.agg(F.percentile_approx("doc", shares, 1000)).first()[0] if shares else None
    edges = [None, *sorted(set(cuts or ())), None]
    runs = Runs(spark, fanout)
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        here = lines if low is None else lines.where(F.col("doc") > low)
        here = here if high is None else here.where(F.col("doc") <= high)
        runs.add(
            here.select(*KEY, "doc")
            .distinct()
            .groupBy(*KEY)
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keep"))
        )
    doc, row, gone, own = free_names(docs, "lost_doc", "lost_row", "lost_lines", "text_row")
    lost = (
        lines.join(runs.repeated(min_docs), KEY)
        .where(F.col("doc") != F.col("keep"))
        .groupBy(F.col("doc").alias(doc), F.col("row").alias(row))
        .agg(F.array_sort(F.collect_set("pos")).alias(gone))
    )
    text = F.col(text_col)
    joined = docs.withColumn(own, F.xxhash64(text_col)).join(
        lost.hint("shuffle_hash"),
        (F.col(id_col) == F.col(doc)) & (F.col(own) == F.col(row)),
        "left",
    )
    kept = F.get(F.transform(F.array(lines_of(text)), lambda w: without(w, F.col(gone))), 0)
    return joined.withColumns(
        {
            counts[0]: F.size(lines_of(text)).cast("long"),
            counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            text_col: F.when(F.col(gone).isNull(), text).otherwise(kept),
        }
    ).drop(doc, row, gone, own)

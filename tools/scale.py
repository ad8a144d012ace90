"""Time the row-level operators on generated rows with a third of them in one site.

    python tools/scale.py [million rows] [operator ...]
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from strandline.functions.classify import decorate  # noqa: E402
from strandline.operators.groups import with_group_count  # noqa: E402
from strandline.operators.ranking import row_numbers  # noqa: E402
from strandline.plans import distribution as dist  # noqa: E402
from strandline.plans import exceedance as ex  # noqa: E402
from strandline.plans import persistence as ps  # noqa: E402
from strandline.session import get_spark  # noqa: E402


def generate(spark, millions: float, path: str):
    """Ten years of samples; site 0 has a third of them, the others about 3,000 each."""
    n = int(millions * 1_000_000)
    mix = F.xxhash64("id")
    spread = F.pmod(mix, F.lit(n // 4500 + 1))
    rows = spark.range(0, n, 1, 64).select(
        "id",
        F.when(F.pmod(F.col("id"), F.lit(3)) == 0, F.lit("S0"))
        .otherwise(F.concat(F.lit("S"), (spread + 1).cast("string")))
        .alias("SAMPLE_POINT_NAME"),
        F.concat(F.lit("B"), F.pmod(spread, F.lit(97)).cast("string")).alias("SITE_NAME"),
        F.timestamp_seconds(1136073600 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(315_000_000)))
        .cast("timestamp_ntz")
        .alias("SAMPLE_DATE"),
        F.exp(F.randn(5) * 1.5 + 3).alias("ENTEROCOCCI"),
        (F.pmod(mix, F.lit(11)) == 0).alias("RESAMPLE"),
        (F.pmod(mix, F.lit(13)) == 0).alias("OTHER"),
    )
    rows.withColumn("YEAR", F.year("SAMPLE_DATE")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    millions = float(sys.argv[1]) if len(sys.argv) > 1 else 10
    only = sys.argv[2:]
    spark = get_spark("scale", "local[8]", **{
        "spark.sql.shuffle.partitions": "64", "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    df = generate(spark, millions, tempfile.mkdtemp(prefix="run-") + "/samples")
    samples = decorate(df)
    jobs = {
        "site_year": lambda: ex.class_counts_by_site_year(df),
        "previous_row": lambda: ps.with_previous_sample(samples),
        "site_statistics": lambda: ex.site_statistics(df),
        "percentile": lambda: df.groupBy("SAMPLE_POINT_NAME").agg(F.median("ENTEROCOCCI")),
        "box_stats": lambda: dist.box_stats(df, ["SAMPLE_POINT_NAME"], log10=True),
        "row_numbers": lambda: row_numbers(
            df.select("id", "SAMPLE_POINT_NAME", "SAMPLE_DATE"),
            [F.col("SAMPLE_DATE").asc(), F.col("id").asc()],
            ["SAMPLE_POINT_NAME"],
        ),
        "group_count": lambda: with_group_count(df, ["SAMPLE_POINT_NAME"]),
        "share_cdf": lambda: dist.share_cdf(samples, "SAMPLE_POINT_NAME"),
    }
    for name, job in jobs.items():
        if only and name not in only:
            continue
        start = time.time()
        job().write.format("noop").mode("overwrite").save()
        print(f"{name:20s} {millions:g}M rows {time.time() - start:7.2f}s", flush=True)


if __name__ == "__main__":
    main()

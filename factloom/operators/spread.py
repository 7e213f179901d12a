"""Spread of repeated runs: a choice that never moves is stable, one that moves is compared with a coin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(runs: DataFrame) -> DataFrame:
    """name, arm, of, runs, kept list, least, most, median, stable, reading and the coin's expected, deviation, low and high, from (name, arm, run, kept, of)."""
    half, deviation = F.col("of") / 2, F.sqrt(F.col("of") * 0.25)
    rows = runs.groupBy("name", "arm").agg(
        F.max("of").alias("of"),
        F.count(F.lit(1)).alias("runs"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "kept"))), lambda x: x["kept"]).alias("kept"),
        F.min("kept").alias("least"),
        F.max("kept").alias("most"),
        F.median("kept").alias("median"),
    )
    stable = F.when(F.col("runs") >= 2, F.col("least") == F.col("most"))
    return rows.select(
        "*",
        stable.alias("stable"),
        F.when(stable.isNull(), "not repeated").when(stable, "stable").otherwise("moves").alias("reading"),
        half.alias("coin_expected"),
        F.bround(deviation, 2).alias("coin_deviation"),
        F.bround(half - 1.96 * deviation, 0).cast("long").alias("coin_low"),
        F.bround(half + 1.96 * deviation, 0).cast("long").alias("coin_high"),
    )

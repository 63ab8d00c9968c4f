"""Consecutive numbers over a whole table, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.session import cut_lineage

ROW_BITS = 33


def number_rows(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, 3, … in the given order, missing values last.

    A range-partitioned sort puts rows in order; Spark's increasing id then holds
    the partition and the place in it, and a table with one row per partition
    turns both into a number. The row's arrival id is a last sort column, so a
    large group of equal rows is split between partitions. The sorted rows are
    materialised, since both uses must see the same partitions.
    """
    arrival = df.withColumn("_arrival", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_last() for c in order]
    placed = cut_lineage(
        arrival.orderBy(*keys, "_arrival")
        .withColumn("_id", F.monotonically_increasing_id())
        .select(
            *df.columns,
            F.shiftright("_id", ROW_BITS).alias("_part"),
            F.col("_id").bitwiseAND((1 << ROW_BITS) - 1).alias("_place"),
        )
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    if not offsets:
        return placed.withColumn(name, F.lit(None).cast("long")).select(*df.columns, name)
    # One row per partition: its size is set by the shuffle, not by the data.
    table = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.join(F.broadcast(table), "_part").select(
        *df.columns, (F.col("_before") + F.col("_place") + 1).alias(name)
    )

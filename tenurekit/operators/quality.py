"""Checks on keys, row counts and values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.expressions import is_finite


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, one report."""
    return reduce(
        DataFrame.unionByName,
        (
            df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            for name, df in tables.items()
        ),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, or have a missing part."""
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return (
        df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing)
    )


def require_unique(df: DataFrame, keys: list[str], table: str) -> None:
    """Raise if the keys do not identify the rows."""
    example = duplicate_keys(df, keys).take(1)
    if example:
        raise ValueError(f"{table}: {keys} is not a key, see {example[0].asDict()}")


def nonfinite_pct(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of missing, NaN or infinite values, for columns that have any."""
    types = dict(df.dtypes)
    shares = df.agg(
        *(
            (F.avg(F.when(is_finite(c, types[c]), 0.0).otherwise(1.0)) * 100.0).alias(c)
            for c in columns
        )
    )
    return shares.unpivot([], columns, "feature", "pct").filter("pct > 0")


def dataset_summary(survival: DataFrame) -> DataFrame:
    """Users, variables and churn rate of a survival data set."""
    return survival.agg(
        F.count("*").alias("n_users"),
        F.lit(len(survival.columns)).cast("long").alias("n_variables"),
        F.round(F.avg("churned") * 100.0, 1).alias("churn_rate_pct"),
    )


def survival_label(survival: DataFrame) -> DataFrame:
    """Time and event of every user; fails on a time or event that cannot be one."""
    fits = (F.col("survival_time") > 0) & F.col("churned").isin(0, 1)
    wrong = F.raise_error(F.lit("survival time must be positive, churned 0 or 1"))
    checked = F.when(fits, F.col("survival_time")).otherwise(wrong.cast("double"))
    return survival.select(
        "user_id", checked.alias("survival_time"), F.col("churned").cast("int").alias("churned")
    )

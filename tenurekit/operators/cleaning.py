"""Rules that decide which users stay, applied to every table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.operators.activity import user_activity
from tenurekit.session import cut_lineage

Tables = dict[str, DataFrame]


def require_key(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Fail the job on a row without a key, instead of dropping or keeping it silently."""
    missing = F.raise_error(F.lit(f"row without {key}")).cast("boolean")
    return df.filter(F.when(F.col(key).isNotNull(), F.lit(True)).otherwise(missing))


def qualifying_users(activity: DataFrame, min_actions: int) -> DataFrame:
    """Users with at least ``min_actions`` events."""
    return (
        activity.groupBy("user_id")
        .agg(F.count("*").alias("n_events"))
        .filter(F.col("n_events") >= min_actions)
        .select("user_id")
    )


def keep_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the listed users only."""
    return df.join(users, "user_id", "left_semi")


def drop_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of all other users; rows without a user stay."""
    return df.join(users, "user_id", "left_anti")


def apply_min_actions(tables: Tables, min_actions: int) -> Tables:
    """All tables reduced to users with enough events."""
    activity = user_activity(tables["reviews"], tables["tips"])
    # Stored once; five tables are reduced by it.
    keep = cut_lineage(qualifying_users(activity, min_actions))
    return {name: keep_users(df, keep) for name, df in tables.items()}


def reactivated_users(activity: DataFrame, cutoff: date, idle_days: int) -> DataFrame:
    """Users idle for ``idle_days`` or more at the cutoff who came back after it."""
    idle_since = F.datediff(F.lit(cutoff), "date")
    seen = activity.groupBy("user_id").agg(
        F.bool_or(idle_since < 0).alias("came_back"),
        F.min(F.when(idle_since >= 0, idle_since)).alias("idle"),
    )
    return seen.filter(F.col("came_back") & (F.col("idle") >= idle_days)).select("user_id")


def drop_reactivated(tables: Tables, cutoff: date, idle_days: int) -> Tables:
    """All tables without the reactivated users."""
    activity = user_activity(tables["reviews"], tables["tips"])
    gone = cut_lineage(reactivated_users(activity, cutoff, idle_days))
    return {name: drop_users(df, gone) for name, df in tables.items()}

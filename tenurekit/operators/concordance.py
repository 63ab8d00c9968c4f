"""Exact concordance index without comparing all pairs in one place.

A pair of rows is comparable if the one with the smaller time had an event; at
equal times, if one had an event and the other was censored. It is concordant
if the row that failed first has the higher score.

Scores are cut into leaf ranges of limited size, leaves into groups of
``FANOUT``, those again, up to one group. Two rows are compared at the lowest
level where both are in the same group, so every pair is counted once. Times
are cut in the same way where there are many: inside each group of scores, two
rows are compared at the lowest level of time where both are in the same range.
A row stands there for all of its child range of scores and its child range of
times, and equal ones are merged on the map side.

So no group grows with the data. Above both leaves it has at most FANOUT x FANOUT
rows, at a leaf of times at most the rows of that leaf, and at a leaf of scores
at most that leaf's rows and FANOUT for a score that fills leaves alone.
"""

from __future__ import annotations

import json
import sys
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need not have this package installed: its task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT = 64
LEAF_ROWS = 100_000
PAIR_SCHEMA = (
    "score string, level int, concordant decimal(38,0), discordant decimal(38,0), "
    "tied decimal(38,0)"
)


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of products as a Python integer, safe beyond 64 bits."""
    if not len(a):
        return 0
    if float(a.max(initial=0)) * float(b.max(initial=0)) * len(a) < 2.0**62:
        return int(a @ b)
    return int(a.astype(object) @ b.astype(object))


def _later(group: np.ndarray, time: np.ndarray, n: np.ndarray, censored: np.ndarray) -> np.ndarray:
    """Rows each row precedes within its group: later ones, and censored ones at its time.

    The rows must be sorted by group, then time descending.
    """
    new_group = np.r_[True, group[1:] != group[:-1]]
    new_time = new_group | np.r_[True, time[1:] != time[:-1]]
    run = np.cumsum(new_time) - 1
    seen = np.r_[0, np.cumsum(n)]
    run_start = np.flatnonzero(new_time)
    group_start = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
    at_time = np.add.reduceat(censored, run_start)
    return seen[run_start[run]] - seen[group_start] + at_time[run]


def count_pairs(
    position: np.ndarray,
    time: np.ndarray,
    events: np.ndarray,
    censored: np.ndarray,
    equal_times: bool = True,
) -> tuple[int, int, int]:
    """Concordant, discordant and tied pairs of weighted rows, by halving the positions.

    Without ``equal_times`` rows of one time stand for a range and aren't compared with each other.
    """
    rank = np.unique(position, return_inverse=True)[1]
    order = np.argsort(-time, kind="stable")
    rank, time, events, censored = rank[order], time[order], events[order], censored[order]
    n = events + censored
    censored = censored if equal_times else np.zeros_like(censored)
    comparable = _dot(events, _later(np.zeros_like(rank), time, n, censored))
    order = np.argsort(rank, kind="stable")
    tied = _dot(events[order], _later(rank[order], time[order], n[order], censored[order]))
    concordant = 0
    for bit in range(int(rank.max()).bit_length()):
        block = rank >> (bit + 1)
        order = np.argsort(block, kind="stable")
        high = ((rank[order] >> bit) & 1).astype(bool)
        later = _later(
            block[order],
            time[order],
            np.where(high, 0, n[order]),
            np.where(high, 0, censored[order]),
        )
        concordant += _dot(np.where(high, events[order], 0), later)
    return concordant, comparable - concordant - tied, tied


def _count_group(rows: pd.DataFrame) -> pd.DataFrame:
    concordant, discordant, tied = count_pairs(
        rows["position"].to_numpy(),
        rows["time"].to_numpy(),
        rows["events"].to_numpy(np.int64),
        rows["censored"].to_numpy(np.int64),
        equal_times=int(rows["time_level"].iat[0]) == 0,
    )
    level = int(rows["level"].iat[0])
    return pd.DataFrame(
        {
            "score": [rows["score"].iat[0]],
            "level": np.array([level], dtype=np.int32),
            "concordant": [Decimal(concordant)],
            "discordant": [Decimal(discordant)],
            "tied": [Decimal(tied if level == 0 else 0)],
        }
    )


def _cuts(df: DataFrame, scores: list[str], leaf_rows: int) -> dict[str, list[float]]:
    """Values that cut each score, and time where it has many values, into leaves of about ``leaf_rows`` rows."""
    n, times = df.agg(F.count("*"), F.approx_count_distinct("time", 0.01)).first()
    leaves = -(-n // leaf_rows)
    # A group of scores without cuts in time has a row per child and time.
    columns = [*scores, "time"] if times * FANOUT > leaf_rows else list(scores)
    if leaves < 2:
        return {c: [] for c in [*scores, "time"]}
    # One constant, however many leaves there are.
    shares = F.from_json(F.lit(json.dumps([i / leaves for i in range(1, leaves)])), "array<double>")
    found = df.agg(*(F.percentile_approx(c, shares, 20 * leaves).alias(c) for c in columns)).first()
    return {c: sorted(set(found[c])) if c in columns else [] for c in [*scores, "time"]}


def _leaf(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """The number of the leaf that a value is in."""
    if not cuts:
        return df.withColumn(name, F.lit(0).cast("long"))
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *cuts, inf], inputCol=column, outputCol=name, handleInvalid="error")
    return cut.transform(df).withColumn(name, F.col(name).cast("long"))


def _widths(leaves: int) -> list[int]:
    """Leaves in a group of each level, the first level being the leaves themselves."""
    widths = [1]
    while widths[-1] < leaves:
        widths.append(widths[-1] * FANOUT)
    return widths


def compared_rows(
    df: DataFrame,
    scores: list[str],
    time: str = "survival_time",
    event: str = "churned",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """What is compared: per score, level and group the merged rows by position and time."""
    wide = df.select(
        F.col(time).cast("double").alias("time"),
        F.col(event).cast("long").alias("event"),
        *(F.col(s).cast("double").alias(s) for s in scores),
    )
    cuts = _cuts(wide, scores, leaf_rows)
    wide = _leaf(wide, "time", cuts["time"], "_time_leaf")
    for i, s in enumerate(scores):
        wide = _leaf(wide, s, cuts[s], f"_leaf_{i}")
    cells = (
        F.struct(F.lit(s).alias("score"), F.col(f"_leaf_{i}").alias("leaf"), F.col(s).alias("value"))
        for i, s in enumerate(scores)
    )
    long = wide.select("time", "event", "_time_leaf", F.inline(F.array(*cells)))
    rows = None
    by_score = _widths(max(len(cuts[s]) + 1 for s in scores))
    by_time = _widths(len(cuts["time"]) + 1)
    for level, width in enumerate(by_score):
        for time_level, time_width in enumerate(by_time):
            position = F.floor(F.col("leaf") / by_score[level - 1]).cast("double") if level else F.col("value")
            when = F.floor(F.col("_time_leaf") / by_time[time_level - 1]).cast("double") if time_level else F.col("time")
            here = long.groupBy(
                "score",
                F.lit(level).alias("level"),
                F.lit(time_level).alias("time_level"),
                F.floor(F.col("leaf") / width).alias("group"),
                F.floor(F.col("_time_leaf") / time_width).alias("time_group"),
                position.alias("position"),
                when.alias("time"),
            ).agg(F.sum("event").alias("events"), F.sum(1 - F.col("event")).alias("censored"))
            rows = here if rows is None else rows.unionByName(here)
    return rows


GROUP = ("score", "level", "time_level", "group", "time_group")


def concordance(
    df: DataFrame,
    scores: list[str],
    time: str = "survival_time",
    event: str = "churned",
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """One row per score column: concordant, discordant, tied pairs and the index.

    ``df`` is read three times (counts, cuts, pairs); pass a materialised frame.
    """
    rows = compared_rows(df, scores, time, event, leaf_rows)
    pairs = rows.groupBy(*GROUP).applyInPandas(_count_group, PAIR_SCHEMA)
    whole = (F.sum(c).alias(c) for c in ("concordant", "discordant", "tied"))
    c, d, t = (F.col(x).cast("double") for x in ("concordant", "discordant", "tied"))
    return (
        pairs.groupBy("score")
        .agg(*whole)
        .withColumn("c_index", (c + t * 0.5) / F.nullif(c + d + t, F.lit(0.0)))
    )

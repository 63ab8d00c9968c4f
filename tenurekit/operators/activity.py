"""Who acted when: events of both sources, their order, gaps and cadence.

A single user may own a large share of all events. Nothing here puts the raw
events of one user into one task: per-user facts are plain aggregates, which
combine on the map side, and everything that needs an order works on
``activity_days``, where a user has at most one row per calendar day.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPEAT_CHUNK = 10_000


def user_activity(reviews: DataFrame, tips: DataFrame) -> DataFrame:
    """One row per event (user_id, date) over both sources."""
    return reviews.select("user_id", "date").unionByName(tips.select("user_id", "date"))


def user_spans(activity: DataFrame) -> DataFrame:
    """Number of events, first and last date per user."""
    return activity.groupBy("user_id").agg(
        F.count("*").alias("n_events"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def activity_days(activity: DataFrame) -> DataFrame:
    """Number of events per user and day."""
    return activity.groupBy("user_id", "date").agg(F.count("*").alias("n"))


def _by_day() -> Window:
    return Window.partitionBy("user_id").orderBy(F.col("date").asc_nulls_last())


def _repeat(df: DataFrame, times: str, index: str) -> DataFrame:
    """Each row ``times`` times, numbered from 1.

    Very large counts are cut into chunks that a shuffle spreads over the
    cluster; ordinary ones are expanded in place.
    """
    small = df.filter(F.col(times) <= REPEAT_CHUNK).withColumn(
        index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))
    )
    last = F.floor((F.col(times) - 1) / REPEAT_CHUNK)
    start = F.col("_chunk") * REPEAT_CHUNK
    large = (
        df.filter(F.col(times) > REPEAT_CHUNK)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition("user_id", "date", "_chunk")
        .withColumn(
            index,
            F.explode(F.sequence(start + 1, F.least(start + REPEAT_CHUNK, F.col(times)))),
        )
        .drop("_chunk")
    )
    return small.unionByName(large)


def event_rank(activity: DataFrame) -> DataFrame:
    """Position of every event within its user, by date, missing dates last."""
    before = F.coalesce(
        F.sum("n").over(_by_day().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    days = activity_days(activity).withColumn("before", before)
    return _repeat(days, "n", "i").select(
        "user_id", "date", (F.col("before") + F.col("i")).alias("rn")
    )


def _gap_days(activity: DataFrame) -> DataFrame:
    """Day rows with ``prev_date`` and how many gaps they open and repeat."""
    return activity_days(activity).withColumn("prev_date", F.lag("date").over(_by_day()))


def _gap_rows(days: DataFrame) -> DataFrame:
    """(user_id, date, prev_date, days_between, times): one row per different gap of a day."""
    to_previous = F.struct(
        F.col("prev_date").alias("prev_date"),
        F.datediff("date", "prev_date").cast("long").alias("days_between"),
        F.col("prev_date").isNotNull().cast("long").alias("times"),
    )
    same_day = F.struct(
        F.col("date").alias("prev_date"),
        F.lit(0).cast("long").alias("days_between"),
        F.when(F.col("date").isNotNull(), F.col("n") - 1).otherwise(F.lit(0)).alias("times"),
    )
    return (
        days.select("user_id", "date", F.explode(F.array(to_previous, same_day)).alias("g"))
        .select("user_id", "date", "g.prev_date", "g.days_between", "g.times")
        .filter("times > 0")
    )


def event_gaps(activity: DataFrame) -> DataFrame:
    """Days from every event to the event before it, per user."""
    return _repeat(_gap_rows(_gap_days(activity)), "times", "i").select(
        "user_id", "date", "prev_date", "days_between"
    )


def gap_frequencies(activity: DataFrame) -> DataFrame:
    """How often each gap length occurs; one row per different number of days."""
    return (
        _gap_rows(_gap_days(activity)).groupBy("days_between").agg(F.sum("times").alias("times"))
    )


def gap_percentiles(activity: DataFrame, probabilities: tuple[float, ...]) -> DataFrame:
    """Exact, interpolated percentiles of the gaps, in days.

    Works on the frequency table, so the exact percentile sees at most one row
    per gap length however many events there are.
    """
    labels = F.array(*(F.lit(f"{round(p * 100)}th") for p in probabilities))
    values = F.percentile("days_between", F.array(*map(F.lit, probabilities)), F.col("times"))
    return (
        gap_frequencies(activity)
        .agg(values.alias("days"))
        .select(F.inline(F.arrays_zip(labels.alias("percentile"), F.col("days"))))
        .toDF("percentile", "days")
        .select("percentile", F.round("days", 2).alias("days"))
    )


def first_second_events(activity: DataFrame) -> DataFrame:
    """First and second event date and number of events per user."""
    days = activity_days(activity).withColumn("next_date", F.lead("date").over(_by_day()))
    opening = F.min_by(F.struct("n", "next_date"), F.coalesce("date", F.lit(date(9999, 12, 31))))
    return (
        days.groupBy("user_id")
        .agg(
            F.min("date").alias("first_date"),
            opening.alias("opening"),
            F.sum("n").alias("n_events"),
        )
        .select(
            "user_id",
            "first_date",
            F.when(F.col("opening.n") > 1, F.col("first_date"))
            .otherwise(F.col("opening.next_date"))
            .alias("second_date"),
            "n_events",
        )
    )


def observation_end(activity: DataFrame) -> DataFrame:
    """Last date seen in any source, one row."""
    return activity.agg(F.max("date").alias("end_date"))


def early_churn_outcomes(activity: DataFrame, threshold_days: int) -> DataFrame:
    """What users did after their first action, counted."""
    spans = user_spans(activity)
    end = observation_end(activity).scalar()
    idle = F.datediff(end, F.col("first_date"))
    # The labels of the report.
    outcome = (
        F.when((F.col("n_events") == 1) & (idle > threshold_days), "1 action only")
        .when(F.col("n_events") == 1, "uncertain (near end)")
        .otherwise(">1 action")
    )
    return spans.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def censoring_by_threshold(
    activity: DataFrame, end: date, thresholds: tuple[int, ...]
) -> DataFrame:
    """Share of users still active (censored) or gone (complete) for each idle threshold."""
    idle = F.datediff(F.lit(end), F.col("last_date"))
    active = [F.count_if(idle <= t).alias(f"t{t}") for t in thresholds]
    counts = user_spans(activity).agg(F.count("last_date").alias("n_users"), *active)
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(t).alias("threshold_days"), F.col(f"t{t}").alias("n_censored"))
                for t in thresholds
            )
        )
    )
    share = F.col("n_censored") / F.nullif(F.col("n_users"), F.lit(0))
    return (
        counts.select("n_users", rows.alias("r"))
        .select("n_users", "r.*")
        .select(
            "threshold_days",
            "n_users",
            "n_censored",
            (share * 100.0).alias("pct_censored"),
            ((1.0 - share) * 100.0).alias("pct_complete"),
        )
    )


def monthly_activity(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows per month and source, by month."""
    parts = [
        df.groupBy(F.trunc("date", "MM").alias("month"))
        .agg(F.count("*").alias("n"))
        .withColumn("type", F.lit(name))
        for name, df in sources.items()
    ]
    return _union(parts).orderBy("month", "type")


def date_ranges(sources: dict[str, DataFrame]) -> DataFrame:
    """First and last date per source."""
    return _union(
        [
            df.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")).select(
                F.lit(name).alias("source"), "first_date", "last_date"
            )
            for name, df in sources.items()
        ]
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def in_window(start: date, end: date, column: str = "date") -> Column:
    """Inside the window, ends included; rows without a date stay."""
    c = F.col(column)
    return c.isNull() | c.between(F.lit(start), F.lit(end))


def trim_window(df: DataFrame, start: date, end: date) -> DataFrame:
    return df.filter(in_window(start, end))

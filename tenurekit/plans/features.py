"""One row per user: activity span, social facts, outcome, model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.columns import COMPLIMENTS, LOG_OF, SINCE, SURVIVAL_COLUMNS, VOTES
from tenurekit.config import StudyConfig
from tenurekit.functions.expressions import capped, days_between, flag, ratio, total
from tenurekit.operators.activity import trim_window, user_spans
from tenurekit.operators.cleaning import Tables
from tenurekit.operators.profiling import exact_quantile
from tenurekit.session import cut_lineage


def _valid_votes(reviews: DataFrame):
    """Votes of a review, NULL unless all three kinds are present and not negative."""
    usable = (F.col(VOTES[0]) >= 0) & (F.col(VOTES[1]) >= 0) & (F.col(VOTES[2]) >= 0)
    return F.when(usable, total(VOTES).cast("long"))


def review_votes(reviews: DataFrame) -> DataFrame:
    """Votes received per user: sum, number of reviews, mean."""
    return (
        reviews.select("user_id", _valid_votes(reviews).alias("votes"))
        .filter("votes IS NOT NULL")
        .groupBy("user_id")
        .agg(
            F.sum("votes").alias("total_votes_received"),
            F.count("votes").alias("review_count"),
            F.avg("votes").alias("avg_votes_per_review"),
        )
    )


def friend_counts(friends: DataFrame) -> DataFrame:
    return friends.groupBy("user_id").agg(F.count("*").alias("friend_count"))


def elite_counts(elite: DataFrame) -> DataFrame:
    return elite.groupBy("user_id").agg(F.count("*").alias("years_elite"))


def user_facts(tables: Tables) -> DataFrame:
    """Everything that is counted per user, from all four fact tables.

    The tables are stacked into one narrow relation and aggregated once: one
    map-side-combined shuffle on user_id instead of four aggregates and three
    joins. Facts a user has no rows for stay NULL.
    """
    one, no_date = F.lit(1).cast("long"), F.lit(None).cast("date")
    nothing = F.lit(None).cast("long")

    def part(df, day=no_date, event=nothing, votes=nothing, friend=nothing, elite=nothing):
        return df.select(
            "user_id",
            day.alias("date"),
            event.alias("event"),
            votes.alias("votes"),
            friend.alias("friend"),
            elite.alias("elite"),
        )

    stacked = (
        part(tables["reviews"], F.col("date"), one, _valid_votes(tables["reviews"]))
        .unionByName(part(tables["tips"], F.col("date"), one))
        .unionByName(part(tables["user_friends"], friend=one))
        .unionByName(part(tables["user_elite_years"], elite=one))
    )
    return stacked.groupBy("user_id").agg(
        F.max("date").alias("last_post"),
        F.sum("event").alias("total_posts"),
        F.sum("votes").alias("total_votes_received"),
        F.avg("votes").alias("avg_votes_per_review"),
        F.sum("friend").alias("friend_count"),
        F.sum("elite").alias("years_elite"),
    )


def _co_located_facts(users: DataFrame, tables: Tables) -> DataFrame:
    """Users with their facts, table by table, where all tables are bucketed by user: no shuffle at all."""
    reviews = tables["reviews"].withColumn("votes", _valid_votes(tables["reviews"])).groupBy("user_id").agg(
        F.max("date").alias("last_review"), F.count("*").alias("n_reviews"),
        F.sum("votes").alias("total_votes_received"), F.avg("votes").alias("avg_votes_per_review"),
    )
    tips = tables["tips"].groupBy("user_id").agg(F.max("date").alias("last_tip"), F.count("*").alias("n_tips"))
    joined = users
    for facts in (reviews, tips, friend_counts(tables["user_friends"]), elite_counts(tables["user_elite_years"])):
        # Other joins would move a side that lies where it is needed.
        joined = joined.join(facts.hint("merge"), "user_id", "left")
    posts = F.coalesce("n_reviews", F.lit(0)) + F.coalesce("n_tips", F.lit(0))
    return joined.withColumns(
        {"last_post": F.greatest("last_review", "last_tip"), "total_posts": F.nullif(posts, F.lit(0))}
    )


def _with_timeline(users_with_facts: DataFrame) -> DataFrame:
    """Join date and tenure; only users whose last event is after they joined."""
    joined = F.col(SINCE)
    return (
        users_with_facts.filter(F.col("last_post") > joined)
        .withColumn("join_date", joined)
        .withColumn("tenure_years", days_between(F.col("last_post"), joined) / F.lit(365.0))
    )


def user_timeline(users: DataFrame, activity: DataFrame) -> DataFrame:
    """Join date, last event, number of events and tenure per user."""
    spans = user_spans(activity).select(
        "user_id", F.col("last_date").alias("last_post"), F.col("n_events").alias("total_posts")
    )
    return _with_timeline(users.select("user_id", SINCE).join(spans, "user_id")).select(
        "user_id", "join_date", "last_post", "total_posts", "tenure_years"
    )


def _with_social(timeline: DataFrame) -> DataFrame:
    """Friends, recognition and status, absolute and per year of tenure."""
    tenure = F.col("tenure_years")
    zero = F.lit(0)
    counts = ("friend_count", "total_votes_received", "years_elite")
    absolute = timeline.withColumns(
        {
            "ever_elite": flag(F.col("years_elite").isNotNull()),
            "avg_votes_per_review": F.coalesce("avg_votes_per_review", F.lit(0.0)),
            "total_compliments": F.coalesce(total(COMPLIMENTS), zero),
            **{c: F.coalesce(c, zero) for c in counts},
        }
    )
    return absolute.withColumns(
        {
            "friends_per_year": ratio(F.col("friend_count"), tenure),
            "compliments_per_year": ratio(F.col("total_compliments"), tenure),
            "votes_per_year": ratio(F.col("total_votes_received"), tenure),
        }
    )


def _social_frame(tables: Tables, min_actions: int = 0, co_located: bool = False) -> DataFrame:
    users = tables["users"].select("user_id", SINCE, *COMPLIMENTS)
    if co_located:
        joined = _co_located_facts(users, tables)
    else:
        joined = users.join(user_facts(tables), "user_id")
    if min_actions > 0:
        joined = joined.filter(F.col("total_posts") >= min_actions)
    return _with_social(_with_timeline(joined))


def user_social(tables: Tables) -> DataFrame:
    """The social block of every user with a timeline."""
    return _social_frame(tables).select("user_id", *SURVIVAL_COLUMNS[4:13])


def survival_dataset(
    tables: Tables, study: StudyConfig, min_actions: int = 0, co_located: bool = False
) -> DataFrame:
    """One row per user with features, survival time in days and churn flag.

    ``tables`` are taken as they are; see ``study_dataset`` for the trimmed and
    cleaned version. ``co_located`` tables are bucketed by user alike.
    """
    end, joined, last = F.lit(study.window_end), F.col("join_date"), F.col("last_post")
    gone = days_between(end, last) > study.churn_days
    return (
        _social_frame(tables, min_actions, co_located)
        .filter((joined <= F.lit(study.last_join)) & (joined != last))
        .withColumn(
            "survival_time",
            F.when(gone, days_between(last, joined))
            .otherwise(days_between(end, joined))
            .cast("double"),
        )
        .withColumn("churned", flag(gone))
        .select(*SURVIVAL_COLUMNS)
    )


def trimmed_tables(tables: Tables, study: StudyConfig) -> Tables:
    """Reviews and tips cut to the study window; the other tables as they are."""
    dated = ("reviews", "tips")
    return {
        name: trim_window(df, study.window_start, study.window_end) if name in dated else df
        for name, df in tables.items()
    }


def study_dataset(tables: Tables, study: StudyConfig) -> DataFrame:
    """``survival_dataset`` of the trimmed tables, users with too few events left out.

    Filtering the five tables by user first and aggregating after gives the same
    rows; the per-user event count is at hand here, so no raw table is joined.
    """
    return survival_dataset(trimmed_tables(tables, study), study, study.min_actions)


def engineered_features(survival: DataFrame, study: StudyConfig, stored: bool = False) -> DataFrame:
    """Model inputs: capped rates, zero flags, log1p, interactions.

    The cap comes from the stored rate, before the rate is recomputed. The data
    set is read several times to find it, so it is materialised first unless it is ``stored``.
    """
    survival = survival if stored else cut_lineage(survival)
    cap = F.lit(exact_quantile(survival, "friends_per_year", study.clamp_probability))
    tenure = F.col("tenure_years")
    rate = F.when(tenure > 0, F.col("friend_count") / tenure).otherwise(F.lit(0.0))
    out = survival.withColumn("friends_per_year", capped(rate, cap.cast("double")))
    out = out.withColumns(
        {
            "zero_comp_flag": flag(F.col("total_compliments") == 0),
            "zero_vote_flag": flag(F.col("total_votes_received") == 0),
            **{log: F.log1p(F.col(raw).cast("double")) for log, raw in LOG_OF.items()},
        }
    )
    return out.withColumn("tenure_friend_int", tenure * F.col("log_friend_count")).withColumn(
        "elite_compl_int", F.col("ever_elite") * F.col("log_total_compliments")
    )

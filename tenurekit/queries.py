"""Every operator as a query over the TPC-H-like tables: ``name -> f(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.columns import (
    COMPLIMENTS,
    LOG_OF,
    RAW_FEATURES,
    SINCE,
    core_predictors,
    predictors,
)
from tenurekit.functions.expressions import bools_to_double, days_between, ratio, whole_number
from tenurekit.operators import activity as act
from tenurekit.operators import cleaning, profiling, quality, splitting
from tenurekit.operators.comoments import correlation_matrix
from tenurekit.operators.concordance import concordance
from tenurekit.operators.numbering import number_rows
from tenurekit.plans import diagnostics, features, models
from tenurekit.plans.cox import CoxFit, fit_unpenalised
from tenurekit.session import cut_lineage, delete, dropped_shuffles, scratch_path
from tenurekit.sources import ndjson, roles, tables
from tenurekit.sources.roles import ROLE_STUDY as STUDY

CUTOFF = date(1998, 12, 31)
SAMPLE_ROWS = 500
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, decimals as doubles, so both engines print the same values."""

    def cell(name: str, kind: str) -> str:
        if kind == "double" or kind.startswith("decimal"):
            return f"round(CAST(`{name}` AS DOUBLE), {digits}) AS `{name}`"
        return f"`{name}`"

    return df.selectExpr(*(cell(c, t) for c, t in df.dtypes))


def _trimmed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return features.trimmed_tables(roles.role_tables(spark, folder), STUDY)


def _activity(spark: SparkSession, folder: str) -> DataFrame:
    trimmed = _trimmed(spark, folder)
    return act.user_activity(trimmed["reviews"], trimmed["tips"])


def _dated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = roles.role_tables(spark, folder)
    return {name: found[name] for name in ("reviews", "tips")}


def _survival(spark: SparkSession, folder: str) -> DataFrame:
    return features.study_dataset(roles.role_tables(spark, folder), STUDY)


def _engineered(spark: SparkSession, folder: str) -> DataFrame:
    return features.engineered_features(_survival(spark, folder), STUDY)


# --- files -----------------------------------------------------------------------------


def _business_file(spark: SparkSession, folder: str) -> str:
    part = roles.table(spark, folder, "part")
    path = scratch_path(spark, "business")
    part.select(
        F.col("p_partkey").cast("string").alias("business_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("city"),
        F.substring("p_type", 1, 2).alias("state"),
        F.col("p_size").cast("string").alias("postal_code"),
        (F.col("p_retailprice") / 100).alias("latitude"),
        (F.col("p_retailprice") / -50).alias("longitude"),
        (F.lit(1.5) + F.col("p_size") % 5).cast("double").alias("stars"),
        F.col("p_size").alias("review_count"),
        (F.col("p_size") % 2).alias("is_open"),
        F.concat("p_type", F.lit(", "), "p_name").alias("categories"),
    ).write.json(path)
    return path


def _user_file(spark: SparkSession, folder: str) -> str:
    key = F.col("user_id")
    path = scratch_path(spark, "user")
    roles.users(spark, folder).select(
        key.cast("string").alias("user_id"),
        "name",
        SINCE,
        (key % 100).alias("review_count"),
        ((key % 400 + 100) / 100).cast("double").alias("average_stars"),
        (key % 7).alias("fans"),
        (key % 11).alias("useful"),
        (key % 13).alias("funny"),
        (key % 17).alias("cool"),
        *COMPLIMENTS,
        F.when(key % 5 == 0, "").otherwise(F.concat_ws(", ", key + 1, key + 2)).alias("friends"),
        F.when(key % 3 == 0, "2015,2016").otherwise("").alias("elite"),
    ).write.json(path)
    return path


def _review_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What a review file holds, a column per field."""
    return roles.all_reviews(spark, folder).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("review_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("business_id").cast("string").alias("business_id"),
        (F.lit(1.0) + F.col("l_linenumber") % 5).cast("double").alias("stars"),
        F.concat(F.col("date").cast("string"), F.lit(" 10:11:12")).alias("date"),
        F.concat(F.lit("order "), "l_orderkey").alias("text"),
        F.col("useful_per_review").alias("useful"),
        F.col("funny_per_review").alias("funny"),
        F.col("cool_per_review").alias("cool"),
    )


def _review_file(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "review")
    _review_rows(spark, folder).write.json(path)
    return path


def _raw_tips(spark: SparkSession, folder: str) -> DataFrame:
    lines = roles.table(spark, folder, "lineitem").filter("l_linenumber = 1")
    return (
        roles.all_tips(spark, folder)
        .join(lines, F.col("tip_key") == F.col("l_orderkey"))
        .select("tip_key", "user_id", F.col("l_partkey").alias("business_id"), "date")
    )


def _tip_file(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "tip")
    _raw_tips(spark, folder).select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("business_id").cast("string").alias("business_id"),
        F.concat(F.lit("tip "), "tip_key").alias("text"),
        F.concat(F.col("date").cast("string"), F.lit(" 10:11:12")).alias("date"),
        (F.col("tip_key") % 3).alias("compliment_count"),
    ).write.json(path)
    return path


@query
def scan_businesses(spark, folder):
    found = ndjson.scan_businesses(spark, _business_file(spark, folder), STUDY.category)
    return rounded(found.withColumn("is_open", F.col("is_open").cast("int")))


@query
def scan_users(spark, folder):
    return rounded(ndjson.scan_users(spark, _user_file(spark, folder)))


@query
def scan_reviews(spark, folder):
    kept = ndjson.scan_businesses(spark, _business_file(spark, folder), STUDY.category)
    return ndjson.scan_reviews(spark, _review_file(spark, folder), kept)


@query
def scan_tips(spark, folder):
    kept = ndjson.scan_businesses(spark, _business_file(spark, folder), STUDY.category)
    return ndjson.scan_tips(spark, _tip_file(spark, folder), kept)


@query
def scan_with_bad_lines(spark, folder):
    """Lines of a review file of which some are cut off and some hold an impossible date."""
    lines = _review_rows(spark, folder).select(F.to_json(F.struct("*")).alias("value"))
    order = F.get_json_object("value", "$.text").substr(7, 20).cast("long")
    broken = F.when(order % 50 == 0, F.substring("value", 1, 30))
    wrong = F.when(order % 50 == 1, F.regexp_replace("value", '"date":"[0-9]{4}', '"date":"year'))
    path = scratch_path(spark, "review")
    # The lines are many times the tables: they are written once, packed, and go as soon as they are split.
    with dropped_shuffles(spark):
        lines.select(F.coalesce(broken, wrong, "value").alias("value")).write.text(path, compression="gzip")
    aside = ndjson.SetAside(scratch_path(spark, "aside"))
    kept = ndjson.scan_businesses(spark, _business_file(spark, folder), STUDY.category)
    reviews = ndjson.scan_reviews(spark, path, kept, aside.read)
    delete(spark, path)
    of_category = reviews.agg(F.lit("of the category").alias("what"), F.count("*").alias("n"))
    counts = aside.line_counts(spark, [path]).selectExpr("stack(3, 'lines', n_lines, 'rows', n_rows, 'bad', n_bad) AS (what, n)")
    return counts.unionByName(of_category)


@query
def table_roundtrip(spark, folder):
    path = scratch_path(spark, "users")
    first = tables.save_table(roles.users(spark, folder).withColumn("name", F.lit("old")), path)
    tables.save_table(first.drop("name").join(roles.users(spark, folder).select("user_id", "name"), "user_id"), path)
    return tables.load_table(spark, path).select("user_id", "name", SINCE)


@query
def snapshot_counts(spark, folder):
    kept = cleaning.apply_min_actions(_trimmed(spark, folder), STUDY.min_actions)
    return tables.snapshot_counts(kept, scratch_path(spark, "snapshot"))


@query
def engineered_roundtrip(spark, folder):
    path = scratch_path(spark, "engineered")
    tables.save_table(_engineered(spark, folder), path)
    return rounded(tables.load_table(spark, path))


@query
def drop_columns(spark, folder):
    return tables.drop_columns(roles.users(spark, folder), [*COMPLIMENTS[1:]])


@query
def preview_limit(spark, folder):
    return tables.preview(roles.all_tips(spark, folder), ["tip_key"])


# --- expressions -----------------------------------------------------------------------


@query
def json_text_field(spark, folder):
    events = roles.table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return events.select("event_id", k.alias("k_text"), k.cast("int").alias("k_number"))


@query
def typed_casts(spark, folder):
    lines = roles.table(spark, folder, "lineitem")

    def text(c):
        return F.col(c).cast("string")

    return lines.select(
        "l_orderkey",
        "l_linenumber",
        whole_number(text("l_quantity")).alias("quantity"),
        text("l_extendedprice").cast("double").alias("price"),
        F.round(text("l_discount").cast("decimal(3,2)").cast("double"), 2).alias("discount"),
        text("l_shipdate").cast("date").alias("shipped"),
    )


@query
def bool_from_text(spark, folder):
    text = F.nullif(F.col("p_size") % 3, F.lit(2)).cast("string")
    part = roles.table(spark, folder, "part")
    return part.select("p_partkey", (text == "1").cast("int").alias("is_one"))


@query
def category_filter(spark, folder):
    return roles.kept_businesses(spark, folder).select("business_id", "name", "categories")


@query
def bools_to_numeric(spark, folder):
    split = splitting.time_split(_survival(spark, folder), STUDY.train_join_end)
    return bools_to_double(split).select("user_id", "is_train")


@query
def date_differences(spark, folder):
    lines, orders = (roles.table(spark, folder, t) for t in ("lineitem", "orders"))
    days = days_between(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", days.alias("days")
    )


@query
def safe_ratios(spark, folder):
    per = ratio(F.col("l_tax"), F.col("l_discount"))
    return rounded(
        roles.table(spark, folder, "lineitem").select(
            "l_orderkey", "l_linenumber", per.alias("per"),
            F.coalesce(per, F.lit(0.0)).alias("per_or_zero"),
        )
    )


@query
def log1p_features(spark, folder):
    orders = roles.table(spark, folder, "orders")
    price = F.col("o_totalprice")
    return rounded(
        orders.select(
            "o_orderkey",
            F.log1p(price).alias("log_price"),
            F.exp(price / 1_000_000).alias("exp_price"),
            F.abs(price - 100_000).alias("off_price"),
        ),
        8,
    )


@query
def split_explode(spark, folder):
    docs = roles.table(spark, folder, "documents").select("doc_id", "text")
    return ndjson.split_list(docs, "text", "item")


@query
def extract_years(spark, folder):
    docs = roles.table(spark, folder, "documents").select("doc_id", "text")
    return ndjson.extract_years(docs, "text", "year")


# --- joins and keys --------------------------------------------------------------------


@query
def reviews_of_category(spark, folder):
    kept = roles.kept_businesses(spark, folder)
    found = ndjson.of_businesses(roles.all_reviews(spark, folder), kept)
    return found.select("user_id", "business_id", "date", "useful_per_review")


@query
def tips_of_category(spark, folder):
    kept = roles.kept_businesses(spark, folder)
    return ndjson.of_businesses(_raw_tips(spark, folder), kept).select(
        "tip_key", "user_id", "business_id", "date"
    )


@query
def keep_qualifying(spark, folder):
    trimmed = _trimmed(spark, folder)
    kept = cleaning.apply_min_actions(trimmed, STUDY.min_actions)
    return kept["reviews"].select("user_id", "business_id", "date")


@query
def drop_reactivated(spark, folder):
    left = cleaning.drop_reactivated(
        roles.role_tables(spark, folder), CUTOFF, STUDY.reactivation_days
    )
    return quality.table_counts(left)


@query
def duplicate_keys(spark, folder):
    reviews = roles.role_tables(spark, folder)["reviews"]
    return quality.duplicate_keys(reviews, ["l_orderkey", "l_linenumber"])


@query
def tip_ids(spark, folder):
    tips = roles.all_tips(spark, folder)
    return number_rows(tips, ["user_id", "date", "tip_key"], "tip_id")


# --- activity --------------------------------------------------------------------------


@query
def user_activity(spark, folder):
    return _activity(spark, folder)


@query
def trim_window(spark, folder):
    return _trimmed(spark, folder)["tips"]


@query
def event_rank(spark, folder):
    return act.event_rank(_activity(spark, folder))


@query
def event_gaps(spark, folder):
    return act.event_gaps(_activity(spark, folder))


@query
def table_counts(spark, folder):
    return quality.table_counts(roles.role_tables(spark, folder))


@query
def date_ranges(spark, folder):
    dated = _dated(spark, folder)
    trimmed = features.trimmed_tables(dated, STUDY)
    both = {f"{k} before": v for k, v in dated.items()}
    return act.date_ranges(both | {f"{k} after": v for k, v in trimmed.items()})


@query
def monthly_activity(spark, folder):
    return act.monthly_activity(_dated(spark, folder))


@query
def first_second_events(spark, folder):
    return act.first_second_events(_activity(spark, folder))


@query
def observation_end(spark, folder):
    return act.observation_end(_activity(spark, folder))


@query
def qualifying_users(spark, folder):
    return cleaning.qualifying_users(_activity(spark, folder), STUDY.min_actions)


@query
def early_churn_outcomes(spark, folder):
    return act.early_churn_outcomes(_activity(spark, folder), STUDY.churn_days)


@query
def gap_percentiles(spark, folder):
    return act.gap_percentiles(_activity(spark, folder), STUDY.gap_probabilities)


@query
def censoring_by_threshold(spark, folder):
    return rounded(
        act.censoring_by_threshold(
            _activity(spark, folder), STUDY.window_end, STUDY.censor_thresholds
        )
    )


@query
def cleaned_counts(spark, folder):
    kept = cleaning.apply_min_actions(_trimmed(spark, folder), STUDY.min_actions)
    return quality.table_counts(kept)


@query
def reactivated_users(spark, folder):
    dated = _dated(spark, folder)
    activity = act.user_activity(dated["reviews"], dated["tips"])
    return cleaning.reactivated_users(activity, CUTOFF, STUDY.reactivation_days)


# --- features --------------------------------------------------------------------------


@query
def user_timeline(spark, folder):
    users = roles.users(spark, folder)
    return rounded(features.user_timeline(users, _activity(spark, folder)))


@query
def review_votes(spark, folder):
    return rounded(features.review_votes(_trimmed(spark, folder)["reviews"]))


@query
def friend_counts(spark, folder):
    return features.friend_counts(roles.user_friends(spark, folder))


@query
def elite_counts(spark, folder):
    return features.elite_counts(roles.user_elite_years(spark, folder))


@query
def user_social(spark, folder):
    return rounded(features.user_social(_trimmed(spark, folder)))


@query
def survival_dataset(spark, folder):
    return rounded(_survival(spark, folder))


@query
def engineered_features(spark, folder):
    return rounded(_engineered(spark, folder))


@query
def survival_label(spark, folder):
    return quality.survival_label(_survival(spark, folder))


@query
def min_tenure(spark, folder):
    kept = splitting.min_tenure(_survival(spark, folder), STUDY.min_tenure_years)
    return rounded(kept.select("user_id", "tenure_years"))


@query
def core_feature_columns(spark, folder):
    engineered = _engineered(spark, folder)
    return rounded(engineered.select("user_id", *core_predictors(engineered.columns)))


@query
def feature_matrix(spark, folder):
    engineered = _engineered(spark, folder)
    matrix = models.feature_matrix(engineered, predictors(engineered.columns))
    return matrix.withColumn("features", F.transform("features", lambda x: F.round(x, 9)))


# --- profiles --------------------------------------------------------------------------


@query
def nonfinite_pct(spark, folder):
    facts = features.user_facts(_trimmed(spark, folder))
    wide = roles.users(spark, folder).select("user_id").join(facts, "user_id", "left")
    columns = ["total_posts", "total_votes_received", "avg_votes_per_review", "friend_count",
               "years_elite"]
    return rounded(quality.nonfinite_pct(wide, columns))


@query
def dataset_summary(spark, folder):
    return quality.dataset_summary(_survival(spark, folder))


@query
def feature_correlation(spark, folder):
    columns = [*LOG_OF, "survival_time", "tenure_years", "tenure_friend_int", "elite_compl_int"]
    return rounded(correlation_matrix(_engineered(spark, folder), columns), 8)


@query
def churn_distribution(spark, folder):
    return profiling.churn_distribution(_survival(spark, folder))


@query
def feature_histograms(spark, folder):
    return profiling.feature_histograms(
        _survival(spark, folder), list(RAW_FEATURES), STUDY.histogram_bins
    )


@query
def unpivot_features(spark, folder):
    return rounded(profiling.unpivot_features(_survival(spark, folder), list(RAW_FEATURES)))


# --- splits ----------------------------------------------------------------------------


@query
def time_split(spark, folder):
    split = splitting.time_split(_survival(spark, folder), STUDY.train_join_end)
    return split.select("user_id", "join_date", F.col("is_train").cast("int").alias("is_train"))


@query
def seeded_sample(spark, folder):
    survival = cut_lineage(_survival(spark, folder).select("user_id", "join_date"))
    train = survival.filter(F.col("join_date") <= F.lit(STUDY.train_join_end))
    return splitting.seeded_sample(train, SAMPLE_ROWS, STUDY.train_seed)


@query
def cv_folds(spark, folder):
    folds = splitting.with_folds(_survival(spark, folder), STUDY.n_folds, STUDY.fold_seed)
    return folds.select("user_id", "fold")


# --- models ----------------------------------------------------------------------------


@query
def concordance_index(spark, folder):
    survival = _survival(spark, folder)
    test = survival.filter(F.col("join_date") > F.lit(STUDY.train_join_end))
    scores = test.select(
        "survival_time", "churned",
        F.col("votes_per_year").alias("votes"),
        (-F.col("friend_count").cast("double")).alias("few_friends"),
    )
    found = concordance(cut_lineage(scores), ["votes", "few_friends"])
    counts = (F.col(c).cast("long").alias(c) for c in ("concordant", "discordant", "tied"))
    return rounded(found.select("score", *counts, "c_index"))


@query
def cox_enet_cv(spark, folder):
    return models.full_model(_engineered(spark, folder), STUDY).path.cv_table(spark)


@query
def risk_scores(spark, folder):
    test = models.full_model(_engineered(spark, folder), STUDY).test
    return test.select("user_id", "survival_time", "churned", "risk_score")


@query
def cox_importance(spark, folder):
    return models.full_model(_engineered(spark, folder), STUDY).importance()


@query
def leakage_sensitivity(spark, folder):
    return models.leakage_sensitivity(_engineered(spark, folder), STUDY)


def _plain_fit(spark: SparkSession, folder: str, **options) -> tuple[CoxFit, DataFrame]:
    """The plain fit of the time-safe predictors; those that depend on others are left out."""
    engineered = _engineered(spark, folder)
    train = cut_lineage(models.time_safe_train(engineered, STUDY))
    columns = core_predictors(engineered.columns)
    return fit_unpenalised(train, columns, drop_dependent=True, **options), train


@query
def cox_unpenalised(spark, folder):
    return _plain_fit(spark, folder)[0].table(spark)


@query
def cox_score_equations(spark, folder):
    """Whether the plain fit's coefficients are the maximum, worked out apart from the fit."""
    return diagnostics.score_equations(*_plain_fit(spark, folder))


@query
def cox_enet_optimality(spark, folder):
    """Whether the penalised coefficients meet their conditions, worked out apart from the fit."""
    model = models.full_model(_engineered(spark, folder), STUDY)
    found = diagnostics.optimality(model.path, model.train, STUDY.alpha)
    return found.withColumn("holds", F.col("holds").cast("int"))


@query
def survival_from_snapshot(spark, folder):
    """The data set over a stored snapshot that is bucketed by user."""
    stored = tables.save_snapshot(roles.role_tables(spark, folder), scratch_path(spark, "snapshot"), by="user_id")
    return rounded(features.survival_dataset(features.trimmed_tables(stored, STUDY), STUDY, STUDY.min_actions, co_located=True))


@query
def ph_test(spark, folder):
    return diagnostics.ph_test(_plain_fit(spark, folder, time_moments=True)[0], spark)


@query
def schoenfeld_residuals(spark, folder):
    return diagnostics.schoenfeld_residuals(*_plain_fit(spark, folder))

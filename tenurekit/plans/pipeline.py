"""The whole study, from files to reports, every stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenurekit.columns import LOG_OF, RAW_FEATURES, predictors
from tenurekit.config import StudyConfig
from tenurekit.operators import activity as act
from tenurekit.operators.cleaning import Tables, apply_min_actions, drop_reactivated
from tenurekit.operators.comoments import correlation_matrix
from tenurekit.operators.profiling import churn_distribution, feature_histograms
from tenurekit.operators.quality import (
    dataset_summary,
    nonfinite_pct,
    require_unique,
    survival_label,
    table_counts,
)
from tenurekit.plans import models
from tenurekit.plans.cox import fit_unpenalised
from tenurekit.plans.diagnostics import ph_test, schoenfeld_residuals
from tenurekit.plans.features import engineered_features, survival_dataset, trimmed_tables
from tenurekit.sources.ndjson import load_tables
from tenurekit.sources.tables import save_snapshot, save_table


def load(spark: SparkSession, paths: dict[str, str], out: str, study: StudyConfig) -> Tables:
    """Files to five stored tables; users, friend pairs and elite years must have unique keys."""
    tables = save_snapshot(load_tables(spark, paths, study.category), f"{out}/loaded", by="user_id")
    require_unique(tables["users"], ["user_id"], "users")
    require_unique(tables["user_friends"], ["user_id", "friend_id"], "user_friends")
    require_unique(tables["user_elite_years"], ["user_id", "elite_year"], "user_elite_years")
    return tables


def profile_activity(tables: Tables, study: StudyConfig) -> dict[str, DataFrame]:
    """Reports on the tables as loaded and on the study window."""
    dated = {name: tables[name] for name in ("reviews", "tips")}
    trimmed = trimmed_tables(dated, study)
    activity = act.user_activity(trimmed["reviews"], trimmed["tips"])
    return {
        "table_counts": table_counts(tables),
        "date_ranges": act.date_ranges(dated),
        "date_ranges_trimmed": act.date_ranges(trimmed),
        "monthly_activity": act.monthly_activity(dated),
        "early_churn_outcomes": act.early_churn_outcomes(activity, study.churn_days),
        "gap_percentiles": act.gap_percentiles(activity, study.gap_probabilities),
        "censoring_by_threshold": act.censoring_by_threshold(
            activity, study.window_end, study.censor_thresholds
        ),
    }


def clean(tables: Tables, out: str, study: StudyConfig) -> Tables:
    """Trimmed, active enough, not reactivated; stored as the snapshot later steps read."""
    kept = apply_min_actions(trimmed_tables(tables, study), study.min_actions)
    kept = drop_reactivated(kept, study.window_end, study.reactivation_days)
    return save_snapshot(kept, f"{out}/cleaned", by="user_id")


def features(tables: Tables, out: str, study: StudyConfig) -> tuple[DataFrame, DataFrame]:
    """Survival data set and model inputs of cleaned tables, both stored."""
    survival = save_table(survival_dataset(tables, study, co_located=True), f"{out}/survival")
    return survival, save_table(engineered_features(survival, study, stored=True), f"{out}/engineered")


def profile_features(survival: DataFrame, engineered: DataFrame, study: StudyConfig):
    logs = list(LOG_OF)
    related = [*logs, "survival_time", "tenure_years", "tenure_friend_int", "elite_compl_int"]
    return {
        "dataset_summary": dataset_summary(survival),
        "churn_distribution": churn_distribution(survival),
        "raw_histograms": feature_histograms(survival, list(RAW_FEATURES), study.histogram_bins),
        "log_histograms": feature_histograms(engineered, logs, study.histogram_bins),
        "correlation": correlation_matrix(engineered, related),
        "nonfinite_pct": nonfinite_pct(engineered, predictors(engineered.columns)),
        "leakage_flags": models.leakage_flags(predictors(engineered.columns), engineered),
    }


def model_reports(engineered: DataFrame, study: StudyConfig) -> dict[str, DataFrame]:
    spark = engineered.sparkSession
    survival_label(engineered).write.format("noop").mode("overwrite").save()
    full = models.full_model(engineered, study)
    safe = models.time_safe_model(engineered, study)
    reports = {
        "full_cv": full.path.cv_table(spark),
        "full_importance": full.importance(),
        "full_concordance": full.test_concordance(),
        "time_safe_cv": safe.path.cv_table(spark),
        "time_safe_importance": safe.importance(),
        "time_safe_concordance": safe.test_concordance(),
        "leakage_sensitivity": models.leakage_sensitivity(engineered, study),
    }
    if safe.path.beta:
        plain = fit_unpenalised(safe.train, list(safe.path.beta), True, time_moments=True)
        reports["time_safe_plain_fit"] = plain.table(spark)
        reports["ph_test"] = ph_test(plain, spark)
        reports["schoenfeld_residuals"] = schoenfeld_residuals(plain, safe.train)
    return reports


def run(
    spark: SparkSession, paths: dict[str, str], out: str, study: StudyConfig = StudyConfig()
) -> dict[str, DataFrame]:
    """Everything; returns the stored reports by name."""
    loaded = load(spark, paths, out, study)
    reports = profile_activity(loaded, study)
    survival, engineered = features(clean(loaded, out, study), out, study)
    reports |= profile_features(survival, engineered, study)
    reports |= model_reports(engineered, study)
    return {name: save_table(df, f"{out}/reports/{name}") for name, df in reports.items()}

"""The physical plans of the relational queries hold nothing that cannot scale."""

import re

import pytest

from conftest import SMALL
from tenurekit.operators.cleaning import drop_users, keep_users, qualifying_users
from tenurekit.plans import features
from tenurekit.queries import QUERIES
from tenurekit.sources import roles
from tenurekit.sources.roles import ROLE_STUDY as STUDY
from tenurekit.sources.tables import load_table, save_snapshot

RELATIONAL = [
    "reviews_of_category", "keep_qualifying", "drop_reactivated", "user_activity", "event_rank",
    "event_gaps", "first_second_events", "qualifying_users", "early_churn_outcomes",
    "gap_percentiles", "censoring_by_threshold", "monthly_activity", "user_timeline",
    "review_votes", "user_social", "survival_dataset", "engineered_features", "unpivot_features",
    "seeded_sample", "split_explode", "extract_years", "duplicate_keys",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", RELATIONAL)
def test_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Python" not in plan and "Arrow" not in plan
    windows = re.findall(r"Window \[.*", plan)
    assert all("windowspecdefinition(" in w for w in windows)
    assert not [w for w in windows if re.search(r"windowspecdefinition\([^,]*(ASC|DESC)", w)]


def test_flagship_reads_each_fact_once_and_only_what_it_needs(spark):
    plan = plan_of(QUERIES["survival_dataset"](spark, SMALL))
    assert "l_extendedprice" not in plan and "o_orderstatus" not in plan
    # One exchange for the stacked facts, at most one more for the users they meet.
    assert len(re.findall(r"Exchange hashpartitioning\(user_id#\d+L, \d+\)", plan)) <= 2


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["elite_counts"](spark, SMALL))
    assert "GreaterThan(o_totalprice,450000.0)" in plan


def test_snapshots_by_user_take_no_shuffle_by_user(spark, tmp_path, rows):
    found = roles.role_tables(spark, SMALL)
    stored = save_snapshot(found, str(tmp_path), by="user_id")
    again = {name: load_table(spark, str(tmp_path / name)) for name in stored}
    for tables in (stored, again):
        trimmed = features.trimmed_tables(tables, STUDY)
        df = features.survival_dataset(trimmed, STUDY, STUDY.min_actions, co_located=True)
        assert "Exchange" not in plan_of(df)
        assert rows(df) == rows(features.study_dataset(found, STUDY))
    kept = keep_users(again["reviews"], qualifying_users(again["reviews"], 2).hint("merge"))
    assert "Exchange" not in plan_of(kept)
    gone = drop_users(again["tips"], qualifying_users(again["reviews"], 2).hint("merge"))
    assert "Exchange" not in plan_of(gone)


def test_correlations_send_tables_not_rows(spark):
    plan = plan_of(QUERIES["feature_correlation"](spark, SMALL))
    assert len(re.findall("MapInArrow", plan)) == 3 and "CartesianProduct" not in plan
    assert not re.findall(r"Exchange.*\[(?!tables)", "\n".join(x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning" in x))

from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest

from tenurekit.columns import COMPLIMENTS, SINCE, SNAPSHOT_VARIABLES, core_predictors, predictors
from tenurekit.config import StudyConfig
from tenurekit.plans import features

STUDY = StudyConfig()
END = STUDY.window_end
JOIN = date(2015, 1, 1)
REVIEW = "user_id long, date date, useful_per_review int, funny_per_review int, cool_per_review int"


def make_tables(spark, users, reviews, tips=(), friends=(), elite=()):
    schema = f"user_id long, {SINCE} date, " + ", ".join(f"{c} int" for c in COMPLIMENTS)
    return {
        "users": spark.createDataFrame(users, schema),
        "reviews": spark.createDataFrame(reviews, REVIEW),
        "tips": spark.createDataFrame(list(tips), "user_id long, date date"),
        "user_friends": spark.createDataFrame(list(friends), "user_id long, friend_id long"),
        "user_elite_years": spark.createDataFrame(list(elite), "user_id long, elite_year int"),
    }


def user(key, join=JOIN, compliments=(1,) * 11):
    return (key, join, *compliments)


def ago(days):
    return END - timedelta(days=days)


def survive(tables, study=STUDY):
    return {r.user_id: r for r in features.survival_dataset(tables, study).collect()}


def test_churn_is_strict_at_the_threshold(spark):
    reviews = [(1, ago(365), 1, 0, 0), (2, ago(366), 1, 0, 0)]
    found = survive(make_tables(spark, [user(1), user(2)], reviews))
    assert (found[1].churned, found[2].churned) == (0, 1)
    assert found[1].survival_time == (END - JOIN).days
    assert found[2].survival_time == (ago(366) - JOIN).days
    assert found[2].tenure_years == found[2].survival_time / 365.0


def test_users_without_tenure_are_left_out(spark):
    users = [user(1), user(2), user(3), user(4, date(2019, 1, 1)), user(5)]
    reviews = [(1, JOIN, 0, 0, 0), (2, JOIN - timedelta(days=1), 0, 0, 0),
               (4, date(2019, 6, 1), 0, 0, 0), (5, None, 0, 0, 0)]
    assert survive(make_tables(spark, users, reviews)) == {}


def test_social_block(spark):
    users = [user(1, compliments=(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
             user(2, compliments=(None,) + (5,) * 10)]
    reviews = [(1, ago(10), 3, 2, 1), (1, ago(5), 1, -1, 9), (2, ago(10), 1, None, 1)]
    tables = make_tables(
        spark, users, reviews, tips=[(1, ago(1))], friends=[(1, 8), (1, 9)], elite=[(1, 2018)]
    )
    found = survive(tables)
    assert found[1].last_post == ago(1)
    assert (found[1].friend_count, found[1].years_elite, found[1].ever_elite) == (2, 1, 1)
    assert (found[1].total_votes_received, found[1].avg_votes_per_review) == (6, 6.0)
    assert found[1].total_compliments == 66
    assert found[2].total_compliments == 0
    assert (found[2].total_votes_received, found[2].avg_votes_per_review) == (0, 0.0)
    assert (found[2].friend_count, found[2].ever_elite) == (0, 0)
    assert found[1].friends_per_year == 2 / found[1].tenure_years


def test_study_trims_and_drops_single_events(spark):
    reviews = [(1, ago(10), 0, 0, 0), (2, ago(10), 0, 0, 0), (2, END + timedelta(days=1), 0, 0, 0),
               (3, ago(10), 0, 0, 0), (3, ago(20), 0, 0, 0)]
    tables = make_tables(spark, [user(1), user(2), user(3)], reviews)
    assert [r.user_id for r in features.study_dataset(tables, STUDY).collect()] == [3]


def test_study_equals_cleaning_first(spark, rows):
    from tenurekit.operators.cleaning import apply_min_actions
    from tenurekit.sources.roles import ROLE_STUDY, role_tables

    tables = role_tables(spark, "/root/testdata/sf0.001")
    cleaned = apply_min_actions(features.trimmed_tables(tables, ROLE_STUDY), 2)
    assert rows(features.survival_dataset(cleaned, ROLE_STUDY)) == rows(
        features.study_dataset(tables, ROLE_STUDY)
    )


@pytest.fixture(scope="module")
def engineered(spark):
    users = [user(i, compliments=(i % 2,) + (0,) * 10) for i in range(200)]
    reviews = [(i, ago(i + 1), i % 3, 0, 0) for i in range(200)]
    friends = [(i, k) for i in range(200) for k in range(i % 7)] + [(0, k) for k in range(900)]
    survival = features.survival_dataset(make_tables(spark, users, reviews, (), friends), STUDY)
    return survival, features.engineered_features(survival, STUDY)


def test_rate_is_capped_at_its_quantile(engineered):
    survival, out = engineered
    rates = np.array([r.friends_per_year for r in survival.collect()])
    cap = np.quantile(rates, 0.99)
    top = max(r.friends_per_year for r in out.collect())
    assert top == pytest.approx(cap, rel=1e-12) and top < rates.max()


def test_engineered_columns(engineered):
    _, out = engineered
    assert len(out.columns) == 27
    assert len(predictors(out.columns)) == 22
    assert core_predictors(out.columns) == [
        "tenure_years", "ever_elite", "years_elite", "zero_comp_flag", "zero_vote_flag",
        "log_years_elite",
    ]
    assert set(SNAPSHOT_VARIABLES) <= set(out.columns)
    for r in out.collect():
        assert r.zero_comp_flag == int(r.total_compliments == 0)
        assert r.log_friends_per_year == pytest.approx(np.log1p(r.friends_per_year))
        assert r.tenure_friend_int == pytest.approx(r.tenure_years * np.log1p(r.friend_count))


def test_cut_off_dates_come_from_the_study(spark):
    reviews = [(1, ago(10), 0, 0, 0)]
    tables = make_tables(spark, [user(1)], reviews)
    assert survive(tables, replace(STUDY, last_join=date(2014, 12, 31))) == {}

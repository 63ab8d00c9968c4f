from datetime import date, timedelta

import pytest

from tenurekit.operators import cleaning, quality
from tenurekit.operators.activity import trim_window

CUTOFF = date(2019, 12, 31)


def test_row_without_user_is_rejected(spark):
    frame = spark.createDataFrame([(1,), (None,)], "user_id long")
    with pytest.raises(Exception, match="row without user_id"):
        cleaning.require_key(frame).collect()


def _reactivation(spark):
    data = []
    for user, (gap, back) in enumerate([(364, 1), (365, 1), (366, 1), (366, 0), (None, 1)]):
        if gap is not None:
            data.append((user, CUTOFF - timedelta(days=gap)))
        if back:
            data.append((user, CUTOFF + timedelta(days=5)))
    return spark.createDataFrame(data, "user_id long, date date")


def test_reactivated(spark, rows):
    activity = _reactivation(spark)
    assert rows(cleaning.reactivated_users(activity, CUTOFF, 365)) == [(1,), (2,)]


def test_nobody_is_reactivated_after_trimming(spark):
    trimmed = trim_window(_reactivation(spark), date(2010, 1, 1), CUTOFF)
    assert cleaning.reactivated_users(trimmed, CUTOFF, 365).count() == 0


def test_rules_apply_to_all_tables(spark, rows):
    day = date(2019, 1, 1)
    dated = spark.createDataFrame([(1, day), (1, day), (2, day)], "user_id long, date date")
    none = dated.limit(0)
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    kept = cleaning.apply_min_actions({"reviews": dated, "tips": none, "users": users}, 2)
    assert rows(quality.table_counts(kept)) == [("reviews", 2), ("tips", 0), ("users", 1)]


def test_drop_keeps_rows_without_user(spark, rows):
    frame = spark.createDataFrame([(1,), (None,), (2,)], "user_id long")
    gone = spark.createDataFrame([(1,)], "user_id long")
    assert rows(cleaning.drop_users(frame, gone)) == [(2,), (None,)]


def test_duplicate_and_missing_keys(spark, rows):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a")], "u long, f string")
    assert rows(quality.duplicate_keys(frame, ["u", "f"])) == [(1, "a", 2), (1, None, 1)]
    with pytest.raises(ValueError, match="pairs"):
        quality.require_unique(frame, ["u", "f"], "pairs")
    quality.require_unique(frame.filter("u = 2"), ["u", "f"], "pairs")


def test_label_rejects_impossible_outcomes(spark):
    schema = "user_id long, survival_time double, churned int"
    good = spark.createDataFrame([(1, 5.0, 1)], schema)
    assert quality.survival_label(good).count() == 1
    for bad in [(1, 0.0, 1), (1, 5.0, 2)]:
        with pytest.raises(Exception, match="survival time"):
            quality.survival_label(spark.createDataFrame([bad], schema)).collect()

from datetime import date

import pytest

from tenurekit.operators import activity as act

END = date(2019, 12, 31)


def day(text):
    return date.fromisoformat(text)


@pytest.fixture
def events(spark):
    data = [
        (1, "2019-01-01"), (1, "2019-01-01"), (1, "2019-01-11"), (1, None), (1, None),
        (2, "2018-06-01"), (3, "2019-12-31"), (4, None), (5, None), (5, "2019-05-05"),
    ]
    return spark.createDataFrame(
        [(u, d and day(d)) for u, d in data], "user_id long, date date"
    )


def test_rank_puts_missing_dates_last(events, rows):
    found = rows(act.event_rank(events).filter("user_id = 1"))
    assert sorted(r[2] for r in found) == [1, 2, 3, 4, 5]
    assert {r[2] for r in found if r[1] is None} == {4, 5}


def test_gaps(events, rows):
    found = rows(act.event_gaps(events), "user_id", "days_between")
    # The first missing date has a previous event but no length; the second has none.
    assert found == sorted([(1, 0), (1, 10), (1, None), (5, None)], key=repr)


@pytest.mark.parametrize("chunk", [1, 2, 10_000])
def test_large_days_are_repeated_in_chunks(spark, monkeypatch, rows, chunk):
    monkeypatch.setattr(act, "REPEAT_CHUNK", chunk)
    hot = spark.createDataFrame([(7, day("2019-03-03"))] * 5, "user_id long, date date")
    assert [r[2] for r in rows(act.event_rank(hot))] == [1, 2, 3, 4, 5]
    assert rows(act.event_gaps(hot), "days_between") == [(0,)] * 4


def test_first_and_second(events, rows):
    found = {r[0]: r[1:] for r in rows(act.first_second_events(events))}
    assert found[1] == (day("2019-01-01"), day("2019-01-01"), 5)
    assert found[2] == (day("2018-06-01"), None, 1)
    assert found[4] == (None, None, 1)
    assert found[5] == (day("2019-05-05"), None, 2)


def test_outcomes_are_strict(spark, rows):
    data = [(1, "2018-12-31"), (2, "2018-12-30"), (3, "2019-12-31"), (3, "2019-12-30")]
    frame = spark.createDataFrame([(u, day(d)) for u, d in data], "user_id long, date date")
    assert rows(act.early_churn_outcomes(frame, 365)) == [
        ("1 action only", 1), (">1 action", 1), ("uncertain (near end)", 1)
    ]


def test_censoring(spark, rows):
    data = [(1, "2018-12-31"), (2, "2018-12-30"), (3, "2019-12-31"), (4, "2019-10-02")]
    frame = spark.createDataFrame([(u, day(d)) for u, d in data], "user_id long, date date")
    found = rows(act.censoring_by_threshold(frame, END, (90, 365)))
    assert [(r[0], r[2]) for r in found] == [(365, 3), (90, 2)]
    assert found[0][3] + found[0][4] == 100


def test_trim_keeps_missing_dates_and_is_idempotent(events, rows):
    once = act.trim_window(events, day("2019-01-01"), END)
    assert once.count() == 9
    assert rows(act.trim_window(once, day("2019-01-01"), END)) == rows(once)


def test_percentiles_do_not_depend_on_partitions(events, rows):
    one, many = events.repartition(1), events.repartition(17)
    assert rows(act.gap_percentiles(one, (0.5, 0.9))) == rows(act.gap_percentiles(many, (0.5, 0.9)))
    assert rows(act.gap_percentiles(one, (0.5, 0.9))) == [("50th", 5.0), ("90th", 9.0)]

import numpy as np
import pytest

from tenurekit.operators import concordance as con


def brute(score, time, event):
    c = d = t = 0
    for i in np.flatnonzero(event):
        for j in range(len(score)):
            if time[i] < time[j] or (time[i] == time[j] and not event[j]):
                c += score[i] > score[j]
                d += score[i] < score[j]
                t += score[i] == score[j]
    return int(c), int(d), int(t)


def data(n=300, seed=0):
    rng = np.random.default_rng(seed)
    score = np.where(rng.random(n) < 0.3, 7.0, rng.integers(0, 40, n))
    return score, rng.integers(1, 30, n).astype(float), rng.integers(0, 2, n)


def test_local_count():
    score, time, event = data()
    found = con.count_pairs(score, time, event.astype(np.int64), (1 - event).astype(np.int64))
    assert found == brute(score, time, event)


@pytest.mark.parametrize("leaf_rows", [2, 10, 40, 100_000])
def test_levels_count_every_pair_once(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(con, "FANOUT", 3)
    score, time, event = data(seed=4)
    frame = spark.createDataFrame(
        [(float(s), float(t), int(e), -float(s)) for s, t, e in zip(score, time, event)],
        "s double, survival_time double, churned int, r double",
    )
    found = {r.score: r for r in con.concordance(frame, ["s", "r"], leaf_rows=leaf_rows).collect()}
    c, d, t = brute(score, time, event)
    s, r = found["s"], found["r"]
    assert (s.concordant, s.discordant, s.tied) == (c, d, t)
    assert (r.concordant, r.discordant, r.tied) == (d, c, t)
    assert s.c_index == pytest.approx((c + t / 2) / (c + d + t))


def test_weights_beyond_64_bits():
    big = np.array([2**40, 2**40, 2**40])
    zero = np.zeros(3, dtype=np.int64)
    found = con.count_pairs(np.array([3.0, 2.0, 1.0]), np.array([1.0, 2.0, 3.0]), big, zero)
    assert found == (3 * 2**80, 0, 0)


@pytest.mark.parametrize("leaf_rows", [3, 25])
def test_levels_of_time_count_every_pair_once(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(con, "FANOUT", 4)
    rng = np.random.default_rng(leaf_rows)
    score = np.where(rng.random(500) < 0.4, 7.0, rng.integers(0, 60, 500))
    time = np.where(rng.random(500) < 0.3, 11.0, rng.random(500) * 30)
    event = rng.integers(0, 2, 500)
    frame = spark.createDataFrame(
        [(float(s), float(t), int(e)) for s, t, e in zip(score, time, event)],
        "s double, survival_time double, churned int",
    )
    rows = con.compared_rows(frame, ["s"], leaf_rows=leaf_rows)
    assert rows.agg({"time_level": "max"}).first()[0] > 1
    found = con.concordance(frame, ["s"], leaf_rows=leaf_rows).first()
    assert (found.concordant, found.discordant, found.tied) == brute(score, time, event)


def test_groups_are_bounded_whatever_the_times(spark, monkeypatch):
    monkeypatch.setattr(con, "FANOUT", 16)
    # A million different times; a third of all rows have one score.
    frame = spark.range(1_000_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 5.0D ELSE CAST(pmod(hash(id), 100000) AS DOUBLE) END AS s",
        "CAST(pmod(id * 7919, 1000003) AS DOUBLE) AS survival_time",
        "CAST(id % 2 AS INT) AS churned",
    )
    leaf_rows = 20_000
    rows = con.compared_rows(frame, ["s"], leaf_rows=leaf_rows)
    largest = rows.groupBy(*con.GROUP).count().agg({"count": "max"}).first()[0]
    assert largest <= 2 * leaf_rows
    found = con.concordance(frame, ["s"], leaf_rows=leaf_rows).first()
    events = np.arange(1_000_000) % 2
    ranked = np.argsort(np.arange(1_000_000) * 7919 % 1000003)
    comparable = int((events[ranked] * (999_999 - np.arange(1_000_000))).sum())
    assert found.concordant + found.discordant + found.tied == comparable

import hashlib

import numpy as np
import pytest

from tenurekit.operators import profiling, quality, splitting
from tenurekit.operators.comoments import MERGERS, correlation_matrix
from tenurekit.operators.numbering import number_rows
from tenurekit.plans.models import feature_matrix


@pytest.mark.parametrize("accuracy", [10, 100, 50_000])
@pytest.mark.parametrize("probability", [0.0, 0.37, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, accuracy, probability):
    rng = np.random.default_rng(7)
    values = np.r_[rng.lognormal(size=700), np.zeros(400), rng.integers(0, 5, 200)]
    data = [(float(v),) for v in values] + [(None,), (float("nan"),)]
    frame = spark.createDataFrame(data, "x double").repartition(5)
    found = profiling.exact_quantile(frame, "x", probability, accuracy)
    assert found == pytest.approx(np.quantile(values, probability), rel=1e-12, abs=1e-12)


def test_quantile_survives_a_wrong_sketch(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(
        profiling.F, "percentile_approx", lambda *a: F.array(F.lit(1.0), F.lit(2.0))
    )
    frame = spark.range(101).selectExpr("CAST(id AS DOUBLE) AS x")
    assert profiling.exact_quantile(frame, "x", 0.905) == pytest.approx(90.5)
    assert profiling.exact_quantile(frame.limit(0), "x", 0.9) is None


def test_nonfinite(spark, rows):
    data = [(1.0, 1, None), (None, 2, None), (float("nan"), 3, None), (float("inf"), 4, None),
            (float("-inf"), 5, None)]
    frame = spark.createDataFrame(data, "x double, y int, z int")
    assert rows(quality.nonfinite_pct(frame, ["x", "y", "z"])) == [("x", 80.0), ("z", 100.0)]


def test_correlation(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=300), rng.normal(size=300)
    y = y + x
    data = [(float(a), float(b), 1.0) for a, b in zip(x, y)] + [(None, 5.0, 1.0)]
    frame = spark.createDataFrame(data, "a double, b double, c double")
    found = {(r.x, r.y): r.r for r in correlation_matrix(frame, list("abc")).collect()}
    assert found["a", "b"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert found["a", "c"] is None and found["b", "c"] is None


@pytest.mark.parametrize("width, partitions", [(5, 1), (7, 40), (200, 6)])
def test_correlation_of_columns_with_gaps_and_offsets(spark, width, partitions):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(400, width)) + rng.normal(size=(400, 1))
    x = x * 10.0 ** rng.integers(-3, 4, width) + np.where(np.arange(width) % 2, 1e9, 0.0)
    x[:, 1] = rng.integers(0, 3, 400) + 1e9
    gone = rng.random((400, width)) < rng.choice([0.0, 0.1, 0.6], width)
    gone[: 400 // 2, 0] = True
    names = [f"f.{k}" for k in range(width)]
    rows = [[None if g else float(v) for v, g in zip(r, m)] for r, m in zip(x, gone)]
    frame = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in names)).repartition(partitions)
    found = {(r.x, r.y): r.r for r in correlation_matrix(frame, names).collect()}
    assert len(found) == width * (width - 1) // 2 and MERGERS > 1
    for (a, b), r in list(found.items())[:: 1 if width < 20 else 97]:
        i, j = names.index(a), names.index(b)
        both = ~gone[:, i] & ~gone[:, j]
        # Offsets are taken off before the plain version, which would lose digits.
        u, v = (x[both, k] - x[both, k][0] for k in (i, j))
        assert r == pytest.approx(np.corrcoef(u, v)[0, 1], abs=1e-9)


def test_correlation_of_constants_nans_and_nothing(spark):
    data = [(0.1, 1.0, float("nan"), None), (0.1, 2.0, 1.0, 5.0), (0.1, 4.0, 2.0, 6.0), (0.1, None, 3.0, 9.0)] * 50
    frame = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(7)
    found = {(r.x, r.y): r.r for r in correlation_matrix(frame, list("abcd")).collect()}
    assert found["a", "b"] is None and found["a", "d"] is None
    assert np.isnan(found["b", "c"]) and found["b", "d"] == pytest.approx(1.0)
    assert found["c", "d"] == pytest.approx(np.corrcoef([1, 2, 3], [5, 6, 9])[0, 1])
    assert [r.r for r in correlation_matrix(frame.limit(0), list("abc")).collect()] == [None] * 3


def test_histogram(spark, rows):
    data = [(float(v), 3.0, None) for v in range(31)]
    frame = spark.createDataFrame(data, "a double, b double, c double")
    found = rows(profiling.feature_histograms(frame, ["a", "b", "c"], 30))
    assert ("b", 1, 31) in found
    assert dict((b, n) for f, b, n in found if f == "a") == {**{i: 1 for i in range(1, 30)}, 30: 2}
    assert not [f for f in found if f[0] == "c"]


def test_sample_is_exact_and_reproducible(spark, rows):
    frame = spark.range(5000).withColumnRenamed("id", "user_id")
    one = rows(splitting.seeded_sample(frame.repartition(1), 777, 5))
    assert len(one) == 777
    assert one == rows(splitting.seeded_sample(frame.repartition(17), 777, 5))
    assert one != rows(splitting.seeded_sample(frame, 777, 6))
    assert splitting.seeded_sample(frame, 5001, 5).count() == 5000
    assert splitting.seeded_sample(frame, 5000, 5).count() == 5000


@pytest.mark.parametrize("digits, few", [(1, 3), (2, 1), (4, 4096)])
def test_sample_takes_the_smallest_hashes(spark, monkeypatch, digits, few):
    monkeypatch.setattr(splitting, "SAMPLE_HEX_DIGITS", digits)
    monkeypatch.setattr(splitting, "FEW_ROWS", few)
    frame = spark.range(700).withColumnRenamed("id", "user_id")
    order = sorted(range(700), key=lambda k: hashlib.md5(f"{k}:9".encode()).hexdigest())
    for n in (0, 1, 2, 350, 699, 700, 701):
        found = splitting.seeded_sample(frame, n, 9)
        assert sorted(r.user_id for r in found.collect()) == sorted(order[:n])
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [2, 4096])
def test_sample_of_repeated_keys_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(splitting, "FEW_ROWS", few)
    frame = spark.range(60).selectExpr("id % 3 AS user_id", "id AS other")
    for n in (1, 19, 20, 21, 40, 41, 59, 60):
        assert splitting.seeded_sample(frame, n, 4).count() == n


def test_folds(spark):
    frame = spark.range(5000).withColumnRenamed("id", "user_id")
    sizes = [r["count"] for r in splitting.with_folds(frame, 5, 1).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and min(sizes) > 850


def test_numbers_with_many_equal_rows(spark):
    frame = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS k")
    found = number_rows(frame.repartition(9), ["k"], "n").orderBy("n").collect()
    assert [r.n for r in found] == list(range(1, 3001))
    assert [r.k for r in found] == sorted(r.k for r in found)
    assert number_rows(frame.limit(0), ["k"], "n").count() == 0


def test_feature_matrix_rejects_missing_values(spark):
    frame = spark.createDataFrame([(1, 2.0, True), (2, None, False)], "user_id long, a double, b boolean")
    good = feature_matrix(frame.filter("user_id = 1"), ["a", "b"])
    assert good.first().features == [2.0, 1.0]
    with pytest.raises(Exception):
        feature_matrix(frame, ["a", "b"]).collect()


@pytest.mark.parametrize("values", [
    [float(x % 37) for x in range(500)], [1.0] * 300, [float(x) for x in range(400)], [0.0] * 200 + [5.0], [2.5],
])
def test_quantile_narrows_to_the_exact_value(spark, monkeypatch, values):
    monkeypatch.setattr(profiling, "SMALL", 10)
    monkeypatch.setattr(profiling, "EDGES", 4)
    frame = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    for p in (0.0, 0.31, 0.5, 0.99, 1.0):
        assert profiling.exact_quantile(frame, "x", p) == pytest.approx(np.quantile(values, p), abs=1e-12)

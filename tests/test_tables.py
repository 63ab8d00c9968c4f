import os

import pytest
from pyspark.sql import functions as F

from tenurekit.sources import tables


def test_a_table_is_replaced_and_read_back(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        tables.load_table(spark, path)
    first = tables.save_table(spark.range(5), path)
    assert first.count() == 5
    tables.save_table(spark.range(3), path)
    assert tables.load_table(spark, path).count() == 3
    assert first.count() == 5  # readers of the version before go on
    tables.save_table(spark.range(2), path)
    assert sorted(x.split("-")[0] for x in os.listdir(path) if not x.startswith(".")) == ["CURRENT", "version", "version"]


def test_a_failing_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(10).repartition(2), path)
    # The last rows fail after others have been written.
    bad = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") < 990, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.save_table(bad, path)
    assert tables.load_table(spark, path).count() == 10
    tables.save_table(spark.range(4), path)
    assert tables.load_table(spark, path).count() == 4


def test_a_table_can_be_replaced_from_itself(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    tables.save_table(spark.range(6), path)
    for _ in range(3):
        tables.save_table(tables.load_table(spark, path).select((F.col("id") + 1).alias("id")), path)
    assert rows(tables.load_table(spark, path)) == sorted([(k + 3,) for k in range(6)], key=repr)


def test_a_snapshot_counts_while_it_writes(spark, tmp_path, rows, monkeypatch):
    reads = []
    monkeypatch.setattr(tables, "load_table", lambda *a: reads.append(a))
    many = {"a": spark.range(7), "b": spark.range(0), "c": spark.range(100).repartition(9)}
    found = tables.snapshot_counts(many, str(tmp_path))
    assert rows(found) == [("a", 7), ("b", 0), ("c", 100)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "parquet" not in plan and not reads


def test_preview(spark, rows):
    frame = spark.createDataFrame([(3, "c"), (None, "x"), (1, "a"), (2, "b")], "k int, v string")
    assert [r.v for r in tables.preview(frame, ["k"], 3).collect()] == ["a", "b", "c"]


def test_bucketed_tables_are_replaced_too(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    frame = spark.range(50).selectExpr("id % 7 AS k", "CAST(id AS DECIMAL(9, 2)) AS v", "array(id) AS `a b`")
    tables.save_table(frame, path, by="k", buckets=3)
    found = tables.load_table(spark, path)
    assert rows(found) == rows(frame) and found.dtypes == frame.dtypes
    assert tables.save_table(found.filter("k > 2"), path, count=True, by="k", buckets=5)[1] == 28
    tables.save_table(tables.load_table(spark, path).limit(3), path)
    assert tables.load_table(spark, path).count() == 3

"""Queries that store something run where the master is a cluster's and the checkpoint folder a file: mount."""

from datetime import datetime, timedelta

import pytest

from tenurekit import session
from tenurekit.queries import QUERIES
from tenurekit.sources.roles import SCHEMAS

STORING = [
    "concordance_index",
    "core_feature_columns",
    "drop_reactivated",
    "engineered_features",
    "engineered_roundtrip",
    "feature_correlation",
    "feature_matrix",
    "keep_qualifying",
    "scan_businesses",
    "scan_reviews",
    "scan_tips",
    "scan_users",
    "scan_with_bad_lines",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    day = lambda k: datetime(1995, 1, 1) + timedelta(days=k)
    n = 60
    found = {
        "customer": [(u, f"user {u}", u % 5, float(u * 100 % 900 - 200), "AUTO") for u in range(1, n)],
        "part": [(p, f"part {p}", "Brand#1", "PROMO TIN" if p % 2 else "SMALL TIN", p, 900.0 + p) for p in range(1, 9)],
        "orders": [
            (o, 1 + o * 7 % (n - 1), "F", 1000.0 * (o % 500), day(o * 11 % 2100), "1-URGENT" if o % 3 == 0 else "5-LOW")
            for o in range(1, 600)
        ],
        "lineitem": [
            (o, 1 + (o + k) % 8, 1 + o % 4, k, float(1 + o % 40), 100.0, 0.01 * (o % 9), 0.02, "R" if o % 2 else "N", "F", day(o * 11 % 2100 + k))
            for o in range(1, 600) for k in (1, 2)
        ],
    }
    for name, rows in found.items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return str(top)


@pytest.fixture
def cluster(spark, monkeypatch, tmp_path):
    context, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(context, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    yield spark
    context.setCheckpointDir(before or str(tmp_path))


@pytest.mark.parametrize("name", STORING)
def test_storing_queries_run_on_clusters(cluster, folder, name):
    assert QUERIES[name](cluster, folder).count() > 0


def test_lines_go_once_they_are_split(cluster, folder, tmp_path):
    found = {r.what: r.n for r in QUERIES["scan_with_bad_lines"](cluster, folder).collect()}
    lines = [(o, k) for o in range(1, 600) for k in (1, 2)]
    good = [(o, k) for o, k in lines if o % 50 > 1]
    promo = [(o, k) for o, k in good if (1 + (o + k) % 8) % 2]
    assert found == {"lines": len(lines), "rows": len(good), "bad": len(lines) - len(good), "of the category": len(promo)}
    assert list(tmp_path.glob("*/aside-*")) and not list(tmp_path.glob("*/review-*"))

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrameReader

from tenurekit import session


@pytest.fixture
def cluster(spark, monkeypatch, tmp_path):
    """The session as if its master were a cluster's, with a checkpoint folder named by path."""
    context, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    context.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(context, "master", "spark://host:7077")
    monkeypatch.setattr(session, "_SHARED", set())
    yield spark
    context.setCheckpointDir(before or str(tmp_path))


def test_a_cluster_may_share_a_mounted_folder(cluster):
    path = session.scratch_path(cluster, "rows")
    assert path.startswith("file:")
    assert session.cut_lineage(cluster.range(10)).count() == 10
    assert not any(name.startswith("shared-") for _, names, _ in os.walk(path[5:].rsplit("/", 1)[0]) for name in names)


def test_a_folder_of_each_machine_fails(cluster, monkeypatch):
    read = DataFrameReader.parquet

    def without_one_file(self, path):
        parts = sorted(x for x in os.listdir(path[5:]) if x.startswith("part-"))
        os.remove(f"{path[5:]}/{parts[0]}")
        return read(self, path)

    monkeypatch.setattr(DataFrameReader, "parquet", without_one_file)
    with pytest.raises(RuntimeError, match="isn't shared"):
        session.shared_folder(cluster)


@pytest.mark.parametrize("master, settings, wanted", [
    ("spark://host:7077", {}, "hdfs://host/warehouse/checkpoints"),
    ("local-cluster[2,1,1024]", {}, "hdfs://host/warehouse/checkpoints"),
    ("spark://host:7077", {"spark.checkpoint.dir": "hdfs://host/kept"}, "hdfs://host/kept"),
])
def test_the_warehouse_stands_in_for_a_missing_setting(master, settings, wanted):
    known, chosen = {"spark.sql.warehouse.dir": "hdfs://host/warehouse/"} | settings, []
    context = SimpleNamespace(
        master=master, applicationId="app", getCheckpointDir=lambda: (chosen or [None])[-1], setCheckpointDir=chosen.append
    )
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: known.get(key, default)))
    assert session.shared_folder(fake) == wanted

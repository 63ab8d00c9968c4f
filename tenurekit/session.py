"""Session helpers: local sessions for tests, the shared folder for cut points."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tenurekit")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder or file that no later step reads."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def require_shared(spark: SparkSession, folder: str) -> None:
    """Fail unless rows that executors write below the folder are there for the driver and for other tasks."""
    path = f"{folder.rstrip('/')}/shared-{uuid.uuid4().hex}"
    n = 4 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).write.parquet(path)
    try:
        found = spark.read.schema("id long").parquet(path).count()
    finally:
        delete(spark, path)
    if found != n:
        raise RuntimeError(f"{folder} isn't shared: of {n} rows written by executors, {found} arrived")


#: Applications and folders that ``require_shared`` has passed.
_SHARED: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Without that setting a
    cluster's warehouse takes it, which executors write tables to anyway; only a
    local master falls back to a temporary folder. A ``file:`` folder on a cluster
    may be a mount that all share or a folder of each machine, which would lose
    rows, so it is tried out once.
    """
    context = spark.sparkContext
    one_machine = context.master == "local" or context.master.startswith("local[")
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and one_machine:
            folder = tempfile.mkdtemp(prefix="tenurekit-")
        context.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    folder = context.getCheckpointDir()
    tried = context.applicationId, folder
    if folder.startswith("file:") and not context.master.startswith("local") and tried not in _SHARED:
        require_shared(spark, folder)
        _SHARED.add(tried)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Since Spark 4.1; older versions keep shuffle files until the driver collects its garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of frames made and read inside go when their job ends; such a frame is read once.

    Passes that follow each other for minutes would otherwise fill the disks with sums nobody reads again.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)

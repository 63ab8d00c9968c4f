"""Tables on disk: write, replace, read back, snapshot, preview.

A table is a folder with one folder of Parquet files per version and a small file that names the current
one. A new version is written beside the old, and only a finished one is named, by renaming a new pointer
over the old in one step. So a write that fails leaves the old table as it was, readers of the old version
go on reading it, and a table can be replaced by a frame that reads it. The version before the current one
stays for such readers; older ones go. One writer at a time is assumed.

A table may be bucketed and sorted by a key. Tables with the same key and number of buckets are joined and
aggregated by it without a shuffle; the pointer says how a version is laid out, so any session can use it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER, VERSION = "CURRENT", "version-"


class _Folder:
    """The few steps on files, by the drivers that Spark itself writes with."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.path, self.conf = path.rstrip("/"), spark.sparkContext._jsc.hadoopConfiguration()
        self.system = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def current(self) -> tuple[str, str | None, int]:
        """The version that the pointer names, its key and number of buckets; no version if there is none."""
        if not self.system.exists(self.at(POINTER)):
            return "", None, 0
        stream = self.system.open(self.at(POINTER))
        try:
            version, *layout = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            return version, *((layout[0], int(layout[1])) if layout else (None, 0))
        finally:
            stream.close()

    def point_to(self, version: str, by: str | None, buckets: int) -> None:
        """Name the current version, for all later readers at once."""
        fresh = self.at(f"{POINTER}-{version}")
        stream = self.system.create(fresh)
        stream.write(bytearray("\n".join([version, *([by, str(buckets)] if by else [])]).encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.conf)
        context.rename(fresh, self.at(POINTER), options)

    def remove_all_but(self, versions: set[str]) -> list[str]:
        gone = []
        for status in self.system.listStatus(self.at("")):
            name = status.getPath().getName()
            if name.startswith(VERSION) and name not in versions:
                self.system.delete(status.getPath(), True)
                gone.append(name)
        return gone


def _registered(version: str) -> str:
    """Name of a bucketed version in the session's catalogue."""
    return version.replace("-", "_")


def _read(spark: SparkSession, path: str, version: str, by: str | None, buckets: int) -> DataFrame:
    place = f"{path.rstrip('/')}/{version}"
    plain = spark.read.parquet(place)
    if by is None:
        return plain
    name = _registered(version)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{by}`) SORTED BY (`{by}`) "
            f"INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


def save_table(
    df: DataFrame, path: str, count: bool = False, by: str | None = None, buckets: int | None = None
) -> DataFrame | tuple[DataFrame, int]:
    """Write a table, replacing what is there, and return it as read from disk.

    With ``count`` also the number of rows written, observed while they are. ``by`` buckets the table
    by a key, into as many buckets as shuffles have partitions unless told otherwise.
    """
    spark, seen = df.sparkSession, Observation()
    folder = _Folder(spark, path)
    before, version = folder.current()[0], f"{VERSION}{uuid.uuid4().hex}"
    place = f"{folder.path}/{version}"
    written = df.observe(seen, F.count(F.lit(1)).alias("n")) if count else df
    if by is None:
        written.write.parquet(place)
    else:
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = written.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by)
        dealt.option("path", place).saveAsTable(_registered(version))
    folder.point_to(version, by, buckets or 0)
    for gone in folder.remove_all_but({before, version}):
        spark.sql(f"DROP TABLE IF EXISTS {_registered(gone)}")
    out = _read(spark, path, version, by, buckets or 0)
    return (out, seen.get["n"]) if count else out


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table."""
    version, by, buckets = _Folder(spark, path).current()
    if not version:
        raise FileNotFoundError(f"no table at {path}")
    return _read(spark, path, version, by, buckets)


def save_snapshot(tables: dict[str, DataFrame], folder: str, by: str | None = None) -> dict[str, DataFrame]:
    """Write every table below ``folder`` and return the written ones."""
    return {name: save_table(df, f"{folder.rstrip('/')}/{name}", by=by) for name, df in tables.items()}


def snapshot_counts(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Write a snapshot and tell how many rows arrived, counted while they were written."""
    rows = [
        (name, save_table(df, f"{folder.rstrip('/')}/{name}", count=True)[1])
        for name, df in tables.items()
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, n long")


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def preview(df: DataFrame, order: list[str], n: int = 15) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in order)).limit(n)

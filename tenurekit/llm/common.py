"""What the operators of this package share: tables, scratch tables, keys, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.session import scratch_path

FOLDS = 5
#: Texts are worked on in slices of about so many characters, so a task's memory doesn't follow its input.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """The frame written as a table in the shared folder and read again, and the table's path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that no later step reads."""
    for path in paths:
        place, system = _place(spark, path)
        system.delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    place, system = _place(spark, path)
    system.mkdirs(place)


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(lengths: list[int] | np.ndarray, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` characters each, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 bytes, null as empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        lengths = np.diff(np.asarray(_offsets(texts)))
        for i, j in slices(lengths, most):
            part = batch.slice(i, j - i)
            yield part, [x or b"" for x in texts.slice(i, j - i).to_pylist()]


def _offsets(texts: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    buffer = texts.buffers()[1]
    if buffer is None:
        return np.zeros(len(texts) + 1, width)
    return np.frombuffer(buffer, width)[texts.offset : texts.offset + len(texts) + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

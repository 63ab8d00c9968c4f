"""Tokens per document of flat token files: a vectorised search for end-of-document ids, block by block.

A token file is nothing but ids of a fixed width, documents divided by a separator id, without an
index. Files are cut into byte ranges that any task can read; a task finds separators in its range by
one vector comparison. A document may cross any number of blocks: a prefix scan over block summaries
(separators so far, place of the last one) gives the start of the document that is open where a block
begins, and its number in the file. The scan has two levels, so no file has all its blocks in one group.

Defined cases: two separators in a row enclose an empty document of 0 tokens; ids after a file's last
separator are a last document with ``ended = false``; an empty file has none; a file whose size is no
multiple of the id width raises, and so does writing an id that the width can't hold. The writer gives null
and empty texts 0 tokens, keeps repeated rows, and never emits the separator for text that spells it.

Token files are read and written by byte range, which Spark's readers don't offer, so tasks open them with Arrow's
file systems: local and shared folders, ``hdfs``, ``gs``, ``abfs(s)`` and ``s3``; ``s3a`` and ``s3n`` mean ``s3``.
Access to object stores then follows their own environment settings, not those of Hadoop.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenurekit.llm.common import id_and_text, make_folder, stored
from tenurekit.llm.tokens import END_OF_TEXT_ID, VOCABULARY, token_ids
from tenurekit.session import scratch_path

#: Ids are unsigned and little-endian; two bytes hold all ids of the vocabulary.
WIDTH = 2
BLOCK_BYTES = 8 << 20
#: Blocks of a first-level group of the scan.
GROUP_BLOCKS = 4096


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    """The path as Arrow's file systems spell it."""
    scheme, colon, rest = path.partition(":")
    if scheme in ("s3a", "s3n") and colon:
        return f"s3:{rest}"
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _flat(ids: np.ndarray, width: int) -> bytes:
    """The ids as they stand in a file."""
    if len(ids) and int(ids.max()) >> 8 * width:
        raise ValueError(f"id {int(ids.max())} doesn't fit in {width} bytes")
    return ids.astype(f"<u{width}").tobytes()


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, separator: int = END_OF_TEXT_ID, width: int = WIDTH) -> DataFrame:
    """Write one flat file per task below a shared folder; gives (file, n_bytes, ordinal, doc_id), one row per document.

    A file belongs to one attempt of a task. Only rows of attempts that Spark commits are in the
    returned frame once it is stored, so files of failed or doubled attempts are never read.
    """
    make_folder(docs.sparkSession, folder)
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(folder)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.tok"
        end = _flat(np.array([separator]), width)
        ordinal = 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for batch in batches:
                ids = batch.column(0)
                for text in batch.column(1):
                    out.write(_flat(token_ids(text.as_py(), vocabulary, special_as_text=True), width))
                    out.write(end)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(np.arange(ordinal, ordinal + n)), ids],
                    names=["file", "ordinal", "doc_id"],
                )
                ordinal += n

    return id_and_text(docs).mapInArrow(run, "file string, ordinal long, doc_id long")


def token_files(spark: SparkSession, folder: str, pattern: str = "*.tok") -> DataFrame:
    """Names and sizes of the token files of a folder; their content is not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"))
    )


def find_separators(files: DataFrame, folder: str, separator: int = END_OF_TEXT_ID, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per block of each file: its first id's position, its number of ids, positions of separators in the file."""
    folder = _uri(folder)
    blocks = files.filter("n_bytes > 0").select(
        "file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block_bytes).cast("long"))).alias("block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _at(folder)
        for batch in batches:
            for name, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % width:
                    raise ValueError(f"{name} has {size} bytes, no multiple of {width}")
                start = block * block_bytes
                with system.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - start), start), f"<u{width}")
                ends = np.flatnonzero(ids == separator) + start // width
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x]) for x in (name, block, start // width, len(ids))] + [pa.array([ends], pa.list_(pa.int64()))],
                    names=["file", "block", "first", "n_ids", "ends"],
                )

    spread = blocks.repartition(max(2, blocks.sparkSession.sparkContext.defaultParallelism), "file", "block")
    return spread.mapInArrow(run, "file string, block long, first long, n_ids long, ends array<long>")


def stitch(found: DataFrame) -> DataFrame:
    """Documents from block findings: file, ordinal, start, n_tokens, ended."""
    group = F.floor(F.col("block") / GROUP_BLOCKS)
    summaries = found.select(
        "file", "block", group.alias("group"), F.size("ends").cast("long").alias("n_ends"),
        F.try_element_at("ends", F.lit(-1)).alias("last_end"), (F.col("first") + F.col("n_ids")).alias("stop"),
    )
    groups = summaries.groupBy("file", "group").agg(F.sum("n_ends").alias("n_ends"), F.max("last_end").alias("last_end"))
    earlier = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select(
        "file", "group", F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("group_ends"), F.max("last_end").over(earlier).alias("group_last")
    )
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        summaries.withColumn("inner_ends", F.coalesce(F.sum("n_ends").over(inside), F.lit(0)))
        .withColumn("inner_last", F.max("last_end").over(inside))
        .join(bases, ["file", "group"])
        .select(
            "file", "block", (F.col("group_ends") + F.col("inner_ends")).alias("ordinal"),
            (F.coalesce(F.col("inner_last"), F.col("group_last"), F.lit(-1)) + 1).alias("open_at"),
        )
    )
    ended = (
        found.select("file", "block", "ends").join(carried, ["file", "block"])
        .select("file", "ordinal", "open_at", F.col("ends"), F.posexplode("ends").alias("k", "stop"))
        .select(
            "file", (F.col("ordinal") + F.col("k")).alias("ordinal"),
            F.when(F.col("k") == 0, F.col("open_at")).otherwise(F.expr("try_element_at(ends, k)") + 1).alias("start"), "stop",
            F.lit(True).alias("ended"),
        )
    )
    tails = summaries.groupBy("file").agg(
        F.sum("n_ends").alias("ordinal"), (F.coalesce(F.max("last_end"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop")
    )
    tails = tails.filter("stop > start").withColumn("ended", F.lit(False))
    return ended.unionByName(tails).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the documents as flat token files, scan those, and give doc_id and n_tokens for every document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    order, _ = stored(write_token_files(docs, folder, vocabulary), "token-order")
    committed = order.select("file").distinct()
    files = token_files(spark, folder).join(committed, "file", "left_semi")
    found, _ = stored(find_separators(files, folder, block_bytes=block_bytes), "separators")
    return stitch(found).filter("ended").join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")

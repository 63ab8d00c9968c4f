"""Packing of documents into sequences of a fixed length, shortest pack first over the length histogram.

A document's ids, with an end id, are cut into full pieces and one rest. Only the histogram of piece
lengths, at most ``limit`` numbers, reaches the driver: lengths are placed longest first, each into the
pattern with the most free room, and only counts of patterns change. Pieces then find their place by
their rank among pieces of the same length: a rank within a block of the stored table plus the block's
prefix count, so no group of equal lengths meets in one task.

Defined cases: a null or empty text is a document of the end id alone; repeated rows and ids are packed
each on its own; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenurekit.llm.common import id_and_text, stored
from tenurekit.llm.tokens import VOCABULARY, token_ids

LIMIT = 1024
END_ID = 0
Pattern = tuple[tuple[int, ...], int]

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("block", pa.int64()),
        ("local_rank", pa.int64()),
    ]
)
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long, local_rank long"


def shortest_pack_first(histogram: dict[int, int], limit: int = LIMIT) -> list[Pattern]:
    """Patterns of lengths, each with the number of sequences of that pattern.

    ``open_at[r]`` holds patterns with ``r`` free ids. Lengths come longest first. A length goes to the open
    patterns in rounds, emptiest first, as long as one has room for it: in a round each sequence takes one
    piece, or as many as there are to each if that is more. New sequences open only for what is left then.
    """
    open_at: dict[int, list[Pattern]] = defaultdict(list)
    closed: list[Pattern] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and (rooms := sorted((r for r in open_at if r >= length and open_at[r]), reverse=True)):
            each = max(1, left // sum(count for r in rooms for _, count in open_at[r]))
            grown: list[tuple[int, Pattern]] = []
            for room in rooms:
                while left and open_at[room]:
                    items, count = open_at[room].pop()
                    times = min(each, room // length, left)
                    used = min(left // times, count)
                    if count > used:
                        open_at[room].append((items, count - used))
                    left -= used * times
                    grown.append((room - length * times, (items + (length,) * times, used)))
            for room, pattern in grown:
                (open_at[room] if room else closed).append(pattern)
        if left:
            per = max(1, min(limit // length, left))
            full, rest = divmod(left, per)
            for times, count in ((per, full), (rest, 1)):
                if times and count:
                    room = limit - length * times
                    (open_at[room] if room else closed).append(((length,) * times, count))
    return closed + [p for patterns in open_at.values() for p in patterns]


def _cut(ids: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    raw = ids.astype("<u4").tobytes()
    for start in range(0, len(ids), limit):
        part = raw[4 * start : 4 * (start + limit)]
        yield start, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, each with a block of the task's stream and its rank there among equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            rows: list[tuple] = []
            seen: dict[int, int] = defaultdict(int)
            block = part << 32 | number
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py(), vocabulary), np.uint32(end_id))
                for start, length, crc in _cut(ids, limit):
                    rows.append((doc_id, start, length, crc, len(ids), block, seen[length]))
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, schema=_PIECES)

    return id_and_text(docs).mapInArrow(run, _PIECES_SQL)


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a key (length, rank): first key of each slot, its first sequence, its offset in a sequence."""
    used: dict[int, int] = defaultdict(int)
    slots: list[tuple[int, int, int]] = []
    sequence = 0
    for items, count in patterns:
        offset = 0
        for length in items:
            slots.append((length << 48 | used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 3)
    return columns[:, 0].copy(), columns[:, 1].copy(), columns[:, 2].copy()


def pack(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: where it comes from in its document and where it lies in which sequence."""
    cut, _ = stored(pieces(docs, limit, vocabulary, end_id), "pieces")
    counts = cut.groupBy("length", "block").agg((F.max("local_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, sequences, offsets = _places(shortest_pack_first(histogram, limit))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("length").to_numpy() << 48 | batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, key, side="right") - 1
            sequence = sequences[slot] + (key - keys[slot])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offsets[slot])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = cut.join(bases, ["length", "block"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local_rank")).alias("rank")
    )
    return ranked.mapInArrow(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )

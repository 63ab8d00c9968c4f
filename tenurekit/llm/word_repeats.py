"""Removal of repeated word passages by prefix-partitioned suffix trees.

A suffix starts at each word that has a whole window of words before its document's end. Suffixes are
split by prefixes of variable length: by their first word, where that leaves too many by their first two
words, and where even those are too many by their whole first window. Neighbouring small prefixes share a
group, so every group holds about as many suffixes as one task keeps in memory. Prefixes are written as
letters of hashes (one of 256 for the first word, one for the first two, then the window's hash), so a
suffix has a code, equal prefixes are equal leading letters, and the order of codes is that of a tree.

A group's subtree is its sorted codes; two neighbours meet at the depth to which their letters agree.
Internal nodes a window deep or more are the repeats: a longer maximal repeat is a chain of windows that
each repeat, so the nodes at exactly that depth cover all its words. Each node is answered with the
smallest document among its leaves.

Documents are ordered by id and cut into blocks first, each written once, so that a block's order stands for
its documents'. A block sends each of its different suffixes once, as differences of sorted codes: a
passage copied millions of times is one leaf per block. It gets back one bit for each, whether an earlier
block's document has it too; among its own documents it compares ids itself. Blocks are stored in
buckets by their number, so the bits are joined to them without moving text.

Defined cases: null and empty texts have no words; documents shorter than the window lose nothing; rows
that share an id repeat nothing of each other, whatever their texts; rows without an id come after all
with one and share that place; matches never cross documents; very long documents make blocks of their
own; an empty table gives no rows; further columns are not read. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.common import drop, id_and_text, mixed, stored, text_slices
from tenurekit.llm.words import word_hashes
from tenurekit.session import scratch_path

WINDOW = 13
#: Text bytes of a block, and suffixes of a group.
BLOCK_BYTES = 4 << 20
GROUP_SUFFIXES = 500_000
#: Words are runs without ASCII white space, otherwise unchanged.
_WORDS = bytes(32 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTERS = 1 << 8


# --- blocks


def cut_blocks(rows: Iterator[tuple[int | None, bytes]], most: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Blocks of rows in the order of their ids.

    Blocks hold ids that no other block holds, or rows of one id alone: the first and last id of a task may
    go on in another task, and an id with very many rows fills blocks of its own.
    """
    whole: list[tuple[int | None, bytes]] = []
    run: list[tuple[int | None, bytes]] = []
    size = run_size = 0
    alone = True
    for row in rows:
        if run and row[0] != run[0][0]:
            if alone:
                yield run
            else:
                whole += run
                size += run_size
            if size >= most:
                yield whole
                whole, size = [], 0
            run, run_size, alone = [], 0, False
        elif run_size >= most:
            if whole:
                yield whole
                whole, size = [], 0
            yield run
            run, run_size, alone = [], 0, True
        run.append(row)
        run_size += len(row[1])
    if whole:
        yield whole
    if run:
        yield run


def _prefix_letters(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two letters of each suffix: of its first word, and of its first two words."""
    one = hashes[starts]
    two = mixed(one * _BASE + hashes[starts + 1]) if len(hashes) > 1 else one
    return (one >> np.uint64(56)) << np.uint64(8) | two >> np.uint64(56)


def _window_starts(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a suffix starts, and their documents."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = max(len(doc) - window + 1, 0)
    starts = np.flatnonzero(doc[:n] == doc[len(doc) - n :])
    return starts, doc[starts]


def text_blocks(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_ids, texts, and how many suffixes start with each pair of prefix letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (row for batch, texts in text_slices(batches) for row in zip(batch.column(0).to_pylist(), texts, strict=True))
        for number, block in enumerate(cut_blocks(rows, block_bytes)):
            ids, texts = (list(x) for x in zip(*block, strict=True))
            hashes, counts = word_hashes(texts, _WORDS)
            starts, _ = _window_starts(counts, window)
            letters = _prefix_letters(hashes, starts).astype(np.int64) if len(starts) else starts
            tally = np.bincount(letters, minlength=_LETTERS**2).astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([texts], pa.list_(pa.binary())),
                    pa.array([tally.tobytes()], pa.binary()),
                ],
                names=["block", "doc_ids", "texts", "prefixes"],
            )

    order = F.col("doc_id").asc_nulls_last()
    ordered = id_and_text(docs).repartitionByRange(order, F.xxhash64("text")).sortWithinPartitions(order)
    return ordered.mapInArrow(run, "block long, doc_ids array<long>, texts array<binary>, prefixes binary")


def _in_buckets(blocks: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """The blocks as a table in buckets by their number, and what removes it."""
    spark = blocks.sparkSession
    name, path = f"text_blocks_{uuid.uuid4().hex}", scratch_path(spark, "text-blocks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)

    def remove() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(spark, path)

    return spark.table(name), remove


# --- groups of suffixes


def prefix_counts(blocks: DataFrame) -> np.ndarray:
    """How many suffixes of the corpus start with each pair of prefix letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS**2, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.frombuffer(blob.as_py(), "<u4")
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["prefix", "n"])

    # One row per pair of letters, whatever the corpus.
    found = blocks.select("prefixes").mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_LETTERS**2, np.int64)
    out[found["prefix"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(counts: np.ndarray, most: int) -> Iterator[tuple[int, float]]:
    """Prefixes of variable length by first code and number of suffixes."""
    for first in range(_LETTERS):
        own = counts[first * _LETTERS : (first + 1) * _LETTERS]
        if own.sum() <= most:
            yield first << 56, float(own.sum())
            continue
        for second, n in enumerate(own.tolist()):
            pieces = max(1, -(-n // most))
            for k in range(pieces):
                yield first << 56 | second << 48 | (k << 48) // pieces, n / pieces


def group_edges(counts: np.ndarray, most: int = GROUP_SUFFIXES) -> np.ndarray:
    """First code of each group; small neighbouring prefixes go together."""
    edges, held = [0], 0.0
    for code, n in _prefixes(counts, most):
        if held and held + n > most:
            edges.append(code)
            held = 0.0
        held += n
    return np.array(edges, np.uint64)


class Suffixes:
    """The different suffixes of one block's documents in the order of their codes."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        hashes, self.counts = word_hashes(texts, _WORDS)
        self.starts, self.docs = _window_starts(self.counts, window)
        whole = np.zeros(max(len(hashes) - window + 1, 0), np.uint64)
        for k in range(window):
            whole = whole * _BASE + hashes[k : len(whole) + k]
        whole = mixed(whole[self.starts])
        letters = _prefix_letters(hashes, self.starts) if len(self.starts) else whole
        codes, tails = letters << np.uint64(48) | whole >> np.uint64(16), whole.astype(np.uint16)
        self.order, self.first = deep_nodes(codes, tails)
        leaf = self.order[self.first]
        self.codes, self.tails = codes[leaf], tails[leaf]


def deep_nodes(codes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and where in it each node of window depth begins: neighbours that agree in all letters."""
    order = np.argsort(codes, kind="stable")
    c, t = codes[order], tails[order]
    same = c[1:] == c[:-1]
    if (t[1:] != t[:-1])[same].any():
        order = np.lexsort((tails, codes))
        c, t = codes[order], tails[order]
        same = c[1:] == c[:-1]
    new = np.ones(len(order), bool)
    new[1:] = ~(same & (t[1:] == t[:-1]))
    return order, np.flatnonzero(new)


def _packed(codes: np.ndarray) -> bytes:
    """Differences of sorted codes, byte by byte of all, so that the high ones are mostly zeros."""
    steps = np.diff(codes, prepend=np.uint64(0))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _leaves(blocks: DataFrame, edges: np.ndarray, window: int) -> DataFrame:
    """Each block's suffixes by group: group, block, order_id (the block's first id), codes, tails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = Suffixes(row["texts"], window)
                ends = np.append(np.searchsorted(found.codes, edges[1:]), len(found.codes))
                begins = np.append(0, ends[:-1])
                held = np.flatnonzero(ends > begins).tolist()
                cuts = [slice(begins[g], ends[g]) for g in held]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held, pa.int32()),
                        pa.array([row["block"]] * len(held), pa.int64()),
                        pa.array([row["doc_ids"][0]] * len(held), pa.int64()),
                        pa.array([_packed(found.codes[c]) for c in cuts], pa.binary()),
                        pa.array([found.tails[c].astype("<u2").tobytes() for c in cuts], pa.binary()),
                    ],
                    names=["group", "block", "order_id", "codes", "tails"],
                )

    return blocks.select("block", "doc_ids", "texts").mapInArrow(run, "group int, block long, order_id long, codes binary, tails binary")


def _answered(leaves: pa.Table) -> pa.Table:
    """For a group's subtree: per block one bit a suffix, whether an earlier block's documents have it."""
    ids = leaves["order_id"].to_pylist()
    place = {x: k for k, x in enumerate(sorted(set(ids), key=lambda x: (x is None, x or 0)))}
    codes = [_unpacked(x) for x in leaves["codes"].to_pylist()]
    sizes = [len(c) for c in codes]
    every = np.concatenate(codes)
    tails = np.concatenate([np.frombuffer(x, "<u2") for x in leaves["tails"].to_pylist()])
    owner = np.repeat([place[x] for x in ids], sizes)
    order, first = deep_nodes(every, tails)
    least = np.minimum.reduceat(owner[order], first)
    earlier = np.empty(len(order), bool)
    earlier[order] = owner[order] > np.repeat(least, np.diff(np.append(first, len(order))))
    bits = [np.packbits(x).tobytes() for x in np.split(earlier, np.cumsum(sizes)[:-1])]
    return pa.table({"group": leaves["group"], "block": leaves["block"], "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})


# --- removal


def _covered(found: Suffixes, ids: list, earlier: np.ndarray, window: int) -> np.ndarray:
    """Per word of a block whether a window over it also starts in a document with a smaller id."""
    place = {x: k for k, x in enumerate(sorted(set(ids), key=lambda x: (x is None, x or 0)))}
    rank = np.array([place[x] for x in ids], np.int64)[found.docs[found.order]]
    n_words = int(found.counts.sum())
    if not len(rank):
        return np.zeros(n_words, bool)
    sizes = np.diff(np.append(found.first, len(found.order)))
    hit = np.repeat(earlier, sizes) | (rank > np.repeat(np.minimum.reduceat(rank, found.first), sizes))
    starts = found.starts[found.order[hit]]
    edges = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + window, minlength=n_words + 1)
    return np.cumsum(edges[:n_words]) > 0


def deduplicated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most: int = GROUP_SUFFIXES) -> tuple[DataFrame, Callable[[], None]]:
    """doc_id, n_words, n_removed and the kept words as text; and what removes the scratch tables once that is read."""
    spark = docs.sparkSession
    blocks, remove = _in_buckets(text_blocks(docs, window, block_bytes))
    edges = group_edges(prefix_counts(blocks), most)
    shape = "group int, block long, n long, bits binary"
    answers = _leaves(blocks, edges, window).groupBy("group").applyInArrow(_answered, shape)
    answers, path = stored(answers, "suffix-answers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = Suffixes(row["texts"], window)
                bits = [np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: x["n"]] for x in row["answers"] or []]
                earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
                covered = _covered(found, row["doc_ids"], earlier, window)
                ends = np.cumsum(found.counts)
                for k, j in _output_slices(row["texts"]):
                    kept, removed = [], []
                    for d in range(k, j):
                        drop_word = covered[ends[d] - found.counts[d] : ends[d]]
                        kept.append(b" ".join(compress(row["texts"][d].split(), (~drop_word).tolist())))
                        removed.append(int(drop_word.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["doc_ids"][k:j], pa.int64()),
                            pa.array(found.counts[k:j], pa.int64()),
                            pa.array(removed, pa.int64()),
                            pa.array(kept, pa.binary()).cast(pa.string()),
                        ],
                        names=["doc_id", "n_words", "n_removed", "text"],
                    )

    by_block = answers.groupBy(F.col("block").alias("of_block")).agg(F.sort_array(F.collect_list(F.struct("group", "n", "bits"))).alias("answers"))
    joined = blocks.select("block", "doc_ids", "texts").join(by_block, F.col("block") == F.col("of_block"), "left")
    kept = joined.select("doc_ids", "texts", "answers").mapInArrow(run, "doc_id long, n_words long, n_removed long, text string")

    def clear() -> None:
        remove()
        drop(spark, path)

    return kept, clear


def _output_slices(texts: list[bytes], rows: int = 1000) -> Iterator[tuple[int, int]]:
    return ((k, min(k + rows, len(texts))) for k in range(0, len(texts), rows))


def remove_repeated_words(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space between them) for every document."""
    kept, clear = deduplicated(docs, window, block_bytes, most)
    out, _ = stored(kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")), "word-repeats")
    clear()
    return out

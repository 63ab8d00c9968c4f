"""Exact removal of repeated byte strings by a logarithmic family of sampled suffix arrays.

Every string of ``length`` bytes has a sampled suffix: the one that starts where the string's smallest
gram hash lies. Equal strings have equal samples at equal offsets, so suffixes elsewhere needn't be kept;
about one in eighty is. A suffix array holds the names of the sampled suffixes of a batch, fingerprints
of their first ``GRAM`` bytes, in order and with counts. A new batch's array is merge-scanned against
each level of the family for names that both hold; then equal-sized levels merge, so every name is
rewritten a logarithmic number of times.

Matched suffixes are extended to long matches. Strings around one sample are told apart by a fingerprint
of all their bytes: equal ones are repeated as a whole. Those that equal no other in full, at the ends of
copies, are compared string by string with all of the same name. The strings of a name of very many such
places are first told apart by blocks of neighbouring starts: those that share no bytes common to a block
with another place can't be repeated. What is left of such a name is compared by the strings' fingerprints.

Defined cases: null is empty; texts shorter than ``length`` lose nothing; overlaps and repeats inside one
document count; repeated rows, with their id or not, repeat each other's strings and lose them all; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.common import as_long, drop, mixed, stored, text_slices
from tenurekit.llm.words import prefix_hashes, substring_hash

LENGTH = 200
GRAM = 32
BATCHES = 4
#: Window starts worked on at once; the most places of one name that are compared in one task.
SEGMENT = 1 << 20
GROUP = 2048
_PLACE = np.uint64((1 << 22) - 1)
#: Rows of a level below this count as the smallest size class.
LEVEL_ROWS = 1 << 16


def sampled_runs(raw: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one sample: (start, number of further starts, offset of the sample, name, fingerprint).

    ``firsts`` and ``lasts`` bound the starts of strings that lie inside one document.
    """
    span = length - GRAM + 1
    parts: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        piece = raw[at : at + SEGMENT + length - 1]
        sums = prefix_hashes(piece)
        places = np.arange(len(piece) - GRAM + 1)
        names = substring_hash(sums, places, places + GRAM)
        least = (names & ~_PLACE) | places.astype(np.uint64)
        size = 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < span:
            least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
        sample = (least & _PLACE).astype(np.int64)
        inside = np.zeros(len(sample) + 1, np.int8)
        here = (lasts > at) & (firsts < at + len(sample))
        np.add.at(inside, np.maximum(firsts[here] - at, 0), 1)
        np.add.at(inside, np.minimum(lasts[here] - at, len(sample)), -1)
        starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(starts):
            continue
        own = sample[starts]
        edge = np.isin(starts, np.maximum(firsts[here] - at, 0))
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)) | edge)
        low, high = starts[new], np.append(starts[new[1:] - 1], starts[-1])
        parts.append((low + at, high - low, own[new] - low, names[own[new]], substring_hash(sums, low, high + length)))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a key of both that survives a second reading."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.withColumn("doc_key", F.xxhash64("doc_id", "text"))


def suffixes(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """Sampled suffixes of keyed documents: batch, doc_key, name, place (start, sample offset, further starts), print."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(stream, most=SEGMENT):
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            firsts = ends - sizes
            low, more, offset, names, prints = sampled_runs(np.frombuffer(b"".join(texts), np.uint8), firsts[sizes >= length], (ends - length + 1)[sizes >= length], length)
            doc = np.searchsorted(ends, low, side="right")
            keys = batch.column(0).to_numpy()[doc] if len(doc) else np.zeros(0, np.int64)
            place = (low - firsts[doc]) << 20 | offset << 10 | more
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys % batches).astype(np.int32)), pa.array(keys), pa.array(as_long(names)), pa.array(place), pa.array(as_long(prints))],
                names=["batch", "doc_key", "name", "place", "print"],
            )

    return docs.select("doc_key", "text").mapInArrow(run, "batch int, doc_key long, name long, place long, print long")


class SuffixIndex:
    """Levels of sorted suffix names; a level's size class is the power of two its row count reaches."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame, str]] = []

    @staticmethod
    def _sorted(names: DataFrame) -> tuple[int, DataFrame, str]:
        frame, path = stored(names.sortWithinPartitions("name"), "suffix-level")
        return max(LEVEL_ROWS, frame.count()).bit_length(), frame, path

    def add(self, names: DataFrame) -> DataFrame:
        """Take a batch's names in; gives those that it holds twice or that a level holds too."""
        spark = names.sparkSession
        array, path = stored(names.groupBy("name").agg(F.count("*").alias("n")).sortWithinPartitions("name"), "suffix-array")
        found = array.filter("n > 1").select("name")
        for _, level, _ in self.levels:
            found = found.unionByName(array.select("name").join(level.select("name").hint("merge"), "name"))
        matched, _ = stored(found.distinct(), "matched-names")
        self.levels.append((max(LEVEL_ROWS, array.count()).bit_length(), array.select("name"), path))
        while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
            (_, one, one_path), (_, other, other_path) = self.levels.pop(), self.levels.pop()
            self.levels.append(self._sorted(one.unionByName(other).distinct()))
            drop(spark, one_path, other_path)
        return matched

    def close(self, spark) -> None:
        drop(spark, *(path for _, _, path in self.levels))
        self.levels = []


def _contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Bytes around each place: (name, doc_key, place, whole, bytes)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            texts = batch.column(0).cast(pa.binary())
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                rows = batch.column(1)[i].as_py()
                cut = [raw[r["place"] >> 20 : (r["place"] >> 20) + (r["place"] & 1023) + length] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["name"] for r in rows], pa.int64()),
                        pa.array([batch.column(2)[i].as_py()] * len(rows), pa.int64()),
                        pa.array([r["place"] for r in rows], pa.int64()),
                        pa.array([r["whole"] for r in rows], pa.bool_()),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["name", "doc_key", "place", "whole", "bytes"],
                )

    lists = places.groupBy("doc_key").agg(F.collect_set(F.struct("name", "place", "whole")).alias("rows"))
    shape = "name long, doc_key long, place long, whole boolean, bytes binary"
    return docs.select("text", "doc_key").join(lists.hint("merge"), "doc_key").select("text", "rows", "doc_key").mapInArrow(run, shape)


def _group_findings(rows: list[dict], length: int) -> Iterator[tuple[int, int, int]]:
    """(doc_key, first start, last start) of repeated strings."""
    prints: list[np.ndarray] = []
    for r in rows:
        raw = np.frombuffer(r["bytes"], np.uint8)
        more, offset = r["place"] & 1023, r["place"] >> 10 & 1023
        at = np.arange(more + 1)
        prints.append(mixed(substring_hash(prefix_hashes(raw), at, at + length) + (offset - at).astype(np.uint64)))
    _, back, count = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    repeated = count[back] > 1
    stops = np.cumsum([len(p) for p in prints])
    for r, own, stop in zip(rows, prints, stops.tolist(), strict=True):
        base = r["place"] >> 20
        hit = np.flatnonzero(repeated[stop - len(own) : stop])
        if len(hit) and not r["whole"]:
            yield r["doc_key"], base + int(hit[0]), base + int(hit[-1])


def _findings(contexts: DataFrame, length: int) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(rows: list[dict]) -> pa.RecordBatch:
            columns = list(zip(*_group_findings(rows, length), strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_key", "first", "last"])

        waiting: list[dict] = []
        for batch in stream:
            for at in range(0, batch.num_rows, 512):
                for row in batch.slice(at, 512).to_pylist():
                    if waiting and row["name"] != waiting[0]["name"]:
                        yield give(waiting)
                        waiting = []
                    waiting.append(row)
        if waiting:
            yield give(waiting)

    return contexts.repartition("name").sortWithinPartitions("name").mapInArrow(run, "doc_key long, first long, last long")


def _cut(contexts: DataFrame, length: int, step: int) -> DataFrame:
    """Places cut where their strings' sample offsets pass a multiple of ``step``: (doc_key, root, name, place, print).

    The name is a fingerprint of the bytes that all strings of such a block of offsets have in common, so equal
    strings have equal names; with a step of 1, of the string itself.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                out: list[tuple[np.ndarray, ...]] = []
                for r in part.to_pylist():
                    sums = prefix_hashes(np.frombuffer(r["bytes"], np.uint8))
                    start, more, offset = r["place"] >> 20, r["place"] & 1023, r["place"] >> 10 & 1023
                    at = np.arange(more + 1)
                    block = (offset - at) // step
                    low = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                    high = np.append(low[1:] - 1, more)
                    skip = start - (r["root"] >> 20)
                    common = skip + offset - block[low] * step
                    names = mixed(substring_hash(sums, common, common + length - step + 1) + block[low].astype(np.uint64))
                    prints = substring_hash(sums, skip + low, skip + high + length)
                    places = (start + low) << 20 | (offset - low) << 10 | (high - low)
                    same = [np.full(len(low), r[c], np.int64) for c in ("doc_key", "root")]
                    out.append((*same, as_long(names), places, as_long(prints)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc_key", "root", "name", "place", "print"])

    return contexts.select("doc_key", "root", "place", "bytes").mapInArrow(run, "doc_key long, root long, name long, place long, print long")


def _classes(suspects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of places that equal another as a whole, and the places of which only strings can be repeated.

    Those are places that equal no other as a whole, with one of each that does, where they share a name:
    (name, whole, size, doc_key, place and further columns), with the number of such places of the name.
    """
    shape = F.col("place").bitwiseAND(F.lit((1 << 20) - 1)).alias("shape")
    rest = [c for c in suspects.columns if c not in ("name", "print")]
    around, _ = stored(suspects.groupBy("name", shape, "print").agg(F.count("*").alias("n"), F.min(F.struct(*rest)).alias("one")), "contexts")
    alike = around.filter("n > 1").select("name", "shape", "print").hint("merge")
    whole = suspects.withColumn("shape", shape).join(alike, ["name", "shape", "print"], "left_semi")
    start, more = F.shiftright("place", 20), F.col("place").bitwiseAND(F.lit(1023))
    spans = whole.select("doc_key", start.alias("first"), (start + more).alias("last")).distinct()
    sizes = around.groupBy("name").agg(F.count("*").alias("size"), F.min("n").alias("least")).filter("size > 1 AND least = 1")
    places = around.join(sizes.select("name", "size").hint("merge"), "name").select("name", (F.col("n") > 1).alias("whole"), "size", "one.*")
    return spans, places


def _narrowed(docs: DataFrame, places: DataFrame, length: int) -> list[DataFrame]:
    """Spans of repeated strings at the places of names of very many, without a task that holds all places of a name."""
    around, path = stored(_contexts(docs, places, length), "bytes-around")
    roots = around.select("doc_key", F.col("place").alias("root"), "bytes")
    step = math.isqrt(length - GRAM) + 1
    blocks, _ = stored(_cut(roots.withColumn("place", F.col("root")), length, step), "string-blocks")
    spans, left = _classes(blocks)
    strings, _ = stored(_cut(roots.join(left.select("doc_key", "root", "place").hint("merge"), ["doc_key", "root"]), length, 1), "strings")
    drop(docs.sparkSession, path)
    return [spans, _classes(strings)[0]]


def repeated_spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """doc_key, start, end of stretches that repeated strings cover, in bytes; they may overlap."""
    spark = docs.sparkSession
    every, every_path = stored(suffixes(docs, length, batches), "suffixes", ("batch",))
    index, matched = SuffixIndex(), None
    for b in range(batches):
        found = index.add(every.filter(F.col("batch") == b).select("name"))
        matched = found if matched is None else matched.unionByName(found)
    index.close(spark)
    # Stored first, so that the side with the hot names can be split. Tables of names and prints grow with
    # the corpus, so none of these joins may turn into a broadcast.
    matched, _ = stored(matched.distinct(), "matched")
    suspects, _ = stored(every.join(matched.hint("merge"), "name", "left_semi").select("doc_key", "name", "place", "print"), "suspects")
    drop(spark, every_path)

    spans, places = _classes(suspects)
    dealt, _ = stored(places.select("name", "whole", "doc_key", "place", (F.col("size") > group).alias("many")), "open-places", ("many",))
    found, _ = stored(_findings(_contexts(docs, dealt.filter("NOT many"), length), length), "findings")
    parts = [spans, found]
    many = dealt.filter("many")
    if not many.isEmpty():
        parts += _narrowed(docs, many, length)
    union = functools.reduce(DataFrame.unionByName, parts)
    return union.select("doc_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            texts = batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                raw, flat = texts[i].as_py(), batch.column(2)[i].as_py() or []
                spans = merged([(x["start"], x["end"]) for x in flat])
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(raw[at:start])
                    at = end
                kept.update(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    keyed = _keyed(docs)
    spans, _ = stored(repeated_spans(keyed, length, batches, group), "repeated-spans")
    lists = spans.distinct().groupBy("doc_key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return keyed.join(lists.hint("merge"), "doc_key", "left").select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )

"""Benchmark decontamination by a distributed positional inverted index.

The index is cut by documents: each block holds some documents' postings, sorted by term, with word
positions over the whole block. Blocks are built and searched where they lie; no posting is shuffled.
A search takes each phrase's rarest term in the whole corpus, turns that term's positions into phrase
starts, and keeps those that the offset-adjusted lists of the other terms hold too, rarer ones first.
Phrases come to the tasks in chunks of bounded size, and what chunks find is joined by document.

Defined cases: null and empty texts have no words and are never contaminated; items with a null id or
without words have no windows; repeated items count once; repeated documents and ids are judged each on
its own; matches never cross documents; empty tables give no hits or no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tenurekit.llm.common import id_and_text, stored, text_slices
from tenurekit.llm.words import ALPHANUMERIC, word_hashes

WINDOW = 13
#: Text bytes of an index block, and of benchmark items in one chunk of phrases.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 2 << 20
#: A document is contaminated from this share of hit words on: one word in so many.
SHARE = 20

_INDEX = "block long, doc_ids array<long>, n_words array<long>, terms binary, firsts binary, positions binary"


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Index blocks: ids and word counts of documents; terms, first posting of each, positions by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(text_slices(batches, most=block_bytes)):
            hashes, counts = word_hashes(texts, ALPHANUMERIC)
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            firsts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number]),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                    *(pa.array([x.tobytes()], pa.binary()) for x in (ranked[firsts], firsts.astype("<u4"), order.astype("<u4"))),
                ],
                names=["block", "doc_ids", "n_words", "terms", "firsts", "positions"],
            )

    return id_and_text(docs).mapInArrow(run, _INDEX)


def indexed_documents(index: DataFrame) -> DataFrame:
    """block, row, doc_id, n_words of every document."""
    both = F.arrays_zip("doc_ids", "n_words")
    return index.select("block", F.posexplode(both).alias("row", "d")).select("block", "row", "d.doc_ids", "d.n_words").withColumnRenamed("doc_ids", "doc_id")


class _Block:
    """Postings of one block in memory."""

    def __init__(self, row: dict) -> None:
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.firsts = np.frombuffer(row["firsts"], "<u4").astype(np.int64)
        self.positions = np.frombuffer(row["positions"], "<u4")
        self.stops = np.append(self.firsts[1:], len(self.positions))
        self.ends = np.cumsum(np.array(row["n_words"], np.int64))

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Where each term's postings are, -1 if it doesn't occur."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def postings(self, slot: int) -> np.ndarray:
        return self.positions[self.firsts[slot] : self.stops[slot]].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")


def _held(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


class Phrases:
    """Windows of word sequences: distinct terms, the sequences as term numbers, window starts and lengths."""

    def __init__(self, ids: list[int], sequences: list[np.ndarray], window: int) -> None:
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.terms, self.sequence = np.unique(np.concatenate(sequences) if sequences else np.zeros(0, np.uint64), return_inverse=True)
        first = np.cumsum(lengths) - lengths
        starts, sizes, owners = [], [], []
        for i, (at, n) in enumerate(zip(first.tolist(), lengths.tolist(), strict=True)):
            size = min(window, n)
            here = np.arange(at, at + n - size + 1) if n else np.zeros(0, np.int64)
            starts.append(here)
            sizes.append(np.full(len(here), size))
            owners.append(np.full(len(here), ids[i]))
        self.starts, self.sizes, self.owners = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, sizes, owners))

    def find(self, block: _Block, frequency: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(window, its starts in the block) of each window that occurs; rarest term first."""
        slots = block.slots(self.terms)
        missing = np.append(0, np.cumsum(slots[self.sequence] < 0))
        possible = np.flatnonzero(missing[self.starts + self.sizes] == missing[self.starts])
        for w in possible.tolist():
            terms = self.sequence[self.starts[w] : self.starts[w] + self.sizes[w]]
            order = np.argsort(frequency[terms], kind="stable")
            at = block.postings(slots[terms[order[0]]]) - order[0]
            for k in order[1:]:
                if not len(at):
                    break
                at = at[_held(block.postings(slots[terms[k]]), at + k)]
            at = at[at >= 0]
            at = at[block.document(at) == block.document(at + self.sizes[w] - 1)]
            if len(at):
                yield w, at


def _frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in the corpus: counts of blocks, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, firsts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["firsts"], "<u4").astype(np.int64)
                counts = np.diff(np.append(firsts, row["n"]))
                at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
                here = np.flatnonzero(own[at] == terms) if len(own) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(counts[at[here]])], names=["term", "n"])

    sizes = index.select("terms", "firsts", F.aggregate("n_words", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    found = sizes.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items in chunks of about ``chunk_bytes`` of text: ids and word hashes."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = items.filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        hashes, counts = word_hashes([x.encode() for x in rows["text"].to_pylist()], ALPHANUMERIC)
        yield rows["item_id"].to_pylist(), np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []


def phrase_hits(index: DataFrame, ids: list[int], sequences: list[np.ndarray], window: int = WINDOW) -> DataFrame:
    """Per document with a hit: block, row, spans (start and end of each hit run, by word), item ids."""
    phrases = Phrases(ids, sequences, window)
    frequency = _frequencies(index, phrases.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                spans: dict[int, list[tuple[int, int]]] = {}
                owners: dict[int, set[int]] = {}
                for w, at in phrases.find(block, frequency):
                    for d, start in zip(block.document(at).tolist(), at.tolist(), strict=True):
                        first = int(block.ends[d - 1]) if d else 0
                        spans.setdefault(d, []).append((start - first, start - first + int(phrases.sizes[w])))
                        owners.setdefault(d, set()).add(int(phrases.owners[w]))
                rows = sorted(spans)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(rows), pa.int64()),
                        pa.array(rows, pa.int32()),
                        pa.array([[x for s in _union(spans[d]) for x in s] for d in rows], pa.list_(pa.int64())),
                        pa.array([sorted(owners[d]) for d in rows], pa.list_(pa.int64())),
                    ],
                    names=["block", "row", "spans", "items"],
                )

    return index.drop("doc_ids").mapInArrow(run, "block long, row int, spans array<long>, items array<long>")


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _summarised():
    kind = pa.struct([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])

    @arrow_udf("struct<n_hit: bigint, n_items: bigint, items_sha256: string>")
    def summary(spans: pa.Array, items: pa.Array) -> pa.Array:
        rows = []
        for flat, ids in zip(spans.to_pylist(), items.to_pylist(), strict=True):
            hit = sum(e - s for s, e in _union(list(zip(flat[::2], flat[1::2], strict=True))))
            names = sorted({str(i) for i in ids})
            rows.append({"n_hit": hit, "n_items": len(names), "items_sha256": hashlib.sha256(",".join(names).encode()).hexdigest()})
        return pa.array(rows, kind)

    return summary


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, chunk_bytes: int = CHUNK_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: words, words inside benchmark windows, items with windows in it, and the verdict."""
    index, _ = stored(build_index(docs, block_bytes), "positional-index")
    hits = None
    for ids, sequences in _chunks(benchmark, chunk_bytes):
        here = phrase_hits(index, ids, sequences, window)
        hits = here if hits is None else hits.unionByName(here)
    merged = hits.groupBy("block", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    merged = merged.select("block", "row", _summarised()("spans", "items").alias("s")).select("block", "row", "s.*")
    nothing = hashlib.sha256(b"").hexdigest()
    joined = indexed_documents(index).join(merged, ["block", "row"], "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items_sha256", F.lit(nothing)).alias("items_sha256"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))


def proximity_matches(index: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Documents in which all terms, in any order, lie within so many words: block, row, start of the first place."""
    hashes = np.unique(word_hashes([t.encode() for t in terms], ALPHANUMERIC)[0])
    frequency = _frequencies(index, hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                slots = block.slots(hashes)
                starts = np.zeros(0, np.int64)
                if len(hashes) and (slots >= 0).all():
                    lists = [block.postings(slots[k]) for k in np.argsort(frequency, kind="stable")]
                    starts = np.sort(np.concatenate(lists))
                    for own in lists:
                        at = np.searchsorted(own, starts)
                        near = own[np.minimum(at, len(own) - 1)]
                        good = (at < len(own)) & (near < starts + within)
                        starts = starts[good & (block.document(starts) == block.document(near))]
                where = block.document(starts)
                rows, first = np.unique(where, return_index=True)
                begin = np.append(0, block.ends)[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(rows), pa.int64()), pa.array(rows.astype(np.int32)), pa.array(starts[first] - begin)],
                    names=["block", "row", "start"],
                )

    return index.drop("doc_ids").mapInArrow(run, "block long, row int, start long")

"""Ranked lexical search by presence masks over an inverted index in blocks.

Each index block holds some documents: per term, the documents that hold it and how often. Blocks are
built and searched where they lie; no posting is shuffled. In a block, an item's documents are grouped by
the set of the item's terms that they hold, a mask made by setting one bit per term in all of the term's
documents at once. No document of a mask scores above the sum of its terms' weights times the block's
greatest share of each, so masks are evaluated by descending greatest score, and the block is finished
once enough documents score above all that the rest could reach. Equal bounds are evaluated too, since
equal scores go by id. The best of all blocks are then ranked per item, some blocks together first.

Every term of the corpus is in the index, so one index serves any items; they come to the tasks in chunks
of bounded size. A chunk reads the index again, which costs little beside comparing thousands of items
with every block. Terms are named by 64-bit hashes.

Defined cases: null and empty texts hold no terms, count in no statistic and are never returned; items
without terms, or whose terms occur nowhere, have no rows; items that repeat an id and a text count once,
rows that repeat only the id are ranked apart from each other; repeated documents are ranked each on its
own, those without an id after equal ones with an id; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurekit.llm.common import id_and_text, stored, text_slices
from tenurekit.llm.words import ALPHANUMERIC, word_hashes

TOP = 10
#: Text bytes of an index block, and of items in one chunk.
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 2 << 20
#: Documents evaluated at once, the masks of the highest bounds first.
EVALUATED = 64
#: Groups of blocks whose best are ranked before those of all.
SALTS = 64
#: Stands for a missing id where equal scores are ordered.
_NO_ID = (1 << 63) - 1

_INDEX = "block long, doc_ids array<long>, n_words array<long>, terms binary, firsts binary, docs binary, counts binary"


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Index blocks: ids and lengths of documents; terms in order, and documents and counts of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(text_slices(batches, most=block_bytes)):
            hashes, lengths = word_hashes(texts, ALPHANUMERIC)
            order = np.argsort(hashes, kind="stable")
            term, doc = hashes[order], np.repeat(np.arange(len(texts)), lengths)[order]
            place = _changes(term, doc)
            first = np.flatnonzero(_new(term[place]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number]),
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())),
                    *(
                        pa.array([x.tobytes()], pa.binary())
                        for x in (term[place][first], first.astype("<u4"), doc[place].astype("<u4"), np.diff(np.append(place, len(term))).astype("<u4"))
                    ),
                ],
                names=["block", "doc_ids", "n_words", "terms", "firsts", "docs", "counts"],
            )

    return id_and_text(docs).mapInArrow(run, _INDEX)


def _new(values: np.ndarray) -> np.ndarray:
    return np.append(np.ones(min(len(values), 1), bool), values[1:] != values[:-1])


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    return np.flatnonzero(np.logical_or.reduce([_new(c) for c in columns]))


class _Block:
    """The postings of one block."""

    def __init__(self, row: dict) -> None:
        self.ids = row["doc_ids"]
        self.lengths = np.array(row["n_words"], np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.docs = np.frombuffer(row["docs"], "<u4")
        self.counts = np.frombuffer(row["counts"], "<u4")
        self.firsts = np.append(np.frombuffer(row["firsts"], "<u4").astype(np.int64), len(self.docs))

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Where each term is, -1 if it isn't."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)


class Items:
    """A chunk of items: distinct terms, and per item the numbers of its terms with their repeats."""

    def __init__(self, names: list, sequences: list[np.ndarray]) -> None:
        self.names = names
        self.terms, flat = np.unique(np.concatenate(sequences) if sequences else np.zeros(0, np.uint64), return_inverse=True)
        ends = np.cumsum([len(s) for s in sequences], dtype=np.int64)
        self.of_item = [np.unique(flat[e - len(s) : e], return_counts=True) for s, e in zip(sequences, ends.tolist(), strict=True)]


class _Scorer:
    """Scores of one block's documents for items of a chunk; weights are by term of the chunk."""

    def __init__(self, block: _Block, items: Items, weights: np.ndarray, n_docs: int, n_words: int) -> None:
        self.block, self.items, self.weights = block, items, weights
        self.slots = block.slots(items.terms)
        m = 100 - 75 + (75 * block.lengths * n_docs) // max(n_words, 1)
        self.postings: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.most = np.zeros(len(items.terms), np.int64)
        for t in np.flatnonzero(self.slots >= 0).tolist():
            here = slice(block.firsts[self.slots[t]], block.firsts[self.slots[t] + 1])
            docs, tf = block.docs[here].astype(np.int64), block.counts[here].astype(np.int64)
            self.postings[t] = docs, (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs])
            self.most[t] = self.postings[t][1].max()

    def _masks(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks as rows of 64-bit words; documents with any term, and the mask of each."""
        words = np.zeros((len(self.block.lengths), (len(terms) + 63) // 64), np.uint64)
        for j, t in enumerate(terms):
            words[self.postings[t][0], j // 64] |= np.uint64(1 << j % 64)
        docs = np.flatnonzero(words.any(axis=1))
        words = words[docs]
        group = np.zeros(len(docs), np.int64)
        for k in range(words.shape[1]):
            values, number = np.unique(words[:, k], return_inverse=True)
            _, group = np.unique(group * len(values) + number, return_inverse=True)
        _, example = np.unique(group, return_index=True)
        return words[example], docs, group

    def best(self, item: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the ``top`` best of the block; scores above 0, equal ones by id."""
        terms, repeats = self.items.of_item[item]
        factor = repeats * self.weights[terms]
        use = (self.slots[terms] >= 0) & (factor > 0)
        terms, factor = terms[use], factor[use]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks, docs, group = self._masks(terms.tolist())
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")[:, : len(terms)]
        bound = (bits * (factor * self.most[terms])).sum(axis=1)
        rank = np.empty(len(masks), np.int64)
        ranked = np.argsort(-bound, kind="stable")
        rank[ranked] = np.arange(len(masks))
        by_rank = np.argsort(rank[group], kind="stable")
        docs, group = docs[by_rank], group[by_rank]
        ends = np.cumsum(np.bincount(rank[group], minlength=len(masks)))
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = mask = 0
        while done < len(docs):
            if len(found) >= top and bound[ranked[mask]] < np.partition(scores, len(scores) - top)[len(scores) - top]:
                break
            mask = min(int(np.searchsorted(ends, min(done + EVALUATED, len(docs)))), len(masks) - 1)
            here, present = docs[done : ends[mask]], bits[group[done : ends[mask]]]
            score = np.zeros(len(here), np.int64)
            for j in np.flatnonzero(present.any(axis=0)).tolist():
                of = np.flatnonzero(present[:, j])
                own, share = self.postings[int(terms[j])]
                score[of] += factor[j] * share[np.searchsorted(own, here[of])]
            found, scores = np.append(found, here), np.append(scores, score)
            done, mask = int(ends[mask]), mask + 1
        ids = np.array([_NO_ID if self.block.ids[d] is None else self.block.ids[d] for d in found.tolist()], np.int64)
        order = np.lexsort((ids, -scores))[:top]
        order = order[scores[order] > 0]
        return found[order], scores[order]


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and terms of all documents with repeats."""
    n, words = index.select(F.explode("n_words").alias("n")).filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    return n, words or 0


def _document_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["terms"], "<u8")
                if len(own):
                    counts = np.diff(np.append(np.frombuffer(row["firsts"], "<u4").astype(np.int64), row["n"]))
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, counts[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "n"])

    sizes = index.select("terms", "firsts", (F.octet_length("docs") / 4).cast("long").alias("n"))
    found = sizes.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def item_chunks(items: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Items]:
    """Items (item_id, text) in chunks of about ``chunk_bytes`` of text, chosen by hash."""
    plain = items.select("item_id", F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    for k in range(n):
        rows = plain.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        hashes, counts = word_hashes([x.encode() for x in rows["text"].to_pylist()], ALPHANUMERIC)
        yield Items(rows["item_id"].to_pylist(), np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else [])


def block_results(index: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_words: int, top: int) -> DataFrame:
    """The best documents of each block for each item of the chunk: block, item (its number), doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                scorer = _Scorer(_Block(row), items, weights, n_docs, n_words)
                who, ids, scores = [], [], []
                for item in range(len(items.names)):
                    found, score = scorer.best(item, top)
                    who += [item] * len(found)
                    ids += [row["doc_ids"][d] for d in found.tolist()]
                    scores += score.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(who), pa.int64()), pa.array(who, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                    names=["block", "item", "doc_id", "score"],
                )

    return index.mapInArrow(run, "block long, item int, doc_id long, score long")


def _ranked(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, top: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score."""
    spark = index.sparkSession
    n_docs, n_words = corpus_size(index)
    kind = items.schema["item_id"].dataType
    named = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    out = None
    for k, chunk in enumerate(item_chunks(items, chunk_bytes)):
        df = _document_frequencies(index, chunk.terms)
        weights = np.where(df > 0, term_weights(df, n_docs), 0)
        # A chunk has few items; each has at most ``top`` rows per group of blocks.
        names = spark.createDataFrame([(k, i, name) for i, name in enumerate(chunk.names)], named)
        found = block_results(index, chunk, weights, n_docs, n_words, top).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
        first = _ranked(found, ["item", "salt"], top).drop("rank")
        here = _ranked(first, ["item"], top).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = here if out is None else out.unionByName(here)
    return out


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Index the documents and search them for every item."""
    index, _ = stored(build_index(docs), "term-index")
    return search(index, items)

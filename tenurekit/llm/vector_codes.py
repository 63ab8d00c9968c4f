"""Compression of vectors to a byte per part, with whole numbers only.

A vector's components become integers, and its parts are replaced by the number of the nearest entry of
the part's codebook. Distances are compared after an integer Walsh-Hadamard transform of the parts and
entries, padded with zeros to a power of two ``m``: the transform multiplies every squared distance by
``m`` exactly, and a sum over some coefficients is a lower bound of the sum over all. Coefficients are
added up in sequency order, slow ones first, for all entries; the entry that looks nearest is added up in
full, and every entry whose partial sum exceeds that is left out, again after each further step. What
remains are the nearest entries, ties included, so the codes are those of a full search.

Codebooks are fitted in rounds: tasks add up the parts of each entry, a fixed number of tasks add up
those sums, and the driver divides them. A round moves sums of the size of the codebooks, whatever the
number of vectors.

Defined cases: vectors that are null or hold null or non-finite components are left out; shorter vectors
than the longest, and lengths that the number of parts doesn't divide, are filled up with zeros; equal
ids start in the order of their vectors, null ids last; fewer vectors than entries make smaller
codebooks; repeated rows count as often as they occur; components of any size are taken (very large ones
by Python's integers), and errors beyond a long give the largest long; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurekit.llm.common import drop, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Components are multiplied by this and rounded down.
SCALE = 1024
#: Share of the coefficients added up for all entries first, and how many at each step for those that remain.
HEAD = 0.75
STEP = 4
#: Vectors compared at once.
ROWS = 512
#: Tasks that add up the sums of all others.
MERGERS = 16
_LONGEST = (1 << 63) - 1


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row by butterflies, in natural order; rows have a power of two components."""
    n, m = x.shape
    half = 1
    while half < m:
        pairs = x.reshape(n, m // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, m)
        half *= 2
    return x


def sequency_order(m: int) -> np.ndarray:
    """Places of the natural order by the number of sign changes of their functions."""
    functions = walsh_hadamard(np.eye(m, dtype=np.int64))
    return np.argsort((functions[1:, :] != functions[:-1, :]).sum(axis=0), kind="stable")


def _transformed(x: np.ndarray, m: int) -> np.ndarray:
    padded = np.zeros((len(x), m), x.dtype)
    padded[:, : x.shape[1]] = x
    return walsh_hadamard(padded)[:, sequency_order(m)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the first of its nearest entries, and the squared distance."""
    m = 1 << max(parts.shape[1] - 1, 0).bit_length()
    near, head = _transformed(entries, m), max(1, int(HEAD * m))
    best, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    for at in range(0, len(parts), ROWS):
        here = _transformed(parts[at : at + ROWS], m)
        partial = np.zeros((len(here), len(near)), parts.dtype)
        for k in range(head):
            partial += (here[:, k, None] - near[None, :, k]) ** 2
        limit = ((here - near[partial.argmin(axis=1)]) ** 2).sum(axis=1)
        row, entry = np.nonzero(partial <= limit[:, None])
        total = partial[row, entry]
        for k in range(head, m, STEP):
            total = total + ((here[row, k : k + STEP] - near[entry, k : k + STEP]) ** 2).sum(axis=1)
            left = np.flatnonzero(total <= limit[row])
            row, entry, total = row[left], entry[left], total[left]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        least = np.minimum.reduceat(total, first)
        hit = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, len(row)))))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]
        best[at : at + ROWS] = entry[hit]
        error[at : at + ROWS] = least // m
    return best, error


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, (part, entry, position); ``wide`` if they or the vectors need integers of any size."""

    entries: np.ndarray
    wide: bool

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers by vector and part, and the distances summed over parts."""
        size = self.entries.shape[2]
        found = [nearest(vectors[:, p * size : (p + 1) * size], self.entries[p]) for p in range(len(self.entries))]
        return np.stack([best for best, _ in found], axis=1), sum(error for _, error in found)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, in units of 1 / SCALE."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1)


def whole_numbers(vectors: pa.Array, width: int, wide: bool) -> np.ndarray:
    """Components times SCALE, rounded down; rows filled up with zeros."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = np.zeros((len(vectors), width))
    values[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    if not wide:
        return np.floor(values * SCALE).astype(np.int64)
    out = np.array([math.floor(Fraction(x) * SCALE) for x in values.ravel().tolist()], dtype=object)
    return out.reshape(values.shape)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the vectors without null and non-finite components."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.filter(F.col("embedding").isNotNull() & fine)


def _needs_wide(most: float, m: int) -> bool:
    """Whether a scaled squared distance of components up to ``most`` could leave 62 bits."""
    return 2 * (most * SCALE + 1) * m >= 2.0**31


def _added(old: np.ndarray | None, new: np.ndarray) -> np.ndarray:
    if old is None:
        return new
    if old.dtype != object and max(int(abs(old).max(initial=0)), int(abs(new).max(initial=0))) > 1 << 61:
        old, new = old.astype(object), new.astype(object)
    return old + new


def _sums(kept: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts assigned to each entry."""
    parts, entries, size = books.entries.shape
    kind = object if books.wide else np.int64

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = whole_numbers(batch.column(0), books.width, books.wide)
            codes, _ = books.codes(vectors)
            here = np.zeros((parts, entries, size), kind)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                ranked = codes[order, p]
                first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else ranked
                if len(first) and size:
                    here[p, ranked[first]] = np.add.reduceat(vectors[order, p * size : (p + 1) * size], first, axis=0)
                counts[p] += np.bincount(ranked, minlength=entries)
            sums = _added(sums, here)
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((sums, counts))], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, np.zeros((parts, entries), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                more, n = pickle.loads(blob.as_py())
                sums, counts = _added(sums, more), counts + n
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((sums, counts))], pa.binary())], names=["sums"])

    rows = kept.select("embedding").mapInArrow(assign, "sums binary").repartition(MERGERS).mapInArrow(merge, "sums binary").collect()
    sums, counts = np.zeros((parts, entries, size), kind), np.zeros((parts, entries), np.int64)
    for row in rows:
        more, n = pickle.loads(row["sums"])
        sums, counts = _added(sums, more), counts + n
    return sums, counts


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``usable`` vectors: the first vectors' parts, moved to their parts' floored means in each round."""
    length, most = kept.select(F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", F.abs)))).first()
    size = math.ceil((length or 0) / parts)
    wide = _needs_wide(most or 0.0, 1 << max(size - 1, 0).bit_length())
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    start = whole_numbers(first["embedding"].combine_chunks().cast(pa.list_(pa.float64())), parts * size, wide)
    books = Codebooks(start.reshape(len(start), parts, size).transpose(1, 0, 2).copy(), wide)
    for _ in range(rounds if len(start) else 0):
        sums, counts = _sums(kept, books)
        means = sums // np.maximum(counts, 1)[:, :, None]
        books = Codebooks(np.where(counts[:, :, None] > 0, means, books.entries), wide or sums.dtype == object)
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of ``usable`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.codes(whole_numbers(batch.column(2), books.width, books.wide))
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            errors = [min(int(e), _LONGEST) for e in errors.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = [T.StructField("vec_id", T.LongType()), kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, T.StructType(kinds))


def compress(vectors: DataFrame) -> DataFrame:
    """Per usable vector: its code, its error, the error of all vectors of its label, and the codebooks' digest."""
    kept, path = stored(usable(vectors), "usable-vectors")
    books = fit_codebooks(kept)
    coded, _ = stored(encode(kept, books), "vector-codes")
    drop(vectors.sparkSession, path)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["of_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

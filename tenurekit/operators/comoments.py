"""Pairwise counts, means and co-moments of many columns in one pass, mergeable in any order.

A task keeps six columns x columns tables: for every pair, how many rows hold both, a centre of the one and
how far its mean over these rows lies off it, its squared deviations, their products of deviations, and how
many rows hold a NaN in either. Deviations are taken from a batch's own centre, and tables are merged by the
differences of their centres and offsets, so a large common offset costs no digits. What travels depends on the number of columns alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need not have this package installed: its task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that merge the tables of all others.
MERGERS = 16


def batch_tables(x: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Tables of one batch: n, centre, offset, squares, products, not a number; ``x`` holds 0 where not present."""
    bad = np.isnan(x)
    v = present.astype(float)
    low, high = (
        f(np.where(present & ~bad, x, fill), axis=0, initial=fill)
        for f, fill in ((np.min, np.inf), (np.max, -np.inf))
    )
    with np.errstate(invalid="ignore", divide="ignore"):
        middle = np.where(present & ~bad, x, 0.0).sum(axis=0) / (present & ~bad).sum(axis=0)
    # The value itself where a column has only one, so its deviations are exactly 0.
    centre = np.where(low < high, middle, np.where(np.isfinite(low), low, 0.0))
    gap = np.where(present & ~bad, x - centre, 0.0)
    n, held = v.T @ v, gap.T @ v
    safe = np.maximum(n, 1.0)
    return np.array(
        [
            n,
            np.broadcast_to(centre[:, None], n.shape),
            held / safe,
            np.maximum((gap**2).T @ v - held**2 / safe, 0.0),
            gap.T @ gap - held * held.T / safe,
            bad.T.astype(float) @ v + v.T @ bad.astype(float),
        ]
    )


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    n = one[0] + other[0]
    safe = np.maximum(n, 1.0)
    gap = np.where((one[0] > 0) & (other[0] > 0), (other[1] - one[1]) + (other[2] - one[2]), 0.0)
    share = one[0] * other[0] / safe
    return np.array(
        [
            n,
            np.where(one[0] > 0, one[1], other[1]),
            np.where(one[0] > 0, one[2] + gap * other[0] / safe, other[2]),
            one[3] + other[3] + gap**2 * share,
            one[4] + other[4] + gap * gap.T * share,
            one[5] + other[5],
        ]
    )


def correlations(tables: np.ndarray) -> np.ndarray:
    """Pearson coefficients; infinite where a column is constant on the rows of a pair."""
    _, _, _, squares, products, bad = tables
    with np.errstate(invalid="ignore", divide="ignore"):
        r = products / (np.sqrt(squares) * np.sqrt(squares.T))
    r[(squares == 0) | (squares.T == 0)] = np.inf
    r[bad > 0] = np.nan
    return r


class _Partial:
    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, self.width, self.width))
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in (c.fill_null(0.0) for c in batch.columns)]
            present = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]
            if batch.num_rows:
                total = merged(total, batch_tables(np.column_stack(columns), np.column_stack(present)))
        yield _row(total)


def _row(tables: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tables.tobytes()], pa.binary())], names=["tables"])


def _merged_rows(batches: Iterator[pa.RecordBatch], width: int) -> np.ndarray:
    total = np.zeros((6, width, width))
    for batch in batches:
        for cell in batch.column(0):
            total = merged(total, np.frombuffer(cell.as_buffer()).reshape(total.shape))
    return total


class _Merge:
    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _row(_merged_rows(batches, self.width))


class _Finish:
    def __init__(self, columns: list[str]):
        self.columns = columns

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = correlations(_merged_rows(batches, len(self.columns)))
        pairs = list(combinations(range(len(self.columns)), 2))
        values = [r[i, j] for i, j in pairs]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self.columns[i] for i, _ in pairs], pa.string()),
                pa.array([self.columns[j] for _, j in pairs], pa.string()),
                pa.array([None if np.isinf(x) else float(x) for x in values], pa.float64()),
            ],
            names=["x", "y", "r"],
        )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Upper triangle of the Pearson matrix as (x, y, r), over rows where both are present.

    NULL for a column that is constant on these rows or a pair without rows, NaN where one is a NaN.
    """
    width = len(columns)
    numbers = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)))
    nothing = df.sparkSession.createDataFrame([(bytearray(np.zeros((6, width, width)).tobytes()),)], "tables binary")
    parts = numbers.mapInArrow(_Partial(width), "tables binary").unionByName(nothing)
    parts = parts.repartition(MERGERS).mapInArrow(_Merge(width), "tables binary")
    return parts.repartition(1).mapInArrow(_Finish(list(columns)), "x string, y string, r double")

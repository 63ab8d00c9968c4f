"""Risk-set sums of Cox models, computed where the rows are.

For coefficients b and weights w = exp(x b), a Cox likelihood needs sums of w
over the rows still at risk at every event time; its derivatives are sums of
w x and w x x' weighted by the cumulative hazard at each row's time. One Spark
pass adds these up per partition for many models together. The hazard used
inside a pass is that of the pass before; sums of w x by event time tell the
caller what changed, so gradients are exact. Partial sums are added up on the
executors: what leaves them depends neither on rows nor on partitions.

Survival times are whole days, so event times number in the thousands.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.expressions import is_finite
from tenurekit.session import cut_lineage, dropped_shuffles

# Executors need not have this package installed: its task functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_EVENT_TIMES = 50_000
ROWS_PER_PARTITION = 4096
MOST_ROWS_PER_PARTITION = 1 << 18
TWO_LEVEL_MERGE = 256
MODEL_CHUNK = 64
#: Sums of several models travel in one row of about so many bytes.
ROW_BYTES = 4e6
BLOCK_SCHEMA = "n int, time binary, event binary, fold binary, x binary"
SUM_SCHEMA = "models int, slot int, part int, payload binary"


@dataclass(frozen=True)
class ModelBatch:
    """Models evaluated in one pass; all use the same number of predictors."""

    beta: np.ndarray  # models x q, for standardised predictors
    columns: np.ndarray  # models x q, positions in the design
    left_out: np.ndarray  # models, fold not used for fitting, -1 for none
    hazard: np.ndarray  # models x times, cumulative hazard of the pass before
    bins: np.ndarray  # times, bin of each event time, ascending
    event_hazard: np.ndarray | None = None  # same for events only (tied events, Efron)

    def take(self, index: np.ndarray) -> ModelBatch:
        extra = None if self.event_hazard is None else self.event_hazard[index]
        return ModelBatch(
            self.beta[index], self.columns[index], self.left_out[index], self.hazard[index],
            self.bins, extra,
        )

    @property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        """Parts of the sums of one model."""
        q, n_bins = self.beta.shape[1], int(self.bins[-1]) + 1
        parts = {
            "s0": (len(self.bins),),
            "s0_other": (len(self.bins),),
            "s1": (n_bins, q),
            "pull": (q,),
            "cross": (q, q),
        }
        return parts if self.event_hazard is None else parts | {"s1_events": (n_bins, q)}

    @property
    def bytes_each(self) -> int:
        return 8 * sum(int(np.prod(shape)) for shape in self.shapes.values())


@dataclass(frozen=True)
class RiskSums:
    """Sums per model (first axis); times are event times."""

    s0: np.ndarray  # times: w of rows used for fitting
    s0_other: np.ndarray  # times: w of held-out rows, or of the events when ties are split
    s1: np.ndarray  # bins x q: w x
    pull: np.ndarray  # q: w x hazard
    cross: np.ndarray  # q x q: w x x' hazard
    s1_events: np.ndarray | None = None  # bins x q: w x of the events


@dataclass
class RiskSetData:
    """A design ready for passes: packed rows in Spark, small tables on the driver."""

    blocks: DataFrame
    partitions: int
    columns: list[str]
    times: np.ndarray
    folds: int
    n_rows: np.ndarray  # folds
    mean: np.ndarray
    scale: np.ndarray  # 1 for constant columns
    constant: np.ndarray
    fold_scale: np.ndarray  # (folds + 1) x p, spread without fold f relative to ``scale``; last: all
    events: np.ndarray  # folds x times
    event_x: np.ndarray  # folds x times x p, standardised

    def close(self) -> None:
        self.blocks.unpersist()

    def without(self, by_fold: np.ndarray, left_out: np.ndarray) -> np.ndarray:
        """Totals over all folds except the left-out one, one row per model."""
        total = by_fold.sum(axis=0)
        padded = np.concatenate([by_fold, np.zeros_like(by_fold[:1])])
        return total[None] - padded[left_out]

    def evaluate(self, batch: ModelBatch) -> RiskSums:
        """One pass over the rows for all models of the batch."""
        slots = max(1, round(self.partitions**0.5))
        shapes, m = batch.shapes, len(batch.beta)
        sizes = [int(np.prod(shape)) for shape in shapes.values()]
        per_row = int(max(1, ROW_BYTES // (8 * sum(sizes))))
        rows = -(-m // per_row)
        with dropped_shuffles(self.blocks.sparkSession):
            sums = self.blocks.mapInArrow(_PartitionSums(batch, slots, per_row), SUM_SCHEMA)
            if self.partitions > TWO_LEVEL_MERGE:
                sums = _merged(sums, rows * slots).withColumn("part", F.col("slot"))
            # One row per ``per_row`` models reaches the driver, however many partitions there are.
            table = _merged(sums.withColumn("slot", F.lit(0)), rows).toArrow()
        flat = np.zeros((m, sum(sizes)))
        for first, payload in zip(table["models"].to_pylist(), table["payload"]):
            found = np.frombuffer(payload.as_buffer(), dtype=np.float64).reshape(-1, sum(sizes))
            flat[first * per_row : first * per_row + len(found)] = found
        pieces = np.split(flat, np.cumsum(sizes)[:-1], axis=1)
        return RiskSums(
            **{k: x.reshape(m, *shape) for (k, shape), x in zip(shapes.items(), pieces)}
        )


class _PartitionSums:
    """Task function: packed rows of a partition to one payload per model."""

    def __init__(self, batch: ModelBatch, slots: int, per_row: int):
        self.batch, self.slots, self.per_row = batch, slots, per_row

    def __call__(self, batches):
        batch, m = self.batch, len(self.batch.beta)
        sums = {k: np.zeros((m, *shape)) for k, shape in batch.shapes.items()}
        # Coefficients far off may overflow; the caller then takes a shorter step.
        with np.errstate(over="ignore", invalid="ignore"):
            for arrow in batches:
                for i in range(arrow.num_rows):
                    self._add(sums, *_unpack(arrow, i))
        part = TaskContext.get().partitionId()
        for k, first in enumerate(range(0, m, self.per_row)):
            models = slice(first, min(first + self.per_row, m))
            flat = [x[models].reshape(models.stop - first, -1) for x in sums.values()]
            yield _sum_row(k, part % self.slots, part, np.concatenate(flat, axis=1))

    def _add(self, sums, time, event, fold, x):
        b = self.batch
        upper = np.triu_indices(x.shape[1])
        products = x[:, upper[0]] * x[:, upper[1]]
        times = _Runs(time)
        bins = _Runs(b.bins[time])
        for first in range(0, len(b.beta), MODEL_CHUNK):
            part = slice(first, min(first + MODEL_CHUNK, len(b.beta)))
            columns = b.columns[part]
            full = np.zeros((len(columns), x.shape[1]))
            np.put_along_axis(full, columns, b.beta[part], axis=1)
            w = np.exp(x @ full.T)
            held = fold[:, None] == b.left_out[part]
            used = np.where(held, 0.0, w)
            hazard = used * b.hazard[part][:, time].T
            sums["s0"][part, times.value] += times.add(used)
            sums["s1"][part, bins.value] += bins.cross(used, x, columns)
            if b.event_hazard is None:
                sums["s0_other"][part, times.value] += times.add(np.where(held, w, 0.0))
            else:
                failed = used * event[:, None]
                sums["s0_other"][part, times.value] += times.add(failed)
                sums["s1_events"][part, bins.value] += bins.cross(failed, x, columns)
                hazard -= failed * b.event_hazard[part][:, time].T
            sums["pull"][part] += np.take_along_axis(hazard.T @ x, columns, axis=1)
            cross = np.zeros((len(columns), x.shape[1], x.shape[1]))
            cross[:, upper[0], upper[1]] = cross[:, upper[1], upper[0]] = hazard.T @ products
            row = np.arange(len(columns))[:, None, None]
            sums["cross"][part] += cross[row, columns[:, :, None], columns[:, None, :]]


def _unpack(arrow: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    time, event, fold, x = (
        np.frombuffer(arrow[c][i].as_buffer(), dtype=kind)
        for c, kind in (
            ("time", np.int32), ("event", np.int8), ("fold", np.int16), ("x", np.float64)
        )
    )
    return time, event, fold, x.reshape(len(time), -1)


class _Runs:
    """Runs of equal values in a sorted array, and sums over each of them."""

    def __init__(self, values: np.ndarray):
        self.start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        self.value = values[self.start]
        self.end = np.r_[self.start[1:], len(values)]

    def add(self, weights: np.ndarray) -> np.ndarray:
        """rows x models to models x runs."""
        return np.add.reduceat(weights, self.start, axis=0).T

    def cross(self, weights: np.ndarray, x: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """rows x models, rows x predictors and each model's columns to models x runs x columns."""
        products = weights[:, :, None] * x[:, columns]
        return np.add.reduceat(products, self.start, axis=0).swapaxes(0, 1)


def _sum_row(models: int, slot: int, part: int, payload: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([v], pa.int32()) for v in (models, slot, part)]
    return pa.RecordBatch.from_arrays(
        [*cells, pa.array([payload.tobytes()], pa.binary())],
        names=["models", "slot", "part", "payload"],
    )


def _merged(sums: DataFrame, groups: int) -> DataFrame:
    """Payloads of the same models and slot added up, one after another, in the order of their parts."""
    groups = min(groups, 4 * sums.sparkSession.sparkContext.defaultParallelism)
    dealt = sums.repartition(groups, "models", "slot")
    return dealt.sortWithinPartitions("models", "slot", "part").mapInArrow(_add_payloads, SUM_SCHEMA)


def _add_payloads(batches):
    key, total = None, None
    for arrow in batches:
        for i in range(arrow.num_rows):
            here = arrow["models"][i].as_py(), arrow["slot"][i].as_py()
            payload = np.frombuffer(arrow["payload"][i].as_buffer(), dtype=np.float64)
            if here != key:
                if key is not None:
                    yield _sum_row(*key, 0, total)
                key, total = here, payload.copy()
            else:
                total += payload
    if key is not None:
        yield _sum_row(*key, 0, total)


class _Pack:
    """Task function: rows to blocks of standardised predictors, sorted by event-time bin."""

    def __init__(self, columns, times, mean, scale):
        self.columns, self.times, self.mean, self.scale = columns, times, mean, scale

    def __call__(self, batches):
        for arrow in batches:
            time = arrow["time"].to_numpy(zero_copy_only=False)
            where = np.searchsorted(self.times, time, side="right") - 1
            # A row that leaves before the first event is in no risk set.
            order = np.argsort(where, kind="stable")
            order = order[where[order] >= 0]
            if not len(order):
                continue
            x = np.column_stack(
                [arrow[c].to_numpy(zero_copy_only=False)[order] for c in self.columns]
            )
            x = (x - self.mean) / self.scale
            event = arrow["event"].to_numpy(zero_copy_only=False)[order].astype(np.int8)
            fold = arrow["fold"].to_numpy(zero_copy_only=False)[order].astype(np.int16)
            cells = [
                where[order].astype(np.int32).tobytes(),
                event.tobytes(),
                fold.tobytes(),
                np.ascontiguousarray(x).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(order)], pa.int32())] + [pa.array([c], pa.binary()) for c in cells],
                names=["n", "time", "event", "fold", "x"],
            )


def _check_finite(frame: DataFrame, columns: list[str]) -> None:
    bad = frame.agg(*(F.count_if(~is_finite(c, "double")).alias(c) for c in columns)).first()
    names = [c for c in columns if bad[c]]
    if names:
        raise ValueError(f"non-finite predictors: {names}")


def prepare(
    df: DataFrame,
    columns: list[str],
    time: str = "survival_time",
    event: str = "churned",
    folds: int = 1,
) -> RiskSetData:
    """Pack a frame (with a ``fold`` column if there are several) for passes."""
    p = len(columns)
    if folds > np.iinfo(np.int16).max:
        raise ValueError(f"at most {np.iinfo(np.int16).max} folds")
    fold = F.col("fold") if folds > 1 else F.lit(0)
    frame = cut_lineage(
        df.select(
            F.col(time).cast("double").alias("time"),
            F.col(event).cast("int").alias("event"),
            fold.cast("int").alias("fold"),
            *(F.col(c).cast("double").alias(c) for c in columns),
        )
    )
    _check_finite(frame, columns)

    moments = frame.groupBy("fold").agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)),
        *(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)),
    )
    n, mean_f, var_f = np.zeros(folds), np.zeros((folds, p)), np.zeros((folds, p))
    for row in moments.collect():
        n[row["fold"]] = row["n"]
        mean_f[row["fold"]] = [row[f"m{i}"] for i in range(p)]
        var_f[row["fold"]] = [row[f"v{i}"] for i in range(p)]

    def spread(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weight = (n * keep)[:, None] / max((n * keep).sum(), 1.0)
        mean = (weight * mean_f).sum(axis=0)
        return mean, np.sqrt((weight * (var_f + (mean_f - mean) ** 2)).sum(axis=0))

    mean, sd = spread(np.ones(folds))
    constant = sd <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale = np.where(constant, 1.0, sd)
    fold_scale = np.ones((folds + 1, p))
    if folds > 1:
        for f in range(folds):
            fold_scale[f] = spread(np.arange(folds) != f)[1] / scale
    fold_scale[fold_scale <= 1e-12] = 0.0

    by_time = frame.filter("event = 1").groupBy("fold", "time").agg(
        F.count("*").alias("d"), *(F.sum(c).alias(f"x{i}") for i, c in enumerate(columns))
    )
    small = by_time.limit(MAX_EVENT_TIMES * folds + 1).toArrow()
    times = np.unique(small["time"].to_numpy())
    if len(times) == 0 or len(times) > MAX_EVENT_TIMES:
        raise ValueError("need at least one event, and event times in whole days")
    where = np.searchsorted(times, small["time"].to_numpy())
    in_fold = small["fold"].to_numpy()
    events, event_x = np.zeros((folds, len(times))), np.zeros((folds, len(times), p))
    events[in_fold, where] = small["d"].to_numpy()
    sums = np.column_stack([small[f"x{i}"].to_numpy() for i in range(p)])
    event_x[in_fold, where] = (sums - events[in_fold, where][:, None] * mean) / scale

    # Small designs take as many tasks as there are cores, large ones as many as their rows need.
    busy = 4 * frame.sparkSession.sparkContext.defaultParallelism
    wanted = min(-(-n.sum() // ROWS_PER_PARTITION), busy)
    partitions = int(max(1, wanted, -(-n.sum() // MOST_ROWS_PER_PARTITION)))
    blocks = cut_lineage(
        frame.repartition(partitions).mapInArrow(_Pack(columns, times, mean, scale), BLOCK_SCHEMA)
    ).persist()
    return RiskSetData(
        blocks, partitions, columns, times, folds, n, mean, scale, constant, fold_scale,
        events, event_x,
    )

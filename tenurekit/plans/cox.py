"""Cox regression on Spark: elastic-net paths with cross-validation, and plain fits.

Rows never leave the executors; each iteration is one pass (see ``risksets``)
followed by algebra on predictors x predictors matrices. Models that differ in
penalty, left-out fold or predictor set share their passes.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, fields, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.functions.numeric import (
    nearest_psd,
    normal_two_sided,
    penalised_step,
    tie_sums,
)
from tenurekit.operators.risksets import ModelBatch, RiskSetData, RiskSums, prepare

LAMBDA_RATIO = 1e-4
#: Most penalties of one path that are fitted side by side; fewer where sums would take several passes.
FRONT = 8
#: A path ends where the explained share of the deviance grows by less than this part of itself,
#: or beyond so much of it, but not before so many penalties.
LEAST_GAIN = 1e-5
ENOUGH_EXPLAINED = 0.999
LEAST_PENALTIES = 5
#: Sums of so many bytes come from one pass; more models take further passes.
PAYLOAD_BYTES = 48e6
#: A penalised fit has converged when its optimality conditions hold to this share of the penalty.
OPTIMALITY_TOLERANCE = 1e-6
COST_TOLERANCE = 1e-12
LONGEST_STEP = 1.0
MAX_PASSES = 150


def _reverse_cumulative(a: np.ndarray) -> np.ndarray:
    return np.cumsum(a[:, ::-1], axis=1)[:, ::-1]


@dataclass
class _Likelihood:
    """Breslow log-likelihood of each model on its own rows, and what follows from it."""

    value: np.ndarray
    on_all_rows: np.ndarray
    gradient: np.ndarray
    hessian: np.ndarray
    increments: np.ndarray  # of the cumulative hazard at each event time
    mean: np.ndarray  # predictors of the risk set at each event time


def _breslow(data: RiskSetData, batch: ModelBatch, sums: RiskSums) -> _Likelihood:
    d = data.without(data.events, batch.left_out)
    d_all = data.events.sum(axis=0)[None]
    event_x = data.event_x.sum(axis=1)  # folds x p
    used = np.take_along_axis(data.without(event_x, batch.left_out), batch.columns, axis=1)
    every = np.take_along_axis(
        np.broadcast_to(event_x.sum(axis=0), (len(batch.beta), event_x.shape[1])),
        batch.columns,
        axis=1,
    )
    with np.errstate(all="ignore"):
        r0 = _reverse_cumulative(sums.s0)
        r0_all = r0 + _reverse_cumulative(sums.s0_other)
        value = (used * batch.beta).sum(axis=1) - np.where(d > 0, d * np.log(r0), 0.0).sum(axis=1)
        on_all = (every * batch.beta).sum(axis=1) - (d_all * np.log(r0_all)).sum(axis=1)
        increments = np.where(d > 0, d / r0, 0.0)
        change = _bin_means(np.cumsum(increments, axis=1) - batch.hazard, sums.s0, batch.bins)
        gradient = used - sums.pull - np.einsum("mb,mbj->mj", change, sums.s1)
        mean = _risk_means(sums, r0, batch.bins)
        mean[d == 0] = 0.0
        hessian = sums.cross - np.swapaxes(mean * d[:, :, None], 1, 2) @ mean
    return _Likelihood(value, on_all, gradient, hessian, increments, mean)


def _bin_means(values: np.ndarray, weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Weighted mean of values over the event times of each bin."""
    start = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    total = np.add.reduceat(weights, start, axis=1)
    return np.add.reduceat(values * weights, start, axis=1) / np.where(total > 0, total, 1.0)


def _risk_means(sums: RiskSums, r0: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Mean predictors of the risk set at each event time, interpolated within bins."""
    start = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    after1 = _reverse_cumulative(sums.s1) - sums.s1
    in_bin = np.add.reduceat(sums.s0, start, axis=1)
    after0 = r0[:, start] - in_bin
    share = (r0 - after0[:, bins]) / np.where(in_bin > 0, in_bin, 1.0)[:, bins]
    r1 = after1[:, bins] + share[:, :, None] * sums.s1[:, bins]
    return r1 / r0[:, :, None]


@dataclass
class CoxPath:
    """A cross-validated elastic-net path of one predictor set."""

    columns: list[str]
    lambdas: np.ndarray
    coefficients: np.ndarray  # lambdas x predictors, original scale
    mean_deviance: np.ndarray
    deviance_se: np.ndarray
    standardised: np.ndarray  # same for standardised predictors
    converged: np.ndarray  # per penalty: the full fit and those of all folds

    @property
    def best(self) -> int:
        """Index of the penalty with the smallest mean deviance."""
        return int(np.argmin(self.mean_deviance))

    @property
    def beta(self) -> dict[str, float]:
        """Non-zero coefficients at the best penalty."""
        found = zip(self.columns, self.coefficients[self.best])
        return {c: float(b) for c, b in found if b != 0}

    def cv_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, float(lam), float(m), float(s), int((c != 0).sum()), i == self.best, bool(done))
            for i, (lam, m, s, c, done) in enumerate(
                zip(
                    self.lambdas, self.mean_deviance, self.deviance_se, self.coefficients,
                    self.converged,
                )
            )
        ]
        return spark.createDataFrame(
            rows,
            "lambda_index int, lambda double, mean_deviance double, se double, nonzero int, "
            "is_min boolean, converged boolean",
        )


def linear_predictor(beta: dict[str, float]) -> Column:
    """Risk score as a plain column expression."""
    score = F.lit(0.0)
    for column, b in beta.items():
        score = score + F.lit(b) * F.col(column)
    return score


def fit_paths(
    data: RiskSetData,
    specs: list[list[str]],
    alpha: float = 0.5,
    n_lambdas: int = 50,
) -> list[CoxPath]:
    """Cross-validated paths for several predictor sets of equal size, fitted together."""
    position = {c: i for i, c in enumerate(data.columns)}
    spec_columns = np.array([[position[c] for c in spec] for spec in specs])
    folds = data.folds if data.folds > 1 else 0
    left_out = np.array([-1, *range(folds)])
    n_specs, n_fits, q = len(specs), len(left_out), spec_columns.shape[1]
    n_times = len(data.times)

    # One row per (spec, fit): the full fit first, then one per left-out fold.
    columns = np.repeat(spec_columns, n_fits, axis=0)
    out = np.tile(left_out, n_specs)
    n = data.without(data.n_rows[:, None], out)[:, 0]
    scale = np.take_along_axis(data.fold_scale[out], columns, axis=1)
    unused = data.constant[columns] | (scale == 0)

    bins = np.arange(n_times)
    start = ModelBatch(np.zeros((len(out), q)), columns, out, np.zeros((len(out), n_times)), bins)
    # At zero the hazard follows from row counts alone; the second look uses it.
    start = replace(start, hazard=np.cumsum(_likelihood(data, start).increments, axis=1))
    null = _likelihood(data, start)
    full = np.arange(n_specs) * n_fits
    pull = np.where(unused[full], 0.0, np.abs(null.gradient[full]) / n[full, None])
    largest = pull.max(axis=1) / alpha
    lambdas = largest[:, None] * LAMBDA_RATIO ** (np.arange(n_lambdas) / max(n_lambdas - 1, 1))

    front = _Front(data, columns, out, n, scale, unused, np.repeat(lambdas, n_fits, axis=0), alpha)
    explained = _explained(data.events.sum(axis=0), null.value[full])
    front.run(null, lambda value: _path_end(explained(value[:, full]), n_fits))
    shape = front.length.max(), n_specs, n_fits
    solved = front.beta[: shape[0]].reshape(*shape, q)
    value, on_all = (x[: shape[0]].reshape(shape) for x in (front.value, front.on_all))
    done = front.done[: shape[0]].reshape(shape).all(axis=2)

    used = np.arange(shape[0])[:, None] < front.length[full]
    if not done[used].all():
        warnings.warn(f"{(~done[used]).sum()} of {used.sum()} penalties did not converge", stacklevel=2)
    events = data.events.sum(axis=1)
    paths = []
    for s, spec in enumerate(specs):
        k = front.length[full[s]]
        raw = solved[:k, s, 0] / data.scale[spec_columns[s]]
        if folds:
            deviance = -2.0 * (on_all[:k, s, 1:] - value[:k, s, 1:]) / np.maximum(events, 1)
            mean = np.average(deviance, axis=1, weights=events)
            with np.errstate(invalid="ignore"):
                spread = np.average((deviance - mean[:, None]) ** 2, axis=1, weights=events)
            se = np.sqrt(spread / (folds - 1))
        else:
            mean, se = -2.0 * value[:k, s, 0] / events.sum(), np.zeros(k)
        paths.append(
            CoxPath(list(spec), lambdas[s, :k], raw, mean, se, solved[:k, s, 0], done[:k, s])
        )
    return paths


def _explained(events: np.ndarray, null_value: np.ndarray):
    """Share of the null deviance that fits of given log-likelihoods explain, penalties x specs."""
    most = -(events * np.log(np.maximum(events, 1.0))).sum()
    return lambda value: (value - null_value) / np.maximum(most - null_value, 1e-300)


def _path_end(explained: np.ndarray, n_fits: int) -> np.ndarray:
    """How many penalties the fits of each spec need, as far as the known ones (not NaN) tell."""
    with np.errstate(invalid="ignore"):
        gain = np.diff(explained, axis=0, prepend=np.nan)
        flat = (gain < LEAST_GAIN * explained) | (explained > ENOUGH_EXPLAINED)
    flat[: LEAST_PENALTIES - 1] = False
    known = np.cumprod(np.isfinite(explained), axis=0).astype(bool)
    flat &= known
    end = np.where(flat.any(axis=0), flat.argmax(axis=0) + 1, len(explained))
    return np.repeat(end, n_fits)


def _likelihood(data: RiskSetData, batch: ModelBatch) -> _Likelihood:
    """The likelihood of every model, in as many passes as the bytes of their sums take."""
    size = max(1, int(PAYLOAD_BYTES // batch.bytes_each))
    parts = []
    for first in range(0, len(batch.beta), size):
        part = batch.take(np.arange(first, min(first + size, len(batch.beta))))
        parts.append(_breslow(data, part, data.evaluate(part)))
    return _Likelihood(
        *(np.concatenate([getattr(p, f.name) for p in parts]) for f in fields(_Likelihood))
    )


def optimality_residual(b, gradient, l1, l2) -> np.ndarray:
    """How far the gradient of each model is from what its penalties ask for; the worst predictor."""
    with np.errstate(invalid="ignore"):
        free = np.where(np.isinf(l1), 0.0, np.maximum(np.abs(gradient) - l1, 0.0))
        held = np.abs(gradient - np.where(np.isinf(l1), 0.0, l1) * np.sign(b) - l2 * b)
    return np.where(b != 0, held, free).max(axis=1, initial=0.0)


class _Front:
    """Fits of many paths, each going on to its next penalty as soon as one of its fits is done.

    A path has several penalties in flight. A fit enters with the minimiser, under its own
    penalty, of the quadratic model at the latest point of the fit before it, so it often needs two
    or three passes. Predictors that the strong rule expects to stay out take part in no step until
    their gradient exceeds the penalty; every check of the optimality conditions covers them all.

    Sums come by event time, so the gradient is exact whatever hazard a pass was given; for the
    curvature a pass is given the hazard that the risk sets' means predict for its point. A step that
    raises the cost is shortened towards the best point so far, where the next pass takes the
    curvature anew; no fit is given up before ``MAX_PASSES``.
    """

    def __init__(self, data: RiskSetData, columns, left_out, n, scale, unused, lambdas, alpha):
        self.data, self.columns, self.left_out, self.n = data, columns, left_out, n
        self.bins = np.arange(len(data.times))
        self.scale, self.unused, self.lambdas, self.alpha = scale, unused, lambdas, alpha
        paths, size, q = len(columns), lambdas.shape[1], columns.shape[1]
        self.beta = np.zeros((size, paths, q))
        self.value, self.on_all = np.full((size, paths), np.nan), np.full((size, paths), np.nan)
        self.done = np.zeros((size, paths), dtype=bool)
        self.length = np.full(paths, size)  # penalties of each path
        self.next = np.zeros(paths, dtype=int)
        self.fits: list[_Fit] = []
        zero = np.zeros((paths, len(self.bins)))
        each = ModelBatch(np.zeros((paths, q)), columns, left_out, zero, self.bins).bytes_each
        self.width = int(np.clip(PAYLOAD_BYTES // (each * paths), 1, FRONT))

    def _penalties(self, path: int, index: int) -> tuple[np.ndarray, np.ndarray]:
        lam, scale = self.lambdas[path, index], self.scale[path]
        l1 = np.where(self.unused[path], np.inf, lam * self.alpha * scale)
        return l1, lam * (1 - self.alpha) * scale**2

    def _enter(self, latest: dict[int, _Fit]) -> None:
        """Start the next fits of all paths that have room for them."""
        in_flight = np.bincount([f.path for f in self.fits], minlength=len(self.next))
        while True:
            paths = [
                p for p in range(len(self.next))
                if in_flight[p] < self.width and self.next[p] < self.length[p]
            ]
            if not paths:
                return
            fits = []
            for p in paths:
                before, index = latest[p], int(self.next[p])
                l1, l2 = self._penalties(p, index)
                old = self.lambdas[p, max(index - 1, 0)] * self.alpha * self.scale[p]
                with np.errstate(invalid="ignore"):
                    out = (before.best == 0) & (np.abs(before.gradient) < 2 * l1 - old)
                fits.append(
                    _Fit(
                        p, index, l1, l2, out, before.best, before.gradient, before.hessian,
                        before.increments, before.mean,
                    )
                )
                self.next[p] += 1
                in_flight[p] += 1
                latest[p] = fits[-1]
            self._step(fits)
            self.fits += fits

    def _step(self, fits: list[_Fit]) -> None:
        """Move fits from their best points to the minimisers of their quadratic models."""
        if not fits:
            return
        b, gradient, hessian, l2 = (
            np.array([getattr(f, k) for f in fits]) for k in ("best", "gradient", "hessian", "l2")
        )
        l1 = np.array([np.where(f.screened, np.inf, f.l1) for f in fits])
        step = penalised_step(b, gradient, hessian, l1, l2)
        moved = np.abs(step - b).max(axis=1, initial=0.0)
        share = np.minimum(1.0, LONGEST_STEP / np.maximum(moved, 1e-30))[:, None]
        for f, x in zip(fits, b + share * (step - b)):
            f.beta = x

    def _pass(self) -> None:
        path = np.array([f.path for f in self.fits])
        batch = ModelBatch(
            np.array([f.beta for f in self.fits]), self.columns[path], self.left_out[path],
            np.array([f.predicted_hazard() for f in self.fits]), self.bins,
        )
        like = _likelihood(self.data, batch)
        n = self.n[path]
        l1, l2 = np.array([f.l1 for f in self.fits]), np.array([f.l2 for f in self.fits])
        cost = (
            -like.value / n
            + (np.where(np.isinf(l1), 0.0, l1) * np.abs(batch.beta)).sum(axis=1)
            + (l2 * batch.beta**2).sum(axis=1) / 2
        )
        usable = np.isfinite(like.gradient).all(axis=1) & np.isfinite(like.hessian).all(axis=(1, 2))
        gradient = like.gradient / n[:, None]
        off = optimality_residual(batch.beta, gradient, l1, l2)
        moving = []
        for i, f in enumerate(self.fits):
            f.passes += 1
            if not (usable[i] and cost[i] <= f.best_cost + COST_TOLERANCE * abs(cost[i])):
                f.beta = f.best + (f.beta - f.best) / 4
                continue
            f.best, f.best_cost = f.beta, cost[i]
            f.gradient, f.increments, f.mean = gradient[i], like.increments[i], like.mean[i]
            f.hessian = nearest_psd(like.hessian[i] / n[i])
            f.screened = f.screened & (np.abs(f.gradient) <= f.l1)
            f.value, f.on_all = like.value[i], like.on_all_rows[i]
            f.done = off[i] <= OPTIMALITY_TOLERANCE * self.lambdas[f.path, f.index]
            if not f.done:
                moving.append(f)
        self._step(moving)

    def run(self, null: _Likelihood, end) -> None:
        """Fit all paths; ``end`` tells from the values known so far how long each path is."""
        zero = np.zeros(self.columns.shape[1])
        latest = {
            p: _Fit(
                p, -1, zero, zero, zero != 0, zero, null.gradient[p] / self.n[p],
                nearest_psd(null.hessian[p] / self.n[p]), null.increments[p], null.mean[p],
            )
            for p in range(len(self.next))
        }
        self._enter(latest)
        while self.fits:
            self._pass()
            left = []
            for f in self.fits:
                if f.done or f.passes >= MAX_PASSES:
                    where = f.index, f.path
                    self.beta[where], self.done[where] = f.best, f.done
                    self.value[where], self.on_all[where] = f.value, f.on_all
                else:
                    left.append(f)
            self.length = np.minimum(self.length, end(self.value))
            self.fits = [f for f in left if f.index < self.length[f.path]]
            self._enter(latest)


@dataclass
class _Fit:
    """One penalty of one path in flight."""

    path: int
    index: int
    l1: np.ndarray
    l2: np.ndarray
    screened: np.ndarray
    best: np.ndarray
    gradient: np.ndarray  # of the mean log-likelihood, at ``best``, as what follows
    hessian: np.ndarray
    increments: np.ndarray
    mean: np.ndarray
    best_cost: float = np.inf
    value: float = np.nan
    on_all: float = np.nan
    passes: int = 0
    done: bool = False
    beta: np.ndarray | None = None  # where the next pass looks

    def predicted_hazard(self) -> np.ndarray:
        """Cumulative hazard at ``beta``, if risk sets grow as their mean predictors tell."""
        with np.errstate(over="ignore"):
            return np.cumsum(self.increments * np.exp(-self.mean @ (self.beta - self.best)))


def kaplan_meier_time(events: np.ndarray, at_risk: np.ndarray) -> np.ndarray:
    """One minus the Kaplan-Meier estimate just before each event time."""
    survival = np.cumprod(1.0 - events / at_risk)
    return 1.0 - np.r_[1.0, survival[:-1]]


@dataclass
class CoxFit:
    """An unpenalised fit with Efron's treatment of tied events."""

    columns: list[str]
    coefficients: np.ndarray  # original scale
    variance: np.ndarray
    log_likelihood: float
    times: np.ndarray
    events: np.ndarray  # per event time
    at_risk: np.ndarray
    expected: np.ndarray  # times x predictors: mean predictor of the risk set, original scale
    residual_sums: np.ndarray  # times x predictors: Schoenfeld residuals summed per time

    dropped: tuple[str, ...] = ()  # predictors that depend on earlier ones
    time_information: np.ndarray | None = None  # powers 0, 1, 2 of transformed time: its sums with V(t)

    @property
    def transformed_time(self) -> np.ndarray:
        return kaplan_meier_time(self.events, self.at_risk)

    def table(self, spark: SparkSession) -> DataFrame:
        """Coefficients with standard errors; all NULL for dropped predictors."""
        rows = []
        for i, c in enumerate(self.columns):
            b, se = float(self.coefficients[i]), float(np.sqrt(self.variance[i, i]))
            rows.append((c, b, float(np.exp(b)), se, b / se, normal_two_sided(b / se)))
        rows += [(c, None, None, None, None, None) for c in self.dropped]
        return spark.createDataFrame(
            rows,
            "variable string, coef double, hazard_ratio double, se double, z double, p double",
        )


class DependentPredictors(ValueError):
    def __init__(self, kept: np.ndarray, names: list[str]):
        super().__init__(f"predictors are constant or linearly dependent: {names}")
        self.kept, self.names = kept, names


def _check_rank(information: np.ndarray, columns: list[str]) -> None:
    """Raise unless every predictor adds information to the ones before it."""
    rest, kept, names = information.copy(), [], []
    for j, column in enumerate(columns):
        if rest[j, j] <= 1e-9 * max(information[j, j], 1e-12):
            names.append(column)
            continue
        kept.append(j)
        rest -= np.outer(rest[:, j], rest[j]) / rest[j, j]
    if names:
        raise DependentPredictors(np.array(kept, dtype=int), names)


def fit_unpenalised(
    df: DataFrame,
    columns: list[str],
    drop_dependent: bool = False,
    time_moments: bool = False,
    **names: str,
) -> CoxFit:
    """Cox regression by Newton steps.

    Constant or linearly dependent predictors are an error, or with
    ``drop_dependent`` are left out, the first ones of a dependent set staying.
    ``time_moments`` adds a pass for the information weighted by powers of time.
    """
    data = prepare(df, columns, **names)
    try:
        return _newton(data, np.arange(len(columns)), time_moments)
    except DependentPredictors as found:
        if not drop_dependent or not len(found.kept):
            raise
        fit = _newton(data, found.kept, time_moments)
        fit.dropped = tuple(found.names)
        return fit
    finally:
        data.close()


def _information(cross, r1, e1, ties, weight) -> np.ndarray:
    """Information of a plain fit, each event time with its weight; ``cross`` is weighted already."""
    mixed = (r1 * (weight * ties["b2"])[:, None]).T @ e1
    return (
        cross
        - (r1 * (weight * ties["a2"])[:, None]).T @ r1
        + mixed
        + mixed.T
        - (e1 * (weight * ties["c2"])[:, None]).T @ e1
    )


def _time_information(data: RiskSetData, use, beta, g, r1, e1, ties) -> np.ndarray:
    """Sums over event times of powers 0, 1, 2 of ``g`` with the information of each, in one pass.

    The hazard enters a pass linearly, so a power of time is a model of its own whose hazard grows
    by the weighted increments.
    """
    powers = g[None] ** np.arange(3)[:, None]
    batch = ModelBatch(
        np.tile(beta, (3, 1)), np.tile(use, (3, 1)), np.full(3, -1),
        np.cumsum(powers * ties["a"], axis=1), np.arange(len(g)), powers * ties["b"],
    )
    cross = data.evaluate(batch).cross
    return np.array([_information(c, r1, e1, ties, w) for c, w in zip(cross, powers)])


def _newton(data: RiskSetData, use: np.ndarray, time_moments: bool = False) -> CoxFit:
    q, n_times = len(use), len(data.times)
    columns = [data.columns[j] for j in use]
    d, event_x = data.events.sum(axis=0), data.event_x.sum(axis=0)[:, use]
    beta, best, best_value = np.zeros(q), None, -np.inf
    hazard, event_hazard, at_risk = np.zeros(n_times), np.zeros(n_times), None
    for _ in range(MAX_PASSES):
        batch = ModelBatch(
            beta[None], use[None], np.array([-1]), hazard[None], np.arange(n_times),
            event_hazard[None],
        )
        sums = data.evaluate(batch)
        r0, e0 = _reverse_cumulative(sums.s0)[0], sums.s0_other[0]
        r1, e1 = _reverse_cumulative(sums.s1)[0], sums.s1_events[0]
        ties = tie_sums(r0, e0, d)
        first = at_risk is None
        at_risk = r0 if first else at_risk
        value = float((event_x @ beta).sum() - ties["log"].sum())
        if not value >= best_value - 1e-9 * abs(value):
            beta = (beta + best) / 2
            continue
        expected = r1 * ties["a"][:, None] - e1 * ties["b"][:, None]
        previous = hazard, event_hazard
        hazard, event_hazard = np.cumsum(ties["a"]), ties["b"]
        if first:
            continue  # the same coefficients again, now with the matching hazard
        best, best_value = beta, value
        information = _information(sums.cross[0], r1, e1, ties, np.ones(n_times))
        if not beta.any():
            _check_rank(information, columns)
        step = np.linalg.solve(nearest_psd(information), event_x.sum(axis=0) - expected.sum(axis=0))
        drift = max(np.abs(hazard - previous[0]).max(), np.abs(event_hazard - previous[1]).max())
        if np.abs(step).max() < 1e-8 and drift < 1e-6 * hazard.max():
            scale = data.scale[use]
            mean_x = expected / np.maximum(d, 1)[:, None] * scale + data.mean[use]
            moments = None
            if time_moments:
                g = kaplan_meier_time(d, at_risk)
                moments = _time_information(data, use, beta, g, r1, e1, ties)
                information = moments[0]  # with this pass's own hazard
                moments = moments * np.outer(scale, scale)
            return CoxFit(
                columns,
                beta / scale,
                np.linalg.inv(information) / np.outer(scale, scale),
                value,
                data.times,
                d,
                at_risk,
                mean_x,
                (event_x - expected) * scale,
                time_information=moments,
            )
        beta = beta + step
    raise RuntimeError("the fit did not converge")

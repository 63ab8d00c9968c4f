"""Small numeric helpers for coefficient-size arrays."""

from __future__ import annotations

import math

import numpy as np

DIRECT_TERMS = 4096


def chi_square_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = z + 1 - a
    c, d = 1e300, 1.0 / b
    value = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * value


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def nearest_psd(h: np.ndarray, floor: float = 1e-9) -> np.ndarray:
    """Symmetric matrices with small or negative eigenvalues lifted to a floor."""
    values, vectors = np.linalg.eigh((h + np.swapaxes(h, -1, -2)) / 2)
    low = floor * np.maximum(values[..., -1:], 1e-30)
    return np.einsum("...ij,...j,...kj->...ik", vectors, np.maximum(values, low), vectors)


def _settle(b: np.ndarray, linear: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray):
    """Exact minimiser if its non-zero coordinates and signs are those of ``b``, else None."""
    on = np.flatnonzero(b)
    sign = np.sign(b[on])
    exact = np.zeros_like(b)
    if len(on):
        matrix = h[np.ix_(on, on)] + np.diag(l2[on])
        exact[on] = np.linalg.solve(matrix, linear[on] - l1[on] * sign)
        if (np.sign(exact[on]) != sign).any():
            return None
    rest = np.abs(linear - h @ exact)
    rest[on] = 0.0
    return exact if (rest <= l1 * (1 + 1e-9) + 1e-12).all() else None


def penalised_step(
    beta: np.ndarray,
    gradient: np.ndarray,
    hessian: np.ndarray,
    l1: np.ndarray,
    l2: np.ndarray,
    tolerance: float = 1e-9,
    max_rounds: int = 100,
    sweeps: int = 10,
) -> np.ndarray:
    """Minimise -g(b - beta) + (b - beta)'H(b - beta)/2 + l1|b| + l2 b^2/2, for many models.

    Coordinate descent with all models side by side (arrays are models x
    predictors) finds which coefficients are non-zero; after every few sweeps
    those of each model are solved for directly, which ends it once they fit.
    """
    b, linear = beta.copy(), gradient + np.einsum("mjk,mk->mj", hessian, beta)
    diagonal = np.einsum("mjj->mj", hessian) + l2
    todo = []
    for i in range(len(b)):
        exact = _settle(b[i], linear[i], hessian[i], l1[i], l2[i]) if b[i].any() else None
        if exact is None:
            todo.append(i)
        else:
            b[i] = exact
    todo = np.array(todo, dtype=int)
    for _ in range(max_rounds if len(todo) else 0):
        h, x, threshold, curve = hessian[todo], b[todo], l1[todo], diagonal[todo]
        rest = linear[todo] - np.einsum("mjk,mk->mj", h, x) - l2[todo] * x
        before = x
        for _ in range(sweeps):
            before = x.copy()
            for j in range(x.shape[1]):
                pull = rest[:, j] + curve[:, j] * x[:, j]
                new = np.sign(pull) * np.maximum(np.abs(pull) - threshold[:, j], 0.0)
                new /= curve[:, j]
                step = new - x[:, j]
                x[:, j] = new
                rest -= h[:, :, j] * step[:, None]
                rest[:, j] -= l2[todo, j] * step
        moving = np.abs(x - before).max(axis=1, initial=0.0) >= tolerance
        b[todo] = x
        left = []
        for i, model in enumerate(todo):
            exact = _settle(x[i], linear[model], h[i], threshold[i], l2[model])
            if exact is not None:
                b[model] = exact
            elif moving[i]:
                left.append(model)
        if not left:
            break
        todo = np.array(left)
    return b


def tie_sums(s0: np.ndarray, s0_events: np.ndarray, d: np.ndarray) -> dict[str, np.ndarray]:
    """Efron's sums over r = 0 .. d-1 of functions of u = s0 - (r/d) s0_events, per time.

    log: ln u; a, b: 1/u, (r/d)/u; a2, b2, c2: 1/u^2, (r/d)/u^2, (r/d)^2/u^2.
    Beyond ``DIRECT_TERMS`` ties all but the last terms come from the
    Euler-Maclaurin formula, so the work does not grow with the ties of a day.
    """
    names = ("log", "a", "b", "a2", "b2", "c2")
    out = {k: np.zeros(len(d)) for k in names}

    def terms(i: int, r: np.ndarray) -> dict[str, np.ndarray]:
        share = r / d[i]
        u = s0[i] - share * s0_events[i]
        return {
            "log": np.log(u), "a": 1 / u, "b": share / u,
            "a2": 1 / u**2, "b2": share / u**2, "c2": (share / u) ** 2,
        }

    nodes, weights = np.polynomial.legendre.leggauss(32)
    for i in np.flatnonzero(d > 0):
        first = max(0, int(d[i]) - DIRECT_TERMS)
        for k, v in terms(i, np.arange(first, int(d[i]), dtype=float)).items():
            out[k][i] += v.sum()
        if not first:
            continue
        # Panels double away from the last term, where the functions may grow without bound.
        edges = [float(first)]
        while edges[-1] > 0:
            edges.append(max(0.0, d[i] - 2 * (d[i] - edges[-1])))
        for high, low in zip(edges, edges[1:]):
            half = (high - low) / 2
            for k, v in terms(i, low + half * (nodes + 1)).items():
                out[k][i] += half * (weights @ v)
        ends = terms(i, np.array([0.0, first]))
        near = terms(i, np.array([-0.5, 0.5, first - 0.5, first + 0.5]))
        for k in names:
            slope = (near[k][3] - near[k][2]) - (near[k][1] - near[k][0])
            out[k][i] += (ends[k][0] - ends[k][1]) / 2 + slope / 12
    return out

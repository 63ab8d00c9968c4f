"""Quality of documents: a regularised quadratic discriminant over transformed text statistics.

Statistics of whole texts (shares of symbols, capitals, digits, repeated words and lines, lengths) are
smoothed towards typical values, so a text of three words isn't judged by one character. Each class has
a mean and a covariance, shrunk towards the pooled one and towards a multiple of the identity; the
amount of both is chosen on half of the sample against the other half. Scores come from the difference
of the class log densities, by Cholesky factors kept in the model, through a fitted logistic curve.

Labels are read from training folds only, from a sample of at most ``sample_rows`` rows chosen by the
hash of their ids. Statistics and scores cover every whole text.

Defined cases: null and empty texts have the statistics of an empty text and a score like any other;
labels with a null id or value are left out; documents with several labels count with each; without
labels, or with one class only, the score is the smoothed share of label 1; an empty table has no rows.
"""

from __future__ import annotations

import dataclasses
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tenurekit.llm.common import held_out, slices

SAMPLE_ROWS = 20_000
CUT = 0.3
SHRINKAGES = (0.0, 0.1, 0.3, 0.6, 0.9)
RIDGES = (0.001, 0.01, 0.1)
#: Characters, and words, that the typical values count as.
WEIGHT = 30.0


def _class_of(members: str) -> np.ndarray:
    found = np.zeros(256)
    found[list(members.encode())] = 1
    return found


_UPPER = _class_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _UPPER[np.arange(256) ^ 32] + (np.arange(256) >= 0xC0)
_DIGIT = _class_of("0123456789")
_SPACE = _class_of(" \t\r\n\x0b\x0c")
_STOP = _class_of(".,;:?'\"()-")
_LOUD = _class_of("!")
_MORE = ((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0)).astype(float)
_ODD = 1 - np.minimum(1, _UPPER + _LOWER + _DIGIT + _SPACE + _STOP + _LOUD + _MORE)
_KINDS = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _LOUD, _ODD, _MORE], axis=1)
#: Typical shares of characters: capitals, digits, stops, exclamation marks, other signs.
_TYPICAL = (0.02, 0.01, 0.03, 0.001, 0.002)


def text_statistics(texts: list[bytes]) -> np.ndarray:
    """One row of transformed statistics per text."""
    counts = np.zeros((len(texts), 256))
    rest = np.zeros((len(texts), 6))
    for i, raw in enumerate(texts):
        if raw:
            counts[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            words = raw.split()
            lines = raw.split(b"\n")
            rest[i] = len(words), len(set(words)), len(lines), len(set(lines)), max(map(len, words), default=0), sum(map(operator.eq, words, words[1:]))
    kinds = counts @ _KINDS
    n_chars = counts.sum(1) - kinds[:, 7]
    n_words, distinct, lines, distinct_lines, longest, doubled = rest.T
    shares = [np.sqrt((kinds[:, k] + WEIGHT * p) / (n_chars + WEIGHT)) for k, p in zip((0, 2, 4, 5, 6), _TYPICAL, strict=True)]
    variety = np.log((distinct + 1) / (n_words + 1)) / np.log(n_words + np.e)
    entropy = _entropy(counts)
    return np.stack(
        [
            *shares,
            np.log1p(n_chars),
            np.log((n_chars - kinds[:, 3] + WEIGHT) / (n_words + WEIGHT / 5)),
            variety,
            np.sqrt((lines - distinct_lines) / (lines + 5)),
            np.sqrt((doubled + 0.1) / (n_words + 10)),
            np.log(longest + 5),
            entropy,
        ],
        axis=1,
    )


def _entropy(counts: np.ndarray) -> np.ndarray:
    share = (counts + WEIGHT / 512) / (counts.sum(1, keepdims=True) + WEIGHT / 2)
    return -(share * np.log(share)).sum(1)


@dataclasses.dataclass
class QuadraticModel:
    """Standardisation, class means, inverse Cholesky factors, log determinants and the logistic curve."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    slope: float = 1.0
    intercept: float = 0.0
    constant: float | None = None

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.centre) / self.scale
        density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.log_ratio(x) + self.intercept, -500, 500)))


def _discriminant(x: np.ndarray, y: np.ndarray, shrinkage: float, ridge: float) -> QuadraticModel:
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    covariances = [np.cov(p.T, bias=True) if len(p) > 1 else np.zeros((z.shape[1],) * 2) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covariances, strict=True)) / len(z)
    factors, log_dets = [], []
    for c in covariances:
        c = (1 - shrinkage) * c + shrinkage * pooled
        c = (1 - ridge) * c + ridge * max(np.trace(c) / len(c), 1e-6) * np.eye(len(c))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower))
        log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return QuadraticModel(centre, scale, [p.mean(0) for p in parts], factors, log_dets)


def _logistic(t: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve with smoothed targets and a light penalty, by Newton steps."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    size = max(float(np.abs(t).mean()), 1e-9)
    design = np.stack([t / size, np.ones_like(t)], axis=1)
    beta = np.zeros(2)
    loss = lambda b: float(np.logaddexp(0, design @ b).sum() - target @ (design @ b) + 0.5 * b @ b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (p - target) + beta
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), gradient)
        while loss(beta - step) > loss(beta) and np.abs(step).max() > 1e-12:
            step = step / 2
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / size), float(beta[1])


def fit_discriminant(x: np.ndarray, y: np.ndarray, half: np.ndarray) -> QuadraticModel:
    """The model of the whole sample, shrinkage and curve chosen on each half with the other half's model."""
    if len(y) == 0 or len(set(y.tolist())) < 2:
        return QuadraticModel(*[np.zeros(0)] * 2, [], [], [], constant=float((y.sum() + 1) / (len(y) + 2)))
    halves = [(half == k, half != k) for k in (0, 1)]
    best, chosen = np.inf, (SHRINKAGES[-1], RIDGES[-1], 1.0, 0.0)
    usable = all(len(set(y[a].tolist())) == 2 for a, _ in halves)
    for shrinkage in SHRINKAGES if usable else ():
        for ridge in RIDGES:
            t = np.zeros(len(y))
            for learn, test in halves:
                t[test] = _discriminant(x[learn], y[learn], shrinkage, ridge).log_ratio(x[test])
            slope, intercept = _logistic(t, y)
            margin = np.where(y == 1, 1, -1) * (slope * t + intercept)
            if (loss := float(np.logaddexp(0, -margin).mean())) < best:
                best, chosen = loss, (shrinkage, ridge, slope, intercept)
    model = _discriminant(x, y, *chosen[:2])
    slope, intercept = chosen[2:] if usable else _logistic(model.log_ratio(x), y)
    model.slope, model.intercept = slope, intercept
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QuadraticModel:
    """Learn from a bounded sample of labelled documents outside the held-out fold."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(~held_out(F.col("doc_id")))
    usable = usable.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id", "quality").limit(sample_rows)
    statistics = _statistics_udf()
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(usable), "doc_id")  # sample_rows rows of three numbers at most
        .select("order", "quality", statistics("text").alias("x"))
        .orderBy("order", "quality", "x").limit(sample_rows).toArrow()
    )
    if not rows.num_rows:
        return fit_discriminant(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0, int))
    x = np.array(rows["x"].to_pylist())
    return fit_discriminant(x, rows["quality"].to_numpy().astype(int), (rows["order"].to_numpy() >> 7) & 1)


def _in_slices(texts: pa.Array):
    raw = texts.cast(pa.binary())
    lengths = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False)
    for i, j in slices(lengths):
        yield [x or b"" for x in raw.slice(i, j - i).to_pylist()]


def _statistics_udf():
    @arrow_udf("array<double>")
    def statistics(texts: pa.Array) -> pa.Array:
        return pa.array([row for part in _in_slices(texts) for row in text_statistics(part).tolist()], pa.list_(pa.float64()))

    return statistics


def quality_score(model: QuadraticModel, text: Column) -> Column:
    """The model's score of each whole text; the other columns never leave the engine."""

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [model.score(text_statistics(part)) for part in _in_slices(texts)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    model = fit_quality(docs, labels, sample_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))

"""The penalised path on the study's own, nearly collinear design."""

import warnings

import numpy as np
import pytest

from conftest import SMALL
from tenurekit.columns import predictors
from tenurekit.operators import risksets
from tenurekit.plans import cox, features, models
from tenurekit.sources import roles
from tenurekit.sources.roles import ROLE_STUDY as STUDY
from test_cox import breslow_gradient


@pytest.fixture(scope="module")
def design(spark):
    survival = features.study_dataset(roles.role_tables(spark, SMALL), STUDY)
    engineered = features.engineered_features(survival, STUDY)
    train, _ = models._train_and_test(engineered, STUDY, 10_000, 1, 1, STUDY.min_tenure_years)
    return train.cache()


@pytest.fixture(scope="module")
def names(design):
    return [c for c in predictors(design.columns) if c not in ("fold", "is_train")]


def fit(design, names, monkeypatch, batch=3, rows=4096):
    monkeypatch.setattr(cox, "FRONT", batch)
    monkeypatch.setattr(risksets, "ROWS_PER_PARTITION", rows)
    data = risksets.prepare(design, names, folds=STUDY.n_folds)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        path = cox.fit_paths(data, [names], STUDY.alpha, 50)[0]
    data.close()
    assert path.converged.all()
    return path


@pytest.fixture(scope="module")
def usual(design, names):
    with pytest.MonkeyPatch.context() as patch:
        return fit(design, names, patch)


def test_batches_and_partitions_change_nothing(design, names, usual, monkeypatch):
    again = fit(design, names, monkeypatch, batch=17, rows=7)
    assert again.best == usual.best
    assert again.mean_deviance == pytest.approx(usual.mean_deviance, rel=1e-6)
    assert again.standardised == pytest.approx(usual.standardised, abs=1e-4)


def test_every_penalty_is_at_its_optimum(design, names, usual):
    pdf = design.toPandas()
    x, time, event = pdf[names].to_numpy(float), pdf["survival_time"].to_numpy(), pdf["churned"].to_numpy()
    sd = x.std(axis=0)
    fixed = sd > 1e-12 * np.maximum(1, np.abs(x.mean(axis=0)))
    for lam, raw in zip(usual.lambdas, usual.coefficients):
        g, b = breslow_gradient(raw, x, time, event)[fixed] / sd[fixed] / len(x), (raw * sd)[fixed]
        l1 = lam * STUDY.alpha
        off = np.where(b != 0, np.abs(g - l1 * np.sign(b) - lam * (1 - STUDY.alpha) * b), np.maximum(np.abs(g) - l1, 0))
        assert off.max() <= 1e-3 * lam


def passes_of(design, specs, monkeypatch):
    calls = []
    evaluate = risksets.RiskSetData.evaluate
    monkeypatch.setattr(risksets.RiskSetData, "evaluate", lambda *a: calls.append(1) or evaluate(*a))
    columns = list(dict.fromkeys(c for spec in specs for c in spec))
    data = risksets.prepare(design, columns, folds=STUDY.n_folds)
    paths = cox.fit_paths(data, specs, STUDY.alpha, 30)
    data.close()
    monkeypatch.undo()
    assert all(p.converged.all() for p in paths)
    return len(calls)


def test_no_path_waits_for_another(design, names, monkeypatch):
    specs = [names[:6], names[6:12], [*names[:3], *names[12:15]]]
    monkeypatch.setattr(cox, "FRONT", 3)
    alone = []
    for spec in specs:
        alone.append(passes_of(design, [spec], monkeypatch))
        monkeypatch.setattr(cox, "FRONT", 3)
    together = passes_of(design, specs, monkeypatch)
    assert together <= 1.2 * max(alone)


def test_a_path_ends_where_the_deviance_is_flat():
    gains = np.array([0.0, 0.1, 0.15, 0.17, 0.18, 0.180001, 0.180002, 0.19])
    assert list(cox._path_end(np.column_stack([gains, gains * 0.5]), 2)) == [6, 6, 6, 6]
    assert list(cox._path_end(np.array([[0.0], [0.9991], [0.9992], [0.9993], [0.9994], [0.9995]]), 1)) == [5]
    unknown = np.array([[0.0], [0.1], [0.2], [np.nan], [0.2], [0.2]])
    assert list(cox._path_end(unknown, 1)) == [6]


def test_a_short_path_is_a_part_of_the_long_one(design, names, monkeypatch):
    monkeypatch.setattr(cox, "LEAST_GAIN", 0.02)
    short = fit(design, names, monkeypatch)
    assert cox.LEAST_PENALTIES <= len(short.lambdas) < 50
    monkeypatch.setattr(cox, "LEAST_GAIN", 0.0)
    long = fit(design, names, monkeypatch)
    k = len(short.lambdas)
    assert short.coefficients == pytest.approx(long.coefficients[:k], abs=1e-4)
    assert short.mean_deviance == pytest.approx(long.mean_deviance[:k], rel=1e-6)

import time as clock

import numpy as np
import pandas as pd
import pytest

from tenurekit.functions.numeric import chi_square_tail, normal_two_sided, tie_sums
from tenurekit.operators import risksets
from tenurekit.plans import cox, diagnostics

NAMES = list("abcd")


def efron(beta, x, time, event):
    eta = x @ beta
    w, total = np.exp(eta), 0.0
    for t in np.unique(time[event == 1]):
        dead = (time == t) & (event == 1)
        d, risk, lost = dead.sum(), w[time >= t].sum(), w[dead].sum()
        total += eta[dead].sum() - sum(np.log(risk - r / d * lost) for r in range(d))
    return total


def breslow_gradient(beta, x, time, event):
    w, g = np.exp(x @ beta), np.zeros(x.shape[1])
    for t in np.unique(time[event == 1]):
        dead, risk = (time == t) & (event == 1), time >= t
        g += x[dead].sum(axis=0) - dead.sum() * (w[risk] @ x[risk]) / w[risk].sum()
    return g


def simulate(n=1500, seed=1, drift=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 3, 0.2, 1] + [0, 5, 1, 0]
    x[:, 3] = x[:, 0] * 0.5 + x[:, 3] * 0.5
    rate = np.exp(x @ [0.7, -0.2, 0, 0]) / 200
    fail = rng.exponential(1 / rate)
    if drift:
        fail = np.where(fail > 100, 100 + (fail - 100) * np.exp(drift * x[:, 0]), fail)
    fail, censor = np.ceil(fail), np.ceil(rng.exponential(300, n))
    return x, np.minimum(fail, censor), (fail <= censor).astype(int)


def frame_of(spark, x, time, event, folds=5):
    pdf = pd.DataFrame(x, columns=NAMES[: x.shape[1]])
    pdf["survival_time"], pdf["churned"] = time, event
    pdf["fold"] = np.arange(len(pdf)) % folds
    pdf["user_id"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def sample(spark):
    x, time, event = simulate()
    return x, time, event, frame_of(spark, x, time, event).cache()


@pytest.fixture(scope="module")
def plain(sample):
    return cox.fit_unpenalised(sample[3], NAMES)


def test_toy_with_ties(spark):
    x = np.array([[0.1], [0.9], [0.4], [1.2], [0.3], [2.0], [0.7], [1.1]])
    time = np.array([1, 1, 2, 2, 2, 3, 4, 4.0])
    event = np.array([1, 1, 1, 1, 0, 0, 1, 0])
    fit = cox.fit_unpenalised(frame_of(spark, x, time, event), ["a"])
    b, h = fit.coefficients, 1e-5
    assert fit.log_likelihood == pytest.approx(efron(b, x, time, event))
    slope = (efron(b + h, x, time, event) - efron(b - h, x, time, event)) / (2 * h)
    assert abs(slope) < 1e-6


def test_plain_fit_is_the_maximum(sample, plain):
    x, time, event, _ = sample
    b = plain.coefficients
    assert plain.log_likelihood == pytest.approx(efron(b, x, time, event), rel=1e-12)
    for step in np.eye(4) * 1e-4:
        slope = (efron(b + step, x, time, event) - efron(b - step, x, time, event)) / 2e-4
        assert abs(slope) < 1e-3
    assert b[0] == pytest.approx(0.7, abs=0.2) and b[1] == pytest.approx(-0.2, abs=0.05)


def test_plain_fit_variance(sample, plain):
    x, time, event, _ = sample
    e, b, info = 1e-3, plain.coefficients, np.zeros((4, 4))
    steps = np.eye(4) * e
    for i in range(4):
        for j in range(4):
            p, q = steps[i], steps[j]
            info[i, j] = -sum(
                s * efron(b + v, x, time, event)
                for s, v in ((1, p + q), (-1, p - q), (-1, q - p), (1, -p - q))
            ) / (4 * e * e)
    assert np.sqrt(np.diag(plain.variance)) == pytest.approx(
        np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-3
    )


def test_path_meets_its_optimality_conditions(sample):
    x, time, event, frame = sample
    data = risksets.prepare(frame, NAMES, folds=5)
    path = cox.fit_paths(data, [NAMES], alpha=0.5, n_lambdas=20)[0]
    data.close()
    sd, n = x.std(axis=0), len(x)
    assert not path.coefficients[0].any() and path.coefficients[1].any()
    for lam, raw in zip(path.lambdas, path.coefficients):
        g, b = breslow_gradient(raw, x, time, event) / sd / n, raw * sd
        off = np.where(
            b != 0,
            np.abs(g - lam * 0.5 * np.sign(b) - lam * 0.5 * b),
            np.maximum(np.abs(g) - lam * 0.5, 0),
        )
        assert off.max() < 2e-5
    assert set(path.beta) >= {"a", "b"}


@pytest.mark.parametrize("rows, two_level", [(30, 256), (20, 48)])
def test_merging_partitions_changes_nothing(sample, monkeypatch, plain, rows, two_level):
    monkeypatch.setattr(risksets, "ROWS_PER_PARTITION", rows)
    monkeypatch.setattr(risksets, "TWO_LEVEL_MERGE", two_level)
    again = cox.fit_unpenalised(sample[3], NAMES)
    assert again.coefficients == pytest.approx(plain.coefficients, rel=1e-9)


def test_fits_together_equal_fits_alone(sample):
    frame = sample[3]
    data = risksets.prepare(frame, NAMES, folds=5)
    both = cox.fit_paths(data, [["a", "b"], ["a", "c"]], n_lambdas=8)
    alone = cox.fit_paths(data, [["a", "c"]], n_lambdas=8)[0]
    data.close()
    assert both[1].coefficients == pytest.approx(alone.coefficients, abs=1e-4)
    assert both[1].mean_deviance == pytest.approx(alone.mean_deviance, rel=1e-6)


def test_constant_and_dependent_predictors(spark):
    x, time, event = simulate(300)
    x[:, 2], x[:, 3] = 1.0, 2 * x[:, 0]
    frame = frame_of(spark, x, time, event)
    with pytest.raises(ValueError, match="c"):
        cox.fit_unpenalised(frame, ["a", "c"])
    with pytest.raises(ValueError, match="d"):
        cox.fit_unpenalised(frame, ["a", "b", "d"])
    kept = cox.fit_unpenalised(frame, ["a", "c", "b", "d"], drop_dependent=True)
    alone = cox.fit_unpenalised(frame, ["a", "b"])
    assert (kept.columns, kept.dropped) == (["a", "b"], ("c", "d"))
    assert kept.coefficients == pytest.approx(alone.coefficients, rel=1e-9)
    assert kept.table(spark).filter("coef IS NULL").count() == 2
    data = risksets.prepare(frame, NAMES, folds=5)
    path = cox.fit_paths(data, [NAMES], n_lambdas=5)[0]
    data.close()
    assert not path.coefficients[:, 2].any()


def test_missing_predictor_fails(spark):
    x, time, event = simulate(50)
    x[3, 1] = np.inf
    with pytest.raises(ValueError, match="b"):
        risksets.prepare(frame_of(spark, x, time, event), NAMES)


def test_tie_sums_beyond_direct_terms():
    d = np.repeat([1.0, 4096.0, 4097.0, 5000.0, 60000.0, 1e6], 3)
    lost = d * 1.25
    s0 = lost * np.tile([1.0, 1.0001, 2.0], 6)
    found = tie_sums(s0, lost, d)
    for i in range(len(d)):
        share = np.arange(d[i]) / d[i]
        u = s0[i] - share * lost[i]
        wanted = {"log": np.log(u), "a": 1 / u, "b": share / u, "a2": 1 / u**2,
                  "b2": share / u**2, "c2": (share / u) ** 2}
        for k, v in wanted.items():
            assert found[k][i] == pytest.approx(v.sum(), rel=1e-11)


def test_tail_probabilities():
    # Published tables.
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, rel=1e-9)
    assert chi_square_tail(0.0, 3) == 1.0
    assert normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-9)


def test_residual_sums_by_hand(sample, plain):
    x, time, event, frame = sample
    w = np.exp(x @ plain.coefficients)
    for i, t in enumerate(plain.times[:25]):
        dead, risk = (time == t) & (event == 1), time >= t
        d, total = dead.sum(), x[dead].sum(axis=0)
        for r in range(d):
            left = w * risk - r / d * w * dead
            total = total - (left @ x) / left.sum()
        assert plain.residual_sums[i] == pytest.approx(total, abs=1e-6)
    assert plain.residual_sums.sum(axis=0) == pytest.approx(np.zeros(4), abs=1e-4)


def test_residual_rows(sample, plain, spark):
    x, time, event, frame = sample
    found = diagnostics.schoenfeld_residuals(plain, frame).toPandas()
    assert len(found) == event.sum() * 4
    wanted = event.sum() * plain.residual_sums @ plain.variance
    sums = found.pivot_table(index="time", columns="term", values="scaled_residual", aggfunc="sum")
    assert sums[NAMES].to_numpy() == pytest.approx(wanted, abs=1e-6)


def plain_score_test(beta, x, time, event):
    """The extended model's score and information, event by event, ties by Efron."""
    w, at, q = np.exp(x @ beta), np.unique(time[event == 1]), x.shape[1]
    g, km = [], 1.0
    for t in at:
        g.append(1.0 - km)
        km *= 1 - ((time == t) & (event == 1)).sum() / (time >= t).sum()
    score, information = np.zeros(2 * q), np.zeros((2 * q, 2 * q))
    for t, gt in zip(at, g):
        dead, risk = (time == t) & (event == 1), time >= t
        both = np.hstack([x, gt * x])
        d = dead.sum()
        score += both[dead].sum(axis=0)
        for r in range(d):
            left = w * risk - r / d * w * dead
            mean = left @ both / left.sum()
            score -= mean
            information += (both * left[:, None]).T @ both / left.sum() - np.outer(mean, mean)
    u = np.r_[np.zeros(q), score[q:]]
    out = {}
    for j in range(q):
        use = [*range(q), q + j]
        out[j] = u[use] @ np.linalg.solve(information[np.ix_(use, use)], u[use])
    return out, u @ np.linalg.solve(information, u)


@pytest.mark.parametrize("days", [1, 40])
def test_ph_test_equals_the_extended_model(spark, days):
    x, time, event = simulate(300, seed=days)
    time = np.ceil(time / days) if days > 1 else time + np.arange(300) / 1024
    fit = cox.fit_unpenalised(frame_of(spark, x, time, event), NAMES, time_moments=True)
    if days > 1:
        assert (fit.events > 2).any()
    else:
        assert (fit.events == 1).all()
    terms, overall = plain_score_test(fit.coefficients, x, time, event)
    found = {r.term: r.chisq for r in diagnostics.ph_test(fit, spark).collect()}
    assert [found[c] for c in NAMES] == pytest.approx([terms[j] for j in range(4)], rel=1e-8, abs=1e-8)
    assert found["GLOBAL"] == pytest.approx(overall, rel=1e-8, abs=1e-8)
    assert fit.time_information[0] == pytest.approx(np.linalg.inv(fit.variance), rel=1e-6)


def test_proportional_hazards(spark, plain):
    with pytest.raises(ValueError, match="time_moments"):
        diagnostics.ph_test(plain, spark)
    steady = {r.term: r.p for r in diagnostics.residual_ph_test(plain, spark).collect()}
    assert steady["GLOBAL"] > 0.001
    x, time, event = simulate(seed=2, drift=1.2)
    broken = cox.fit_unpenalised(frame_of(spark, x, time, event), ["a", "b"], time_moments=True)
    for test in (diagnostics.ph_test, diagnostics.residual_ph_test):
        drifting = {r.term: r.p for r in test(broken, spark).collect()}
        assert drifting["a"] < 1e-6 and drifting["GLOBAL"] < 1e-6


def test_scores_by_functions_alone(sample, plain):
    x, time, event, frame = sample
    beta = dict(zip(NAMES, [0.3, -0.1, 0.0, 0.2]))
    found = {r.variable: r for r in diagnostics.scores(frame, beta, NAMES, efron=False).collect()}
    wanted = breslow_gradient(np.array(list(beta.values())), x, time, event)
    assert [found[c].score for c in NAMES] == pytest.approx(wanted, rel=1e-9)
    assert [found[c].sd for c in NAMES] == pytest.approx(x.std(axis=0), rel=1e-9)
    h = 1e-5
    for k, c in enumerate(NAMES):
        b, step = np.array(list(beta.values())), h * np.eye(4)[k]
        slope = (efron(b + step, x, time, event) - efron(b - step, x, time, event)) / (2 * h)
        tied = diagnostics.scores(frame, beta, NAMES, efron=True).filter(f"variable = '{c}'").first()
        assert tied.score == pytest.approx(slope, rel=1e-4, abs=1e-2)
    assert all(r.score == 0 for r in diagnostics.score_equations(plain, frame).collect())


def test_optimality_is_noticed_and_its_lack_too(sample):
    frame = sample[3]
    data = risksets.prepare(frame, NAMES, folds=5)
    path = cox.fit_paths(data, [NAMES], alpha=0.5, n_lambdas=8)[0]
    data.close()
    assert all(r.holds for r in diagnostics.optimality(path, frame, 0.5).collect())
    path.coefficients[path.best] *= 1.001
    assert not all(r.holds for r in diagnostics.optimality(path, frame, 0.5).collect())


def test_known_facts_of_many_predictors_do_not_multiply(spark):
    """What Spark knows of the rows of the scores must not double with each predictor."""
    names = [f"p{k}" for k in range(11)]
    rows = [(float(t), t % 2 == 0, *(float((t * k) % 5) for k in range(1, 12))) for t in range(1, 30)]
    frame = spark.createDataFrame(rows, ["survival_time", "churned", *names])
    found = diagnostics.scores(frame, dict.fromkeys(names, 0.1), names, efron=False)

    def most(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return max([plan.validConstraints().size(), *(most(x) for x in below)])

    assert found.count() == len(names)
    assert most(found._jdf.queryExecution().optimizedPlan()) < 100


def test_a_pass_leaves_no_shuffle_files(spark, sample):
    x, time, event, frame = sample
    data = risksets.prepare(frame, NAMES, folds=5)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    start = risksets.ModelBatch(
        np.zeros((2, 4)), np.tile(np.arange(4), (2, 1)), np.array([-1, 0]), np.zeros((2, len(data.times))), np.arange(len(data.times))
    )
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(key, None)
    assert np.isfinite(data.evaluate(start).s0).all()
    until = clock.time() + 10
    while (left := shuffled() - before) and clock.time() < until:  # they go in the background
        clock.sleep(0.1)
    data.close()
    assert not left
    assert spark.conf.get(key, None) == setting

"""Proportional-hazards checks of a plain Cox fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenurekit.functions.numeric import chi_square_tail
from tenurekit.plans.cox import CoxFit, CoxPath, linear_predictor


def ph_test(fit: CoxFit, spark: SparkSession) -> DataFrame:
    """Score test of coefficients that change with transformed time, for each predictor and for all.

    The model is extended by each predictor times the Kaplan-Meier time; at the fitted coefficients and
    no change, the score of the new terms is the residuals' sum weighted by time, and their information,
    given that the old terms are fitted too, comes from the risk sets' variances weighted by powers of
    time. The fit must have been asked for these (``time_moments``).
    """
    if fit.time_information is None:
        raise ValueError("fit with time_moments=True")
    g, d = fit.transformed_time, fit.events
    centre = (d * g).sum() / d.sum()
    own, once, twice = fit.time_information
    crossed = once - centre * own
    changing = twice - 2 * centre * once + centre**2 * own
    score = (g - centre) @ fit.residual_sums
    left = changing - crossed @ np.linalg.solve(own, crossed)
    rows = [
        (term, float(x), 1, chi_square_tail(float(x), 1))
        for term, x in zip(fit.columns, score**2 / np.diag(left))
    ]
    overall = float(score @ np.linalg.solve(left, score))
    rows.append(("GLOBAL", overall, len(score), chi_square_tail(overall, len(score))))
    return spark.createDataFrame(rows, "term string, chisq double, df int, p double")


def residual_ph_test(fit: CoxFit, spark: SparkSession) -> DataFrame:
    """The older approximation of ``ph_test``: the risk sets' variances are taken as equal at all times."""
    g, d = fit.transformed_time, fit.events
    total = d.sum()
    g = g - (d * g).sum() / total
    spread = (d * g**2).sum()
    u = g @ fit.residual_sums
    v = fit.variance
    rows = [
        (term, float(x), 1, chi_square_tail(float(x), 1))
        for term, x in zip(fit.columns, total * (v @ u) ** 2 / (np.diag(v) * spread))
    ]
    overall = float(total * u @ v @ u / spread)
    rows.append(("GLOBAL", overall, len(u), chi_square_tail(overall, len(u))))
    return spark.createDataFrame(rows, "term string, chisq double, df int, p double")


def schoenfeld_residuals(fit: CoxFit, train: DataFrame) -> DataFrame:
    """One row per event and predictor: scaled residual, and the coefficient it suggests.

    The table of risk-set means has one row per event time (see
    ``MAX_EVENT_TIMES``), so it is small enough to broadcast.
    """
    q = len(fit.columns)
    table = [
        (float(t), float(g), *(float(v) for v in mean))
        for t, g, mean in zip(fit.times, fit.transformed_time, fit.expected)
    ]
    schema = "time double, transformed_time double, " + ", ".join(f"_m{k} double" for k in range(q))
    means = train.sparkSession.createDataFrame(table, schema)
    events = train.filter("churned = 1").withColumn("time", F.col("survival_time").cast("double"))
    gap = [F.col(c).cast("double") - F.col(f"_m{k}") for k, c in enumerate(fit.columns)]
    total = float(fit.events.sum())

    def scaled(j: int):
        out = F.lit(0.0)
        for k in range(q):
            out = out + F.lit(float(total * fit.variance[j, k])) * gap[k]
        return out

    rows = F.array(
        *(
            F.struct(
                F.lit(term).alias("term"),
                scaled(j).alias("scaled_residual"),
                (scaled(j) + F.lit(float(fit.coefficients[j]))).alias("beta_at_time"),
            )
            for j, term in enumerate(fit.columns)
        )
    )
    return events.join(F.broadcast(means), "time").select(
        "user_id", "time", "transformed_time", F.inline(rows)
    )


def scores(train: DataFrame, beta: dict[str, float], columns: list[str], efron: bool) -> DataFrame:
    """Derivative of the partial log-likelihood by each predictor, by DataFrame functions alone.

    One row per predictor: number of rows and events, its spread, and the score. It uses nothing of the
    fit but the coefficients, so it tells whether they solve the equations. The running sums are over one
    row per day.
    """
    p = range(len(columns))
    weight = F.exp(linear_predictor({c: b for c, b in beta.items() if b != 0}))
    x = [F.col(c).cast("double") for c in columns]
    died = F.col("churned").cast("double")
    # The weight comes last: Spark rewrites what it knows of a column by every alias after it, twice as much with each.
    rows = train.select(F.col("survival_time").alias("time"), died.alias("e"), *(v.alias(f"x{k}") for k, v in zip(p, x)), weight.alias("w"))
    days = rows.groupBy("time").agg(
        F.count("*").alias("n"), F.sum("e").alias("d"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("e")).alias("lost"),
        *(F.sum(f"x{k}").alias(f"all{k}") for k in p),
        *(F.sum(F.col(f"x{k}") ** 2).alias(f"square{k}") for k in p),
        *(F.sum(F.col(f"x{k}") * F.col("e")).alias(f"dead{k}") for k in p),
        *(F.sum(F.col(f"x{k}") * F.col("w")).alias(f"s{k}") for k in p),
        *(F.sum(F.col(f"x{k}") * F.col("w") * F.col("e")).alias(f"lost{k}") for k in p),
    )
    later = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    at_risk = days.select("*", F.sum("s").over(later).alias("r"), *(F.sum(f"s{k}").over(later).alias(f"r{k}") for k in p))

    def expected(k: int):
        share = lambda i: i / F.col("d") if efron else F.lit(0.0)
        each = lambda i: (F.col(f"r{k}") - share(i) * F.col(f"lost{k}")) / (F.col("r") - share(i) * F.col("lost"))
        ties = F.sequence(F.lit(0), F.col("d").cast("int") - 1)
        return F.when(F.col("d") > 0, F.aggregate(ties, F.lit(0.0), lambda a, i: a + each(i))).otherwise(F.lit(0.0))

    total = at_risk.agg(
        F.sum("n").alias("n"), F.sum("d").cast("long").alias("n_events"),
        *(F.sum(F.col(f"dead{k}") - expected(k)).alias(f"score{k}") for k in p),
        *(F.sqrt(F.sum(f"square{k}") / F.sum("n") - (F.sum(f"all{k}") / F.sum("n")) ** 2).alias(f"sd{k}") for k in p),
    )
    cells = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"sd{k}").alias("sd"), F.col(f"score{k}").alias("score")) for k, c in zip(p, columns)))
    return total.select("n", "n_events", F.inline(cells))


def score_equations(fit: CoxFit, train: DataFrame) -> DataFrame:
    """variable, n_events and its score per event and standard deviation: 0 where the fit is the maximum."""
    beta = dict(zip(fit.columns, (float(b) for b in fit.coefficients)))
    # Per standard deviation of the predictor, as the fit sees it; a constant one has no score.
    each = F.coalesce(F.round(F.abs("score") / F.nullif("sd", F.lit(0.0)) / F.col("n_events"), 6), F.lit(0.0))
    # A predictor that depends on others solves its equation with them.
    columns = [*fit.columns, *fit.dropped]
    return scores(train, beta, columns, efron=True).select("variable", "n_events", each.alias("score"))


def optimality(path: CoxPath, train: DataFrame, alpha: float, tolerance: float = 1e-4) -> DataFrame:
    """Whether each predictor meets the optimality condition of the best penalty, to a share of that.

    A predictor in the model has the gradient that its penalties ask for, any other one a smaller one.
    """
    lam = float(path.lambdas[path.best])
    beta = dict(zip(path.columns, (float(b) for b in path.coefficients[path.best])))
    found = scores(train, beta, path.columns, efron=False)
    known = train.sparkSession.createDataFrame(list(beta.items()), "variable string, beta double")
    # In standard deviations of the predictors, as the penalty sees them; constant ones are out.
    gradient = F.coalesce(F.col("score") / F.nullif("sd", F.lit(0.0)) / F.col("n"), F.lit(0.0))
    b = F.col("beta") * F.col("sd")
    held = F.abs(gradient - F.lit(lam * alpha) * F.signum("beta") - F.lit(lam * (1 - alpha)) * b)
    free = F.greatest(F.abs(gradient) - lam * alpha, F.lit(0.0))
    off = F.when(F.col("beta") != 0, held).otherwise(free)
    return found.join(F.broadcast(known), "variable").select("variable", "n_events", (off <= tolerance * lam).alias("holds"))

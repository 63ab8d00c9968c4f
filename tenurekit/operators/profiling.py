"""Distributions: quantiles, long form, correlations, histograms, class counts."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: So many rows are put in order on the driver.
SMALL = 100_000
#: Edges that a round of narrowing takes from a sketch.
EDGES = 64


def _order_statistic(values: DataFrame, index: int, n: int, accuracy: int) -> float:
    """The value at a 0-based position of the column ``v`` in ascending order.

    A sketch proposes edges, exact counts tell between which of them the position lies, and the rows
    between those go into the next round, about a hundredth each time. Edges are values of the column,
    so a round ends at a value that fills the position or leaves fewer rows.
    """
    v, inside, before = F.col("v"), values, 0
    while n > SMALL:
        shares = F.array(*(F.lit(k / EDGES) for k in range(EDGES + 1)))
        sketch, least, most = inside.agg(
            F.percentile_approx("v", shares, accuracy), F.min("v"), F.max("v")
        ).first()
        edges = sorted({*sketch, least, least / 2 + most / 2, most})
        counts = inside.agg(
            *(F.count_if(v < e) for e in edges), *(F.count_if(v <= e) for e in edges)
        ).first()
        low, high = None, None
        for e, less, upto in zip(edges, counts[: len(edges)], counts[len(edges) :]):
            if before + less <= index < before + upto:
                return e
            if before + upto <= index:
                low, under = e, upto
            elif high is None:
                high, over = e, less
        under, over = under if low is not None else 0, over if high is not None else n
        inside = inside.filter(F.lit(low is None) | (v > F.lit(low))).filter(
            F.lit(high is None) | (v < F.lit(high))
        )
        before, n = before + under, over - under
    rows = inside.groupBy("v").agg(F.count("*").alias("c")).toArrow().to_pandas().sort_values("v")
    return float(rows["v"].iloc[int(rows["c"].cumsum().searchsorted(index - before, side="right"))])


def exact_quantile(
    df: DataFrame, column: str, probability: float, accuracy: int = 10_000
) -> float | None:
    """Exact interpolated quantile of a numeric column; pass a materialised frame.

    Spark's exact percentile keeps every different value in one buffer, which does not fit for a
    column with a value per user. The two order statistics that matter are found by narrowing.
    """
    value = F.col(column).cast("double")
    values = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = values.count()
    if n == 0:
        return None
    position = (n - 1) * probability
    index = int(position)
    first = _order_statistic(values, index, n, accuracy)
    weight = position - index
    if weight == 0:
        return first
    second = _order_statistic(values, min(index + 1, n - 1), n, accuracy)
    return first * (1 - weight) + second * weight


def unpivot_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: one row per feature and value."""
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot(
        [], columns, "feature", "value"
    )


def feature_histograms(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Equal-width counts per feature, each on its own range; the top value is in the last bin.

    Ranges come from one wide aggregate; then each row gives an array of bins, counted on the map side.
    """
    numeric = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    ends = numeric.agg(
        *(F.min(c).alias(f"lo{k}") for k, c in enumerate(columns)),
        *(F.max(c).alias(f"hi{k}") for k, c in enumerate(columns)),
    ).first()
    placed = []
    for k, c in enumerate(columns):
        low, high = ends[f"lo{k}"], ends[f"hi{k}"]
        if low is None:
            continue
        if high > low:
            step = F.floor(F.lit(float(bins)) * (F.col(c) - F.lit(low)) / F.lit(high - low))
            place = F.least(step + 1, F.lit(bins))
        else:
            place = F.lit(1)
        place = F.when(F.col(c).isNotNull(), place.cast("long"))
        placed.append(F.struct(F.lit(c).alias("feature"), place.alias("bin")))
    if not placed:
        return numeric.sparkSession.createDataFrame([], "feature string, bin long, n long")
    return (
        numeric.select(F.inline(F.array(*placed)))
        .filter("bin IS NOT NULL")
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("n"))
    )


def churn_distribution(survival: DataFrame) -> DataFrame:
    return survival.groupBy("churned").agg(F.count("*").alias("n"))

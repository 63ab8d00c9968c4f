"""Scalar column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` as double, NULL where the bottom is zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def total(columns: Iterable[str]) -> Column:
    """Sum of columns; NULL as soon as one of them is NULL."""
    return F.expr(" + ".join(f"`{c}`" for c in columns))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start).cast("long")


def capped(value: Column, cap: Column) -> Column:
    """The smaller of the two; NULL stays NULL, which ``least`` would skip."""
    return F.when(value.isNotNull() & cap.isNotNull(), F.least(value, cap))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def is_finite(column: str, dtype: str) -> Column:
    """True for a present, ordinary number."""
    c = F.col(column)
    if dtype in ("double", "float"):
        inf = F.lit(float("inf"))
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != inf)
    return c.isNotNull()


def bools_to_double(df: DataFrame) -> DataFrame:
    """Every boolean column as 0.0 / 1.0, the rest untouched."""
    return df.select(
        *(F.col(c).cast("double").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes)
    )


def whole_number(text: Column) -> Column:
    """Text to integer, also for texts such as ``4.0``; halves go away from zero."""
    return F.round(text.cast("double")).cast("int")


def hash_fraction_bits(key: Column, seed: int, hex_digits: int) -> Column:
    """Leading hex digits of md5(``key:seed``) as a number; equal in any engine with md5."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("long")

"""Train and test rows, exact-size samples, folds: all pure functions of row and seed."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.functions.expressions import hash_fraction_bits

#: Digits of a round, so at most 65,536 buckets; digits of a hash; rows that may be put in order.
SAMPLE_HEX_DIGITS = 4
MD5_DIGITS = 32
FEW_ROWS = 4096


def time_split(df: DataFrame, train_join_end: date) -> DataFrame:
    """``is_train`` for users who joined by the split date."""
    return df.withColumn("is_train", F.col("join_date") <= F.lit(train_join_end))


def min_tenure(df: DataFrame, years: float | None) -> DataFrame:
    return df if years is None else df.filter(F.col("tenure_years") >= years)


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "user_id") -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer): those with the smallest md5 of ``key:seed``.

    Rows are counted by the leading hex digits of their hash, which gives the bucket with the last row
    taken; if it is large, that bucket by its next digits, and so on until it holds few rows. Only these
    are put in order to find the last hash; everything else is a filter. Memory depends on the number of
    buckets and ``FEW_ROWS``, not on the rows.
    """
    if n <= 0:
        return df.limit(0)
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    hashes = df.select(digest.alias("h"))
    prefix, left = "", n
    while True:
        start = F.substring("h", len(prefix) + 1, SAMPLE_HEX_DIGITS).alias("digits")
        inside = hashes.filter(F.col("h").startswith(prefix)) if prefix else hashes
        for digits, count in sorted(inside.groupBy(start).count().collect()):
            if count >= left:
                break
            left -= count
        else:
            return df
        prefix += digits
        if count <= FEW_ROWS or len(prefix) >= MD5_DIGITS:
            break
    at_cut = hashes.filter(F.col("h").startswith(prefix))
    if count <= FEW_ROWS:
        ordered = at_cut.orderBy("h").limit(left).agg(F.max("h").alias("h"), F.collect_list("h").alias("all")).first()
        last, equal = ordered["h"], ordered["all"].count(ordered["h"])
        more = at_cut.filter(F.col("h") == last).limit(equal + 1).count() > equal
    else:
        last, equal, more = prefix, left, count > left
    if not more:
        return df.filter(digest <= last)
    # Rows of one key have one hash; any of them will do.
    return df.filter(digest < last).unionByName(df.filter(digest == last).limit(equal))


def with_folds(df: DataFrame, k: int, seed: int, key: str = "user_id") -> DataFrame:
    """``fold`` in 0 .. k-1 from the key, so a user has the same fold in every fit."""
    return df.withColumn("fold", (hash_fraction_bits(F.col(key), seed, 8) % k).cast("int"))

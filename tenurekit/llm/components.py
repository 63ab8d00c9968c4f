"""Connected components of links between integer nodes, by large and small stars over tables.

Each round joins a node's neighbours to the smallest node near it; the links of a round replace those
of the round before, and the number of rounds grows with the logarithm of a component's size. Links
stay a table all the time; only the count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenurekit.llm.common import drop, stored

MOST_ROUNDS = 60


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("b"), F.col("m").alias("a")).filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).filter("a < b")
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    joined = down.join(least, "b")
    tied = joined.filter("m < a").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return tied.unionByName(least.select("b", F.col("m").alias("a"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of a link (a, b) but the smallest ones themselves."""
    spark = links.sparkSession
    shape = "CAST(a AS BIGINT) a", "CAST(b AS BIGINT) b"
    now, path = stored(links.filter("a <> b").selectExpr(*shape).distinct(), "links")
    before = None
    for _ in range(MOST_ROUNDS):
        seen, next_path = stored(_small_star(_large_star(now)).selectExpr(*shape), "links")
        count, tally = seen.selectExpr("count(*)", "sum(CAST(xxhash64(a, b) AS DECIMAL(38, 0)))").first()
        drop(spark, path)
        now, path = seen, next_path
        if (count, tally) == before:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        before = count, tally
    raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")

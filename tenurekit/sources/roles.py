"""The study's tables bound to the TPC-H-like tables used for tests and benchmarks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.columns import COMPLIMENTS, SINCE
from tenurekit.config import StudyConfig

ROLE_STUDY = StudyConfig(
    category="promo",
    window_start=date(1995, 1, 1),
    window_end=date(2000, 12, 31),
    last_join=date(1999, 12, 31),
    train_join_end=date(1997, 12, 31),
)


# Declared, so that opening a table needs no job that reads file footers.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def all_businesses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS business_id",
        "p_name AS name",
        "concat(p_type, ', ', p_name) AS categories",
        "CAST(1 + p_size % 5 AS DECIMAL(3,2)) AS stars",
    )


def kept_businesses(spark: SparkSession, folder: str) -> DataFrame:
    return all_businesses(spark, folder).filter(
        F.col("categories").ilike(f"%{ROLE_STUDY.category}%")
    )


def _order_lines(spark: SparkSession, folder: str, keep: str = "true") -> DataFrame:
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    return lines.filter(keep).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def all_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return _order_lines(spark, folder).selectExpr(
        "o_custkey AS user_id",
        "l_partkey AS business_id",
        "l_orderkey",
        "l_linenumber",
        "CAST(l_shipdate AS DATE) AS date",
        "CAST(l_quantity AS INT) AS useful_per_review",
        "CAST(l_linenumber AS INT) AS funny_per_review",
        "CAST(round(l_discount * 100) AS INT) - 1 AS cool_per_review",
    )


def all_tips(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    return urgent.selectExpr(
        "o_orderkey AS tip_key", "o_custkey AS user_id", "CAST(o_orderdate AS DATE) AS date"
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    first, *others = COMPLIMENTS
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS user_id",
        "c_name AS name",
        f"date_add(DATE '1994-01-01', CAST((c_custkey * 37) % 2000 AS INT)) AS {SINCE}",
        f"CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(c_custkey % 4 AS INT) END AS {first}",
        *(f"CAST((c_custkey * {k}) % 4 AS INT) AS {c}" for k, c in enumerate(others, start=2)),
    )


def user_friends(spark: SparkSession, folder: str) -> DataFrame:
    returned = _order_lines(spark, folder, "l_returnflag = 'R'")
    return returned.selectExpr("o_custkey AS user_id", "l_suppkey AS friend_id").distinct()


def user_elite_years(spark: SparkSession, folder: str) -> DataFrame:
    dear = table(spark, folder, "orders").filter("o_totalprice > 450000")
    return dear.selectExpr(
        "o_custkey AS user_id", "CAST(year(o_orderdate) AS INT) AS elite_year"
    ).distinct()


def role_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables the study works on, reviews already limited to kept businesses."""
    kept = kept_businesses(spark, folder).select("business_id")
    return {
        "users": users(spark, folder),
        "user_friends": user_friends(spark, folder),
        "user_elite_years": user_elite_years(spark, folder),
        "reviews": all_reviews(spark, folder).join(kept, "business_id"),
        "tips": all_tips(spark, folder),
    }

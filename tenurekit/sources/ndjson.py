"""Newline-delimited JSON files to typed tables.

Every field is read as text under an explicit schema, so no inference pass is
needed, and then cast. A malformed line or an impossible cast fails the job, or,
on request, bad lines are kept in a table beside the good rows (``SetAside``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenurekit.columns import COMPLIMENTS, SINCE
from tenurekit.functions.expressions import whole_number
from tenurekit.operators.cleaning import require_key
from tenurekit.operators.numbering import number_rows
from tenurekit.session import cut_lineage

# Fields of the input files, in file order.
BUSINESS_FIELDS = (
    "business_id", "name", "city", "state", "postal_code", "latitude", "longitude",
    "stars", "review_count", "is_open", "categories",
)
USER_FIELDS = (
    "user_id", "name", SINCE, "review_count", "average_stars", "fans", "useful", "funny",
    "cool", *COMPLIMENTS, "friends", "elite",
)
REVIEW_FIELDS = (
    "review_id", "user_id", "business_id", "stars", "date", "text", "useful", "funny", "cool",
)
TIP_FIELDS = ("user_id", "business_id", "text", "date", "compliment_count")
FILE_NAMES = {
    "business": "business.json",
    "user": "user.json",
    "review": "review.json",
    "tip": "tip.json",
}


#: What the scans cast fields to; a text that doesn't fit makes a line bad where these are set aside.
KINDS = {
    "latitude": "double", "longitude": "double", "average_stars": "decimal(3,2)", SINCE: "date", "date": "date",
    **{c: "double" for c in ("stars", "review_count", "fans", "useful", "funny", "cool", "compliment_count", *COMPLIMENTS)},
}
_LINE = "bad_line"


def read_fields(spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
    """The named fields of each line as text; absent ones are NULL."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


Reader = Callable[[SparkSession, str, tuple[str, ...]], DataFrame]


@dataclass(frozen=True)
class SetAside:
    """Reads files once into ``folder``: rows that all casts accept, and the other lines with a reason.

    Each file becomes a table in two parts, so the rows and the bad lines of a file add up to its lines.
    Blank lines are no lines. A file is read and split anew at every ``read``.
    """

    folder: str

    def read(self, spark: SparkSession, path: str, fields: tuple[str, ...]) -> DataFrame:
        text = [T.StructField(f, T.StringType()) for f in (*fields, _LINE)]
        lines = (
            spark.read.schema(T.StructType(text)).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", _LINE).json(path)
        )
        unfit = [
            F.when(F.col(f).isNotNull() & F.col(f).try_cast(kind).isNull(), F.lit(f))
            for f, kind in KINDS.items() if f in fields
        ]
        reason = F.when(F.col(_LINE).isNotNull(), F.lit("not JSON")).otherwise(F.coalesce(*unfit, F.lit(None)))
        kept = F.when(F.col("reason").isNull(), "rows").otherwise("bad")
        # The line itself is at hand for what is not JSON; otherwise the fields say it.
        line = F.coalesce(F.col(_LINE), F.to_json(F.struct(*fields)))
        split = lines.withColumn("reason", reason).withColumn("part", kept)
        split = split.withColumn(_LINE, F.when(F.col("part") == "bad", line))
        place = f"{self.folder.rstrip('/')}/{path.rstrip('/').rsplit('/', 1)[-1]}"
        split.write.mode("overwrite").partitionBy("part").parquet(place)
        return self._table(spark, place).filter("part = 'rows'").select(*fields)

    @staticmethod
    def _table(spark: SparkSession, place: str) -> DataFrame:
        return spark.read.parquet(place)

    def _tables(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        found = None
        for path in paths:
            name = path.rstrip("/").rsplit("/", 1)[-1]
            table = self._table(spark, f"{self.folder.rstrip('/')}/{name}")
            here = table.select(F.lit(name).alias("file"), "part", "reason", F.col(_LINE).alias("line"))
            found = here if found is None else found.unionByName(here)
        return found

    def bad_lines(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """file, reason (the field that doesn't fit, or ``not JSON``) and line."""
        return self._tables(spark, paths).filter("part = 'bad'").drop("part")

    def line_counts(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        """file, lines, kept and bad ones; read from the stored parts, not from the files."""
        return self._tables(spark, paths).groupBy("file").agg(
            F.count("*").alias("n_lines"),
            F.count_if(F.col("part") == "rows").alias("n_rows"),
            F.count_if(F.col("part") == "bad").alias("n_bad"),
        )


def _number(name: str, alias: str | None = None) -> Column:
    return whole_number(F.col(name)).alias(alias or name)


def in_category(column: str, category: str) -> Column:
    """True where the text holds the category, in any case; no character of it is a wildcard."""
    return F.lower(F.col(column)).contains(F.lower(F.lit(category)))


def scan_businesses(spark: SparkSession, path: str, category: str, read: Reader = read_fields) -> DataFrame:
    """Typed businesses of one category, matched anywhere in the text, in any case."""
    return read(spark, path, BUSINESS_FIELDS).filter(in_category("categories", category)).select(
        "business_id", "name", "city", "state", "postal_code",
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("stars").cast("decimal(3,2)").alias("stars"),
        _number("review_count"),
        (F.col("is_open") == "1").alias("is_open"),
        "categories",
    )


def scan_users(spark: SparkSession, path: str, read: Reader = read_fields) -> DataFrame:
    """Typed users, with the friend and elite lists still as text."""
    return read(spark, path, USER_FIELDS).select(
        "user_id", "name",
        F.col(SINCE).cast("date").alias(SINCE),
        _number("review_count"),
        F.col("average_stars").cast("decimal(3,2)").alias("average_stars"),
        _number("fans"),
        _number("useful", "useful_user_sent"),
        _number("funny", "funny_user_sent"),
        _number("cool", "cool_user_sent"),
        *(_number(c) for c in COMPLIMENTS),
        F.col("friends").alias("friends_json"),
        F.col("elite").alias("elite_json"),
    )


def of_businesses(facts: DataFrame, businesses: DataFrame) -> DataFrame:
    """Rows of the listed businesses; a business listed twice doubles its rows.

    No broadcast hint: Spark broadcasts the ids while they are small by its own
    measured size and otherwise joins by shuffle, splitting skewed businesses.
    """
    return facts.join(businesses.select("business_id"), "business_id")


def scan_reviews(spark: SparkSession, path: str, businesses: DataFrame, read: Reader = read_fields) -> DataFrame:
    """Typed reviews of the listed businesses."""
    reviews = read(spark, path, REVIEW_FIELDS).select(
        "review_id", "user_id", "business_id",
        _number("stars"),
        F.col("date").cast("date").alias("date"),
        "text",
        _number("useful", "useful_per_review"),
        _number("funny", "funny_per_review"),
        _number("cool", "cool_per_review"),
    )
    return of_businesses(reviews, businesses).select(*reviews.columns)


def scan_tips(spark: SparkSession, path: str, businesses: DataFrame, read: Reader = read_fields) -> DataFrame:
    """Typed tips of the listed businesses, numbered in the order of their content."""
    tips = read(spark, path, TIP_FIELDS).select(
        "user_id", "business_id", "text",
        F.col("date").cast("date").alias("date"),
        _number("compliment_count"),
    )
    order = ["user_id", "business_id", "date", "text", "compliment_count"]
    return number_rows(of_businesses(tips, businesses), order, "tip_id").select(
        "tip_id", *tips.columns
    )


def split_list(df: DataFrame, column: str, item: str) -> DataFrame:
    """One row per entry of a comma-separated text; blanks around and empty entries go."""
    parts = df.filter(F.col(column).isNotNull()).withColumn(item, F.explode(F.split(column, ",")))
    return parts.withColumn(item, F.trim(item)).filter(F.col(item) != "").drop(column)


def extract_years(df: DataFrame, column: str, year: str) -> DataFrame:
    """One row per run of four digits in a text."""
    found = F.regexp_extract_all(column, F.lit("[0-9]{4}"), 0)
    return (
        df.filter(F.col(column).isNotNull())
        .withColumn(year, F.explode(found))
        .withColumn(year, F.col(year).cast("int"))
        .drop(column)
    )


def user_friends(users: DataFrame) -> DataFrame:
    return split_list(users.select("user_id", "friends_json"), "friends_json", "friend_id")


def user_elite_years(users: DataFrame) -> DataFrame:
    return extract_years(users.select("user_id", "elite_json"), "elite_json", "elite_year")


def load_tables(
    spark: SparkSession, paths: dict[str, str], category: str, aside: SetAside | None = None
) -> dict[str, DataFrame]:
    """All five tables from the four files (``business``, ``user``, ``review``, ``tip``).

    A bad line fails the load, or goes to ``aside``.

    Businesses and users are stored once: two and three tables come from them.
    """
    read = aside.read if aside else read_fields
    businesses = cut_lineage(scan_businesses(spark, paths["business"], category, read))
    users = cut_lineage(require_key(scan_users(spark, paths["user"], read)))
    return {
        "users": users.drop("friends_json", "elite_json"),
        "user_friends": user_friends(users),
        "user_elite_years": user_elite_years(users),
        "reviews": require_key(scan_reviews(spark, paths["review"], businesses, read)),
        "tips": require_key(scan_tips(spark, paths["tip"], businesses, read)),
    }


def paths_in(folder: str, names: dict[str, str] | None = None) -> dict[str, str]:
    """File paths of one folder; ``names`` overrides the default file names."""
    return {k: f"{folder.rstrip('/')}/{v}" for k, v in {**FILE_NAMES, **(names or {})}.items()}

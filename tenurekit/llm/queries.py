"""The operators as queries over whole tables: ``name -> f(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenurekit.llm import oracle
from tenurekit.llm.common import table
from tenurekit.llm.decontamination import contamination
from tenurekit.llm.epsilon_join import near_vectors
from tenurekit.llm.language import identify
from tenurekit.llm.lexical_search import ranked_search
from tenurekit.llm.licences import scan
from tenurekit.llm.minhash import near_duplicates
from tenurekit.llm.packing import pack
from tenurekit.llm.personal_data import personal_data
from tenurekit.llm.quality import score_documents
from tenurekit.llm.suffix_index import remove_repeats
from tenurekit.llm.token_counts import token_counts
from tenurekit.llm.vector_codes import compress
from tenurekit.llm.word_repeats import remove_repeated_words

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {
    "op2_epsilon_join": oracle.NEAR_VECTORS,
    "op6_near_duplicates": oracle.NEAR_DUPLICATES,
    "op8_licences": oracle.LICENCES,
    "op9_decontamination": oracle.DECONTAMINATION,
    "op11_vector_codes": oracle.VECTOR_CODES,
    "op12_lexical_search": oracle.RANKED_SEARCH,
    "op13_word_repeats": oracle.WORD_REPEATS,
}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query
def op2_epsilon_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a made-up tree: sources, then directories by ranges of ids; some are licence files."""
    files = table(spark, sf_dir, "documents").selectExpr("doc_id AS file_id", f"{oracle.FILE_PATH} AS path", "text")
    return scan(files).withColumnRenamed("file_id", "doc_id")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))

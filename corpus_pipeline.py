"""The corpus pipeline: stages of the operators over documents, each written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenurekit.llm.common import stored, table
from tenurekit.llm.decontamination import contamination
from tenurekit.llm.minhash import grouped
from tenurekit.llm.packing import pack
from tenurekit.llm.personal_data import candidates, fit_spans, redacted
from tenurekit.llm.quality import CUT, fit_quality, quality_score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from labelled ones among them, doesn't reject.

    Null texts are scored as empty ones; an empty table stays empty.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality_score(model, F.col("text")) >= CUT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Documents without an id, with null or empty texts stay; a document is told by its id and text
    together, and repeated rows of both become one; an empty table stays empty.
    """
    kept = grouped(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"].cast("string")) == kept["kept_key"])
    return docs.join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too many benchmark words; a document is told by its id and text together.

    Null and empty texts have no words and stay, as repeated rows do; an empty table stays empty.
    """
    judged = contamination(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    bad = judged.filter("contaminated").select(F.col("doc_id").alias("bad_key")).distinct()
    return docs.join(bad, F.xxhash64(docs["doc_id"], docs["text"]) == bad["bad_key"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked; null texts and repeated rows stay as they are."""
    found, _ = stored(candidates(docs), "span-candidates")
    clean = docs.withColumn("text", redacted(fit_spans(found), F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with what is left: one row per piece."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Trained models, tokenizer ids and sketches have no SQL form; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

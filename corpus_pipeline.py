"""From raw documents to token ids: language ID, near-dedup, repeated passages, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Rows with null ids or texts go through every stage like others: a
null or empty text has no language, so it leaves at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontam, langid, near_dedup, suffix_dedup
from tidemark.llm.catalog import table, vocabulary
from tidemark.llm.common import fold, staged
from tidemark.session import ship


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows as one column, in which an operator finds the text."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters go."""
    ship(spark)
    model = langid.train(docs, vocabulary("piece_bpe_32k.model"), fold(F.col("doc_id"), 4) != 2)
    found = langid.predict(_rows(docs), model, id_col="row")
    return found.where(F.col("lang_pred") != "und").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest id, and of several texts under it the first by digest."""
    ship(spark)
    found = near_dedup.classes(docs)
    kept = found.groupBy("class_key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.col("digest").alias("m"))).alias("x")).select("x.*")
    keyed = docs.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias("_d"), F.md5(F.coalesce("text", F.lit(""))).alias("_m"))
    same = keyed.join(kept, (F.col("_d") == F.col("d")) & (F.col("_m") == F.col("m")), "left_semi")
    return same.dropDuplicates(["_d", "_m"]).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stood earlier."""
    ship(spark)
    return suffix_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship(spark)
    found = decontam.occurrences(_rows(docs), table(spark, sf_dir, "benchmark"), id_col="row")
    return found.where(F.size("items") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text again."""
    ship(spark)
    found = bpe.encode(_rows(docs), vocabulary("byte_bpe_50k.json"), id_col="row", check=True)
    return found.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("tokens", tokens)]

#: Language likelihoods, sampling, suffixes and token ids have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

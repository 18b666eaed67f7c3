"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir), where docs is a plain scan of files, and returns a DataFrame. All but the last
return the columns of the documents, whatever these are; columns whose names an operator uses itself do no harm. An
empty table gives an empty result. Rows are known by their file and their place in it, so repeated rows, repeated ids
and null ids are documents of their own: no rule below merges documents by id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import BATCH_ROWS, Stage, fresh, numbered, rows_of
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.near import near_copies
from tidemark.llm.packing import TEXTS, pack
from tidemark.llm.substring_dedup import cut_documents
from tidemark.llm.toxicity import reject_toxic


def _few_texts(spark: SparkSession) -> None:
    """From here on so many whole texts go to Python at a time. A stage's last step runs when its result is written, so
    this is not taken back when the stage returns."""
    spark.conf.set(BATCH_ROWS, TEXTS)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose number is not in gone(row)."""
    row, columns = fresh(docs, "row"), [F.col(f"`{c}`") for c in docs.columns]
    return rows_of(numbered(docs, Stage(docs.sparkSession, "stage"), *columns, scan=True, name=row), gone, False, row).select(*columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts stay; equal texts share their fate; a text of any
    length is scored whole; without labels nothing goes."""
    _few_texts(spark)
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the one with the largest doc_id (null before any other), of
    repeated ids the smallest row number. Null and empty texts are one group."""
    _few_texts(spark)
    gone = Stage(spark, "stage").table(exact_dedup(docs, scan=True).where("not kept").select("row"), "gone")
    return _without(docs, gone)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles stays: the one with the
    smallest doc_id (null before any other), of repeated ids the smallest row number. Texts without words, or null,
    are one group."""
    _few_texts(spark)
    return _without(docs, near_copies(docs, scan=True))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 words that starts earlier too go from the texts. Every document stays, also with
    an empty text; null stays null."""
    _few_texts(spark)
    return cut_documents(docs, scan=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; null and empty texts are one token."""
    _few_texts(spark)
    return pack(docs).drop("row")

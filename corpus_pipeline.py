"""The corpus pipeline: toxicity, exact, near and substring duplicates, packing.

The stages are in ``tidemark.llm.stages``. Each result is written as Parquet and read again as the next stage's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import Stage

STAGES = [
    ("toxicity", stages.toxicity),
    ("exact dedup", stages.exact_copies),
    ("SimHash near-dedup", stages.near_duplicates),
    ("substring dedup", stages.repeated_passages),
    ("best-fit packing", stages.packing),
]

#: SQL can express neither the trained classifier nor the packing; tests/llm compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents; each result is written to the shared folder and read again."""
    shared, docs = Stage(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs

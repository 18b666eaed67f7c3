"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str, order: list, single: bool = True) -> None:
    """Rows in the order given. ``single`` puts a report into one file; large tables are better sorted by range."""
    out = df.orderBy(*order)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).csv(path)


def write_named_csv(df: DataFrame, folder: str, name: str, order: list) -> None:
    """One file of that name in a folder of reports: written beside it by one task, then moved."""
    spark, part = df.sparkSession, f"{folder}/_{name}"
    write_csv(df, part, order)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = next(f.getPath() for f in fs.listStatus(path(part)) if f.getPath().getName().startswith("part-"))
    fs.rename(written, path(f"{folder}/{name}"))
    fs.delete(path(part), True)


def write_json_artifact(spark: SparkSession, values: dict, path: str) -> None:
    spark.createDataFrame([values]).coalesce(1).write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1).write.mode("overwrite").text(path)

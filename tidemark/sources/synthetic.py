"""Seeded synthetic series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.scan import PART, Fold, scan


class Walk(Fold):
    """Running sums of a column, added up step by step."""

    def __init__(self, c: str):
        self.c = c

    def summarise(self, summary, rows, part):
        return self.carry(summary, np.cumsum(rows.column(self.c).to_numpy())[-1])

    def carry(self, state, summary):
        return float((state or 0.0) + summary)

    def apply(self, state, rows, part):
        steps = rows.column(self.c).to_numpy().copy()
        steps[0] += state or 0.0
        at = np.cumsum(steps)
        return [pa.array(at)], float(at[-1])


def normal_walk(spark: SparkSession, n: int, series: int = 1, seed: int = 0, drift: float = 0.0) -> DataFrame:
    """series, t, x: running sums of normal steps. The range's partitions are in order as they are made, so a long series
    is many tasks, and none sorts or holds its rows."""
    d = spark.range(n * series).select((F.col("id") / n).cast("long").alias("series"), (F.col("id") % n).alias("t"), (F.randn(seed) + drift).alias("e"), F.spark_partition_id().alias(PART))
    return scan(d, ["series"], Walk("e"), "x double", ["series", "t"])


def square_wave(spark: SparkSession, n: int, period: int, height: float = 1.0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("t"), F.when(F.col("id") % period < period / 2, height).otherwise(-height).alias("x"))


def sigmoid_follower(leader: DataFrame, lag: int = 1, scale: float = 1.0, noise: float = 0.1, seed: int = 1) -> DataFrame:
    """Adds y: a squashed copy of x some steps later, with noise."""
    w = Window.partitionBy("series").orderBy("t")
    return leader.withColumn("y", scale / (1 + F.exp(-F.lag("x", lag).over(w))) + noise * F.randn(seed))


def cointegrated_pair(spark: SparkSession, n: int, slope: float = 1.0, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """t, x, y with y - slope * x stationary."""
    return normal_walk(spark, n, seed=seed).select("t", F.col("x"), (slope * F.col("x") + noise * F.randn(seed + 1)).alias("y"))

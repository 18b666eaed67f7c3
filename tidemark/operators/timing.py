"""Times of the phases of a pipeline."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Window, functions as F


def shares(log: DataFrame) -> DataFrame:
    """phase, module, seconds, percent of df(phase, module, seconds), which has a row a timing: sums and their share of the whole."""
    sums = log.groupBy("phase", "module").agg(F.sum("seconds").alias("seconds"))
    return sums.withColumn("percent", 100 * F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))  # one row a phase and module


def by_module(log: DataFrame) -> DataFrame:
    return log.groupBy("module").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("n"))


class PhaseTimer:
    """Collects (phase, module, detail, seconds) on the driver; ``table`` adds each one's share."""

    def __init__(self, clock=time.perf_counter):
        self.clock, self.records, self.began = clock, [], clock()

    @contextmanager
    def phase(self, phase: str, module: str, detail: str = ""):
        at = self.clock()
        try:
            yield
        finally:
            self.records.append((phase, module, detail, self.clock() - at))

    def total(self) -> float:
        return sum(r[3] for r in self.records)

    def table(self, spark) -> DataFrame:
        whole = self.total() or 1.0
        return spark.createDataFrame([(*r, 100 * r[3] / whole) for r in self.records], "phase string, module string, detail string, seconds double, percent double")

    def by_module(self, spark) -> DataFrame:
        return self.table(spark).groupBy("module").agg(F.sum("seconds").alias("seconds")).orderBy(F.desc("seconds"))

    def report(self) -> str:
        """The text report: a line a phase, the total last."""
        whole = self.total() or 1.0
        lines = [f"{p:<24}{m:<16}{s:>10.3f} s{100 * s / whole:>7.1f} %" for p, m, _, s in self.records]
        return "\n".join([*lines, f"{'total':<40}{self.total():>10.3f} s"])

    def save(self, spark, folder: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/timings")
        spark.createDataFrame([(x,) for x in self.report().split("\n")], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")

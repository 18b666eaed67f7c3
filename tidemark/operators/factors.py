"""Cross-sectional factors, as functions from an ordered window to a column; a registry of named factors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from tidemark.functions import windows as W

FACTORS = {}


def factor(name: str):
    """Registers make(window) -> Column."""

    def register(make):
        FACTORS[name] = make
        return make

    return register


@factor("mean_reversion")
def mean_reversion(w: WindowSpec, c: str = "monthly", k: int = 252):
    """The last monthly return against its trailing mean, in sample deviations."""
    return F.try_divide(F.col(c) - W.rolling_mean(c, w, k, k), F.nullif(W.rolling_std(c, w, k, k), F.lit(0.0)))


@factor("dollar_volume")
def dollar_volume(w: WindowSpec, k: int = 30):
    return W.rolling(F.avg, F.col("close") * F.col("volume"), w, k, k)


def screened(df: DataFrame, value: str, by: str, top: int, n: int) -> DataFrame:
    """Adds rank (of the value, highest first), longs and shorts over all names of a date; then keeps the date's ``top`` names by ``by``."""
    g = Window.partitionBy("ts")
    known = df.where(F.col(value).isNotNull())
    d = known.withColumn("rank", F.row_number().over(g.orderBy(F.desc(value), "ticker"))).withColumn("_l", F.row_number().over(g.orderBy(value, "ticker"))).withColumn("_v", F.row_number().over(g.orderBy(F.desc(by), "ticker")))
    return d.withColumn("longs", F.col("_l") <= n).withColumn("shorts", F.col("rank") <= n).where(F.col("_v") <= top).drop("_l", "_v")

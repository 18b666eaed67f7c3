"""Reshaping, cleaning and splitting of panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import windows as W
from tidemark.functions.stats import exact_quantiles


def ticker_order(tickers: list[str]) -> list[str]:
    """By the number after the last underscore, then by name."""
    return sorted(tickers, key=lambda t: (int(t.rpartition("_")[2]) if t.rpartition("_")[2].isdigit() else 0, t))


def to_wide(df: DataFrame, target: str, tickers: list[str]) -> DataFrame:
    """ts, close of the target, f1..fk of the others in ticker order, volume of the target.

    The tickers are named, so that the pivot needs no extra pass; a missing target is an error.
    """
    if target not in tickers:
        raise ValueError(f"target {target!r} is not among the tickers")
    others = [t for t in ticker_order(tickers) if t != target]
    wide = df.groupBy("ts").pivot("ticker", tickers).agg(F.max("close").alias("c"), F.max("volume").alias("v"))
    return wide.select("ts", F.col(f"`{target}_c`").alias("close"), *[F.col(f"`{t}_c`").alias(f"f{i + 1}") for i, t in enumerate(others)], F.col(f"`{target}_v`").alias("volume"))


def to_long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.unpivot([key], columns, "name", "value")


def deduplicate(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row per key, the first or the last by the order given; or, with ``none``, only keys that have one row."""
    if keep == "none":
        return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")
    by = [F.desc(o) if keep == "last" else F.asc(o) for o in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, missing, percent of columns that miss values; one pass."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return sums.unpivot(["_n"], columns, "name", "missing").where("missing > 0").select("name", "missing", (100.0 * F.col("missing") / F.col("_n")).alias("percent"))


def grid(df: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """Every key at every time that any key has; keys are few, times many, so the keys are gathered once and exploded."""
    keys = df.agg(F.sort_array(F.collect_set(key)).alias("k"))
    return df.select(ts).distinct().join(F.broadcast(keys)).select(F.explode("k").alias(key), ts).join(df, [key, ts], "left")


def winsorise(df: DataFrame, c: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    least, most = exact_quantiles(df, c, [low, high])
    return df.withColumn(c, F.least(F.greatest(F.col(c), F.lit(least)), F.lit(most)))


def scaled(df: DataFrame, c: str, how: str) -> DataFrame:
    """Adds ``scaled``: minmax, sample or population standardisation; the scalars come from one aggregation."""
    pick = {"minmax": (F.min(c), F.max(c) - F.min(c)), "sample": (F.avg(c), F.stddev_samp(c)), "population": (F.avg(c), F.stddev_pop(c))}[how]
    s = df.agg(pick[0].alias("_a"), pick[1].alias("_b"))
    return df.join(F.broadcast(s)).withColumn("scaled", F.try_divide(F.col(c) - F.col("_a"), F.nullif("_b", F.lit(0.0)))).drop("_a", "_b")


def within_sigmas(df: DataFrame, c: str, k: float) -> DataFrame:
    """Rows within k sample deviations of the mean; the others go."""
    s = df.agg(F.avg(c).alias("_a"), F.stddev_samp(c).alias("_b"))
    return df.join(F.broadcast(s)).where(F.abs(F.col(c) - F.col("_a")) <= k * F.col("_b")).drop("_a", "_b")


def numbered(df: DataFrame, key: str = "ticker", ts: str = "ts") -> DataFrame:
    w = Window.partitionBy(key)
    return df.withColumn("bar", F.row_number().over(w.orderBy(ts))).withColumn("n", F.count(F.lit(1)).over(w))


def chronological(df: DataFrame, test: float = 0.2, val: float = 0.1, **keys) -> DataFrame:
    """part: train, val or test by place in each series."""
    d = numbered(df, **keys)
    return d.withColumn("part", F.when(F.col("bar") <= F.floor(F.col("n") * F.lit(1 - test - val)), "train").when(F.col("bar") <= F.floor(F.col("n") * F.lit(1 - test)), "val").otherwise("test"))


def last_year(df: DataFrame, ts: str = "ts", years: int = 1) -> Column:
    """Whether a row is in the last years of the table: the greatest time is one scalar, broadcast."""
    end = df.agg((F.max(ts) - F.expr(f"INTERVAL {years} YEAR")).alias("_cut"))
    return df.join(F.broadcast(end)).withColumn("part", F.when(F.col(ts) <= F.col("_cut"), "train").otherwise("test")).drop("_cut")


def one_hot(df: DataFrame, c: str, values: list, prefix: str) -> DataFrame:
    return df.select("*", *[F.when(F.col(c) == v, 1).otherwise(0).alias(f"{prefix}_{v}") for v in values])


def finite(c: str) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))


def interactions(columns: list[str]) -> list[Column]:
    return [(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def filled(df: DataFrame, c: str, key: str = "ticker", ts: str = "ts", head: bool = False) -> DataFrame:
    """Carries the last value forward, and with ``head`` the first one back."""
    w = W.series_order(key, by=(ts,))
    v = W.fill_forward(c, w)
    return df.withColumn(c, F.coalesce(v, W.fill_backward(c, w)) if head else v)


def unique_columns(df: DataFrame) -> DataFrame:
    """The first of columns with one name."""
    places = list({c: i for i, c in reversed(list(enumerate(df.columns)))}.values())
    renamed = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_{i}").alias(df.columns[i]) for i in sorted(places)])

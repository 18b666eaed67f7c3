"""Joins over time and over pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scan import carried


def asof(left: DataFrame, right: DataFrame, value: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Each left row with the last right value at or before its time.

    Both sides are put on one time line, laid out by range of keys and time, and the value is carried forward over the
    partitions: a key that holds much of the table is many tasks. Of right rows of one time the greatest value counts.
    """
    both = left.select(*keys, ts, F.lit(1).alias("_l"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    both = both.unionByName(right.select(*keys, ts, F.lit(0).alias("_l"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v")))
    return carried(both, keys, [ts, "_l", "_v"], "_v", value).where("_l = 1").select("_row.*", value)


#: Blocks into which names are dealt; a row goes to one tile with each of them.
BLOCKS = 16


def _tiles(df: DataFrame, name: str, blocks: int) -> tuple[DataFrame, DataFrame]:
    """The rows as either side of the tiles (_i <= _j) of the triangle of blocks that they belong to."""
    d = df.withColumn("_b", F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int"))
    left = d.select("*", F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1))).alias("_j")).drop("_b")
    right = d.select("*", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j")).drop("_b")
    return left, right


def unordered_pairs(names: DataFrame, name: str = "name", within: list[str] = (), blocks: int = BLOCKS) -> DataFrame:
    """(within, a, b) with a < b of a table of names; for entity lists, never for rows.

    Names meet tile by tile of a triangle of blocks, by an equi-join on the tile: no side is broadcast, and a task has
    the names of two blocks.
    """
    left, right = _tiles(names.select(*within, F.col(name).alias("a")), "a", blocks)
    met = left.join(right.withColumnRenamed("a", "_a"), [*within, "_i", "_j"]).where((F.col("_i") < F.col("_j")) & (F.col("a") != F.col("_a")) | (F.col("a") < F.col("_a")))
    return met.select(*within, F.least("a", "_a").alias("a"), F.greatest("a", "_a").alias("b"))


def value_pairs(df: DataFrame, value: str, name: str = "name", ts: str = "ts", within: list[str] = (), blocks: int = BLOCKS) -> DataFrame:
    """(within, a, b, ts, x, y): the values of all two names at the same time, a < b.

    A row goes to ``blocks`` + 1 tiles, whatever the number of names, and meets the others of its tile and time by one
    equi-join; no list of pairs is made.
    """
    left, right = _tiles(df.select(*within, F.col(name).alias("a"), ts, F.col(value).alias("x")), "a", blocks)
    met = left.join(right.withColumnRenamed("a", "b").withColumnRenamed("x", "y"), [*within, "_i", "_j", ts])
    met = met.where((F.col("_i") < F.col("_j")) & (F.col("a") != F.col("b")) | (F.col("a") < F.col("b")))
    turned = F.col("a") > F.col("b")
    return met.select(*within, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ts, F.when(turned, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("y"))


def lag_pairs(df: DataFrame, most: int, keys: list[str], place: str = "place") -> DataFrame:
    """(keys, lag, x, y): x at a place with y at place + lag, for all lags from -most to most, by one equi-join."""
    shifted = df.select(*keys, place, "x", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"))
    y = df.select(*keys, F.col(place).alias("_p"), "y")
    return shifted.withColumn("_p", F.col(place) + F.col("lag")).join(y, [*keys, "_p"]).select(*keys, "lag", "x", "y")

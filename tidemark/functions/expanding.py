"""Counts of smaller earlier values, for any length of series, and expanding quantiles by them.

A value of an expanding quantile is known once it is known how many of the earlier values are below: places are cut into
blocks of time and values into ranges, and the earlier, smaller values of a row are those of earlier blocks and lower
ranges (sums of a table of counts), those of its own range in earlier blocks (counted within the range), and those of its
own block (counted within the block). Blocks and ranges have a bounded number of rows, so no task holds a series.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scan import Number, laid_out, numbered, scan

#: Rows of a block of time, and of a range of values.
BLOCK = 1 << 14


def earlier_smaller(rank: np.ndarray) -> np.ndarray:
    """For each element the number of those before it that are smaller, digit by digit of its rank, all elements at once."""
    n = len(rank)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    _, rank = np.unique(rank, return_inverse=True)
    for bit in range(int(rank.max()).bit_length()):
        # elements with the same higher digits, in their order: those with a one here count the zeros before them
        high = rank >> (bit + 1)
        order = np.argsort(high, kind="stable")
        one = (rank[order] >> bit) & 1
        zeros = np.cumsum(1 - one)
        new = np.concatenate(([True], high[order][1:] != high[order][:-1]))
        before = np.maximum.accumulate(np.where(new, np.concatenate(([0], zeros[:-1])), 0))
        out[order] += np.where(one == 1, zeros - before, 0)
    return out


def _counted(key: str, within: str | None):
    """Earlier elements of the group with a smaller ordinal; those of the same ``within`` do not count."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_m")
        v = pdf["_o"].to_numpy()
        n = earlier_smaller(v)
        for at in pdf.groupby(within, sort=False).indices.values() if within else ():
            n[at] -= earlier_smaller(v[at])
        return pd.DataFrame({key: pdf[key].to_numpy(), "_m": pdf["_m"].to_numpy(), "n": n})

    return one


def expanding_counts(df: DataFrame, key: str, order: str, c: str, block: int | None = None) -> DataFrame:
    """(key, order, c, _m, less, same) of the rows where c is known: the place among these, and how many earlier values are less than c, or equal.

    The table of counts has (rows / block)**2 cells for a series.
    """
    block = block or BLOCK
    known = df.where(F.col(c).isNotNull() & ~F.isnan(c)).select(key, order, c)
    laid = laid_out(numbered(known, [key], [order], "_m"), [key, c], ["_m"])
    # in the order of (value, place) each row has an ordinal of its own, and a frequent value is many ranges
    ordered = scan(laid, [key], Number(), "_o long", laid.columns)
    both = scan(ordered, [key, c], Number(), "same long").checkpoint()  # read by all that follows
    cells = both.select(key, "_m", "_o", F.floor(F.col("_m") / block).alias("_t"), F.floor(F.col("_o") / block).alias("_r"))
    counts = cells.groupBy(key, "_t", "_r").agg(F.count(F.lit(1)).alias("n"))
    # sums over earlier blocks and lower ranges: along the ranges of a block, then along the blocks of a range
    grid = counts.select(key, "_t").distinct().join(counts.select(key, "_r").distinct(), key).join(counts, [key, "_t", "_r"], "left").na.fill(0, ["n"])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = grid.withColumn("a", before("n", Window.partitionBy(key, "_t").orderBy("_r")))
    lower = lower.select(key, "_t", "_r", before("a", Window.partitionBy(key, "_r").orderBy("_t")).alias("n"))
    types = f"`{key}` {dict(df.dtypes)[key]}, _m long, n long"
    parts = [cells.join(lower, [key, "_t", "_r"]).select(key, "_m", "n"), cells.groupBy(key, "_r").applyInPandas(_counted(key, "_t"), types), cells.groupBy(key, "_t").applyInPandas(_counted(key, None), types)]
    up_to = reduce(DataFrame.unionByName, parts).groupBy(key, "_m").agg(F.sum("n").alias("n"))
    return both.join(up_to, [key, "_m"]).select(key, order, c, "_m", (F.col("n") - F.col("same")).alias("less"), "same")


def at_least(share: float):
    """Whether a value is at or above the interpolated quantile of the values so far, itself among them.

    Of _m + 1 values, the quantile lies between those of places j and j + 1, and no value lies between these.
    """
    at = F.col("_m") * F.lit(share)
    return F.col("less") + F.col("same") + 1 > F.ceil(at)


def at_most(share: float):
    return F.col("less") <= F.floor(F.col("_m") * F.lit(share))

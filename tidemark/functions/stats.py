"""Statistics as aggregate expressions, guarded where a library would divide by zero."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scan import Before, average_ranks, laid_out, scan
from tidemark.functions.windows import average_rank


def both(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def pearson(x: str, y: str, least: int = 5) -> Column:
    """Null for fewer than ``least`` complete pairs or a constant side."""
    a, b = F.when(both(x, y), F.col(x)), F.when(both(x, y), F.col(y))
    bottom = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= least) & (bottom > 1e-14), F.covar_pop(a, b) / F.when(bottom > 1e-14, bottom))


def spearman(df: DataFrame, x: str, y: str, keys: list[str], least: int = 5, out: str = "ic", spread: bool = False) -> DataFrame:
    """Pearson of average ranks over complete pairs, by group; ``spread`` for few groups of any size."""
    d = df.where(both(x, y)).select(*keys, F.col(x).alias("_a"), F.col(y).alias("_b"))
    if spread:
        d = average_ranks(d, "_a", keys, "_x").drop("_a")
        d = average_ranks(d, "_b", keys, "_y").drop("_b")
    else:
        d = d.select(*keys, average_rank("_a", *keys).alias("_x"), average_rank("_b", *keys).alias("_y"))
    return d.groupBy(*keys).agg(pearson("_x", "_y", least).alias(out), F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, c: str, shares: list[float], keys: list[str], out: str = "q") -> DataFrame:
    """(keys, q): interpolated quantiles of each group, exact, for few groups of any size.

    Values are counted first, so that one that a group repeats is one row; the distinct ones are laid out by range over
    many tasks, and each knows from the scan how many values are before it. Keys may be null.
    """
    d = df.select(*keys, F.col(c).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    laid = laid_out(d.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, ["_v"])
    placed = scan(laid, keys, Before("_n"), "_start long")
    size = laid.groupBy(*keys).agg(F.sum("_n").alias("_size")).select(*[F.col(k).alias(f"_of_{k}") for k in keys], "_size")  # one row a group
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    d = placed.join(size, reduce(Column.__and__, same)) if keys else placed.crossJoin(size)
    at = [p * (F.col("_size") - 1) for p in shares]
    pick = lambda place: F.max(F.when((F.col("_start") <= place) & (place < F.col("_start") + F.col("_n")), F.col("_v")))
    ends = [(f"_{'ab'[k]}{i}", (F.floor, F.ceil)[k](x)) for i, x in enumerate(at) for k in (0, 1)]
    found = d.groupBy(*keys, "_size").agg(*[pick(place).alias(name) for name, place in ends])
    between = [F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}")).otherwise((F.ceil(x) - x) * F.col(f"_a{i}") + (x - F.floor(x)) * F.col(f"_b{i}")) for i, x in enumerate(at)]
    return found.select(*keys, F.array(*between).alias(out))


def exact_quantiles(df: DataFrame, c: str, shares: list[float], parts: int = 128) -> list[float | None]:
    """Interpolated quantiles of a whole table, from the values themselves.

    A first pass cuts the values at approximate quantiles, a second counts each part, and only the parts that hold a
    wanted place are sorted, each by itself; the driver sees the cuts, the counts and the values at the wanted places.
    """
    d = df.select(F.col(c).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    cuts = d.agg(F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts)).first()[0]
    if not cuts:
        return [None] * len(shares)
    d = d.withColumn("part", F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(cuts))]), lambda x: x < F.col("v"))))
    sizes = dict(sorted(d.groupBy("part").count().collect()))
    first, n = {}, 0
    for part, size in sizes.items():
        first[part], n = n, n + size
    at = [p * (n - 1) for p in shares]
    part_of = lambda rank: max(k for k in first if first[k] <= rank)
    wanted = {(part_of(r), r - first[part_of(r)] + 1): r for x in at for r in (math.floor(x), math.ceil(x))}
    placed = d.where(F.col("part").isin(sorted({k for k, _ in wanted}))).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("v")))
    found = placed.where(F.col("place").isin(sorted({i for _, i in wanted}))).select("part", "place", "v").collect()
    value = {wanted[r.part, r.place]: r.v for r in found if (r.part, r.place) in wanted}
    low, high = [value[math.floor(x)] for x in at], [value[math.ceil(x)] for x in at]
    return [a if a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b for x, a, b in zip(at, low, high)]


def corrected_skew(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def corrected_kurtosis(c: str) -> Column:
    n = F.count(c)
    return F.when(n > 3, ((n + 1) * F.kurtosis(c) + 6) * (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)))


def slope_t(x: str, y: str) -> Column:
    """t statistic of the slope of y on x, from the moments."""
    n, sxx, syy, sxy = F.count(x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    return F.try_divide(sxy / sxx, F.sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx))

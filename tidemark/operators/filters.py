"""Recursive filters along a series, as scans of affine maps; and a wavelet transform as joins over dyadic places.

A filter's state after a row is a matrix times the state before plus a vector, both known from the row, its place and
the value before it. Maps compose, so a partition of a series is one map, and one series is many tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scan import Fold, carries, laid_out, numbered, scan


def valid(rows: pa.RecordBatch, c: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, and which of them are not missing."""
    x = pc.fill_null(rows.column(c).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    return x, ~np.isnan(x)


class Counted(Fold):
    """How many values there were, and the last one."""

    def __init__(self, c: str):
        self.c = c

    def summarise(self, summary, rows, part):
        n, last = summary or (0, np.nan)
        x, ok = valid(rows, self.c)
        return (n + int(ok.sum()), float(x[ok][-1])) if ok.any() else (n, last)

    def carry(self, state, summary):
        n, last = state or (0, np.nan)
        return n + summary[0], summary[1] if summary[0] else last


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One map (matrix, vector) for all of them, one after the other."""
    while len(a) > 1:
        if len(a) % 2:
            a, b = np.concatenate([a, np.eye(a.shape[1])[None]]), np.concatenate([b, np.zeros((1, b.shape[1]))])
        first, then = a[::2], a[1::2]
        a, b = then @ first, (then @ b[::2, :, None])[:, :, 0] + b[1::2]
    return a[0], b[0]


def running(a: np.ndarray, b: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after each map."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] = (a[step:] @ b[:-step, :, None])[:, :, 0] + b[step:]
        a[step:] = a[step:] @ a[:-step]
        step *= 2
    return (a @ state) + b


class Recursion(Fold):
    """A filter of d numbers. Missing values leave the state as it is and have no result."""

    def __init__(self, c: str, known: dict, d: int, maps, out, start: float = 0.0):
        self.c, self.known, self.d, self.maps, self.out, self.first = c, known, d, maps, out, np.full(d, start)

    def _rows(self, n, last, rows):
        x, ok = valid(rows, self.c)
        x = x[ok]
        place = n + np.arange(len(x))
        a, b = self.maps(place, x, np.concatenate(([last], x[:-1])) if len(x) else x)
        return ok, place, a, b, (n + len(x), float(x[-1]) if len(x) else last)

    def summarise(self, summary, rows, part):
        seen, a, b = summary or (self.known.get(part) or (0, np.nan), np.eye(self.d), np.zeros(self.d))
        *_, more, add, seen = self._rows(*seen, rows)
        if len(more):
            a2, b2 = composed(more, add)
            a, b = a2 @ a, a2 @ b + b2
        return seen, a, b

    def carry(self, state, summary):
        _, a, b = summary
        return a @ (self.first if state is None else state) + b

    def apply(self, state, rows, part):
        if not isinstance(state, tuple):  # what came in from the partitions before, or nothing
            state = self.known.get(part) or (0, np.nan), self.first if state is None else state
        seen, now = state
        ok, place, a, b, seen = self._rows(*seen, rows)
        states = running(a, b, now) if len(a) else np.zeros((0, self.d))
        columns = []
        for v in self.out(place, states):
            full = np.full(len(ok), np.nan)
            full[ok] = v
            columns.append(pa.array(full, from_pandas=True))  # not a number: null
        return columns, (seen, states[-1] if len(a) else now)


def filtered(df: DataFrame, c: str, d: int, maps, out, columns: list[str], key: str = "ticker", ts: str = "ts", start: float = 0.0) -> DataFrame:
    """(key, ts, columns) of a filter; two scans, the first for places and values before."""
    laid = laid_out(df.select(key, ts, c), [key], [ts])
    known = carries(laid, [key], Counted(c))
    return scan(laid, [key], Recursion(c, known, d, maps, out, start), ", ".join(f"`{n}` double" for n in columns), [key, ts])


def smoothing(place: np.ndarray, k: int, first: int = 0, rate: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(what stays of the state, the weight of the value): a mean of the first k values from place ``first`` on, then smoothed."""
    rate = 2 / (k + 1) if rate is None else rate
    q = place - first
    return np.where(q < k, 1.0, 1 - rate), np.where(q < 0, 0.0, np.where(q < k, 1 / k, rate))


def ema(df: DataFrame, c: str, k: int, out: str = "ema", **columns) -> DataFrame:
    """Starts from the mean of the first k values; null before."""

    def maps(place, x, _):
        stay, take = smoothing(place, k)
        return stay[:, None, None], (take * x)[:, None]

    return filtered(df, c, 1, maps, lambda place, s: [np.where(place >= k - 1, s[:, 0], np.nan)], [out], **columns)


def macd(df: DataFrame, c: str, fast: int = 12, slow: int = 26, signal: int = 9, **columns) -> DataFrame:
    """macd, signal, histogram: both averages and the average of their difference are one state of three numbers."""
    late = slow - 1

    def maps(place, x, _):
        a, b = np.zeros((len(x), 3, 3)), np.zeros((len(x), 3))
        for i, k in enumerate((fast, slow)):
            a[:, i, i], take = smoothing(place, k)
            b[:, i] = take * x
        a[:, 2, 2], take = smoothing(place, signal, late)
        a[:, 2, 0], a[:, 2, 1], b[:, 2] = take * a[:, 0, 0], -take * a[:, 1, 1], take * (b[:, 0] - b[:, 1])
        return a, b

    def out(place, s):
        m, g = np.where(place >= late, s[:, 0] - s[:, 1], np.nan), np.where(place >= late + signal - 1, s[:, 2], np.nan)
        return [m, g, m - g]

    return filtered(df, c, 3, maps, out, ["macd", "signal", "histogram"], **columns)


def rsi(df: DataFrame, c: str, k: int = 14, **columns) -> DataFrame:
    """With Wilder's smoothing of rises and falls."""

    def maps(place, x, before):
        change = np.where(place > 0, x - np.where(place > 0, before, 0.0), 0.0)
        stay, take = smoothing(place, k, 1, 1 / k)
        a = np.zeros((len(x), 2, 2))
        a[:, 0, 0] = a[:, 1, 1] = stay
        return a, np.stack([take * np.maximum(change, 0), take * np.maximum(-change, 0)], axis=1)

    def out(place, s):
        up, down = s[:, 0], s[:, 1]
        return [np.where(place < k, np.nan, np.where(down == 0, 100.0, 100 - 100 / (1 + up / np.where(down == 0, 1, down))))]

    return filtered(df, c, 2, maps, out, ["rsi"], **columns)


def gains(q: float, r: float, var: float) -> np.ndarray:
    """The gain at each place, up to where it no longer changes: the variance depends on no value."""
    found = []
    while len(found) < 100_000:
        gain = var / (var + r)
        if found and gain == found[-1]:
            break
        found.append(gain)
        var = (1 - gain) * var + q
    return np.array(found)


def kalman(df: DataFrame, c: str, q: float = 0.01, r: float = 1.0, mean: float = 0.0, var: float = 1.0, **columns) -> DataFrame:
    """level of a random walk with noise."""
    table = gains(q, r, var)

    def maps(place, x, _):
        gain = table[np.minimum(place, len(table) - 1)]
        return (1 - gain)[:, None, None], (gain * x)[:, None]

    return filtered(df, c, 1, maps, lambda place, s: [s[:, 0]], ["level"], start=mean, **columns)


# The low-pass analysis filter of the Daubechies wavelet with six vanishing moments.
DB6 = [-0.00107730108499558, 0.004777257511010651, 0.0005538422009938016, -0.031582039318031156, 0.02752286553001629, 0.09750160558707936, -0.12976686756709563, -0.22626469396516913, 0.3152503517092432, 0.7511339080215775, 0.4946238903983854, 0.11154074335008017]


def denoise(df: DataFrame, c: str, levels: int = 3, share: float = 0.5, key: str = "ticker", ts: str = "ts") -> DataFrame:
    """(key, ts, smooth): soft threshold of the details at a share of a series' greatest, on a periodic orthogonal transform.

    A level sends each value to the six places of the next one that it has a part in, where they are summed: a strided
    equi-join with the filter, in any number of tasks for one series. The way back is the same the other way round. The
    end of a series is repeated until its length is a multiple of 2**levels; it is halved while it is as long as the filter.
    """
    taps, block = list(reversed(DB6)), 1 << levels
    placed = numbered(df.select(key, ts, F.col(c).cast("double").alias("v")), [key], [ts])
    size = placed.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.max_by("v", "_n").alias("end"))
    size = size.withColumn("len", F.ceil(F.col("m") / block) * block)
    padding = size.where("len > m").select(key, F.explode(F.sequence(F.col("m"), F.col("len") - 1)).alias("i"), F.col("end").alias("v"), "len")
    a = placed.join(size.select(key, "len"), key).select(key, F.col("_n").alias("i"), "v", "len").unionByName(padding)
    low = F.array(*map(F.lit, taps))
    high = F.array(*[F.lit(x * (-1.0) ** k) for k, x in enumerate(taps[::-1])])
    reach = F.array(*[F.lit(k) for k in range(len(taps))])
    long = lambda level: F.col("len") / (1 << level) >= len(taps)
    alone = F.array(F.lit(-1))  # a series that is too short goes through a level as it is
    levels_of, now = [], a
    for level in range(levels):
        # value i stands under tap k of the places j with (2 j + k) mod length = i
        under = F.when(long(level), F.filter(reach, lambda k: (F.col("i") - k) % 2 == 0)).otherwise(alone)
        k, whole = F.col("k"), F.col("k") < 0
        j = F.when(whole, F.col("i")).otherwise(F.pmod((F.col("i") - k) / 2, F.col("len") / (2 << level)).cast("long"))
        meets = now.select(key, "len", "v", "i", F.explode(under).alias("k"))
        meets = meets.select(key, "len", j.alias("i"), F.when(whole, F.col("v")).otherwise(F.col("v") * F.get(low, k)).alias("v"), F.when(~whole, F.col("v") * F.get(high, k)).alias("d"))
        now = meets.groupBy(key, "len", "i").agg(F.sum("v").alias("v"), F.sum("d").alias("d")).checkpoint()  # read twice
        levels_of.append(now.select(key, "i", "d"))
        now = now.select(key, "len", "i", "v")
    tallest = reduce(DataFrame.unionByName, [d.groupBy(key).agg(F.max(F.abs("d")).alias("limit")) for d in levels_of])
    limit = tallest.groupBy(key).agg((share * F.max("limit")).alias("limit"))
    for level in reversed(range(levels)):
        soft = levels_of[level].join(limit, key).select(key, "i", (F.signum("d") * F.greatest(F.abs("d") - F.col("limit"), F.lit(0.0))).alias("d"))
        sent = now.join(soft, [key, "i"]).select(key, "len", "i", "v", "d", F.explode(F.when(long(level), reach).otherwise(alone)).alias("k"))
        k, whole = F.col("k"), F.col("k") < 0
        j = F.when(whole, F.col("i")).otherwise(F.pmod(2 * F.col("i") + k, F.col("len") / (1 << level)).cast("long"))
        value = F.when(whole, F.col("v")).otherwise(F.col("v") * F.get(low, k) + F.col("d") * F.get(high, k))
        now = sent.select(key, "len", j.alias("i"), value.alias("v")).groupBy(key, "len", "i").agg(F.sum("v").alias("v"))
    smooth = now.select(key, F.col("i").alias("_n"), F.col("v").alias("smooth"))
    return placed.select(key, ts, "_n").join(smooth, [key, "_n"]).select(key, ts, "smooth")

"""Statistics over moving windows that SQL frames cannot express: ranks inside each window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scan import numbered


class Moved:
    """Doubled average ranks of the values in a window, kept up to date as values come and go: one comparison a place.

    values are whole numbers in the order of the data. A place of the window that is not yet filled holds none.
    """

    def __init__(self, window: int):
        self.at, self.ranks, self.filled = np.zeros(window, np.int64), np.zeros(window, np.int64), np.zeros(window, bool)

    def put(self, place: int, value: int) -> None:
        """Replaces what is at the place."""
        v, r = self.at, self.ranks
        if self.filled[place]:
            old = v[place]
            r -= v > old
            r -= v >= old
        v[place], self.filled[place] = value, True
        low, up_to = v < value, v <= value
        if not self.filled.all():
            low, up_to = low & self.filled, up_to & self.filled
        r += v > value
        r += v >= value
        r[place] = np.count_nonzero(low) + np.count_nonzero(up_to) + 1  # less, and as many as are not greater


def window_spearman(a: np.ndarray, b: np.ndarray, window: int, flat: float = np.nan) -> np.ndarray:
    """Spearman of each full window; missing where it has a missing value, ``flat`` where a side is constant."""
    n, out = len(a), np.full(len(a), np.nan)
    known = ~(np.isnan(a) | np.isnan(b))
    if n < window or window < 1:
        return out
    codes = [np.unique(np.where(known, x, 0.0), return_inverse=True)[1] for x in (a, b)]
    sides, run = (Moved(window), Moved(window)), 0
    mean2 = (window + 1) ** 2  # of doubled ranks, the square of the mean
    for i in range(n):
        if not known[i]:
            run = 0
            continue
        if run == 0:
            sides = (Moved(window), Moved(window))
        for side, code in zip(sides, codes):
            side.put(run % window, code[i])
        run += 1
        if run >= window:
            x, y = sides[0].ranks, sides[1].ranks
            xx, yy, xy = (float(p @ q) / window - mean2 for p, q in ((x, x), (y, y), (x, y)))
            bottom = np.sqrt(max(xx, 0.0) * max(yy, 0.0))
            out[i] = xy / bottom if bottom > 1e-9 else flat
    return out


def rolling_spearman(df: DataFrame, key: str, ts: str, a: str, b: str, window: int, out: str = "v", flat: float = np.nan, block: int = 4096) -> DataFrame:
    """Adds the Spearman correlation of a and b over the last ``window`` rows of a series; null where one is missing.

    A series is cut into blocks of rows, each with the window before it, so that one long series is many tasks.
    """
    block = max(block, window)
    d = numbered(df, [key], [ts])
    d = d.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_n") / block), F.floor((F.col("_n") + window - 1) / block))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        rho = window_spearman(pdf[a].to_numpy(float), pdf[b].to_numpy(float), window, flat)
        mine = (pdf["_n"] // block == pdf["_block"]).to_numpy()
        return pdf.assign(**{out: rho})[mine].drop(columns=["_n", "_block"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    found = d.groupBy(key, "_block").applyInPandas(one, f"{kinds}, `{out}` double")
    return found.withColumn(out, F.when(~F.isnan(out), F.col(out)))

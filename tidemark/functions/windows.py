"""Window functions over ordered series, as Columns.

A frame of k bars is the current one and the k - 1 before it. Statistics skip nulls and are null until the frame has
``least`` values; rolling helpers default to half the frame, as analysts expect of a warm-up.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec, functions as F


def series_order(*keys: str, by=("ts", "tie")) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def trailing(w: WindowSpec, k: int) -> WindowSpec:
    return w.rowsBetween(-(k - 1), 0)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def at_least(value: Column, n: Column, least: int) -> Column:
    return F.when(n >= least, value)


def rolling(agg, c, w: WindowSpec, k: int, least: int | None = None) -> Column:
    f = trailing(w, k)
    return at_least(agg(col(c)).over(f), F.count(col(c)).over(f), max(1, k // 2) if least is None else least)


def rolling_mean(c, w, k, least=None):
    return rolling(F.avg, c, w, k, least)


def rolling_median(c, w, k, least=None):
    """Exact; the frame is sorted for each row, so meant for short frames."""
    return rolling(lambda x: F.percentile(x, 0.5), c, w, k, least)


def rolling_std(c, w, k, least=None):
    return rolling(F.stddev_samp, c, w, k, least)


def rolling_zscore(c, w, k, least=None):
    """Null where the deviation is zero."""
    return F.try_divide(col(c) - rolling_mean(c, w, k, least), F.nullif(rolling_std(c, w, k, least), F.lit(0.0)))


def rolling_max(c, w, k, least=None):
    return rolling(F.max, c, w, k, least)


def rolling_min(c, w, k, least=None):
    return rolling(F.min, c, w, k, least)


def lagged(c, w, k):
    return F.lag(col(c), k).over(w)


def momentum(c, w, k):
    return col(c) - lagged(c, w, k)


def pct_change(c, w, k=1):
    return F.try_divide(col(c), lagged(c, w, k)) - 1


def normalised_return(c, w, k):
    """(1 + k-period return) ** (1/k) - 1."""
    return F.pow(1 + pct_change(c, w, k), F.lit(1.0 / k)) - 1


def _pair(x, y):
    both = col(x).isNotNull() & col(y).isNotNull()
    return F.when(both, col(x)), F.when(both, col(y))


def rolling_cov(x, y, w, k, least=None):
    x, y = _pair(x, y)
    return rolling(lambda c: F.covar_samp(c, y), x, w, k, k if least is None else least)


def rolling_correlation(x, y, w, k, least=None):
    """Pearson over complete pairs, null where either is constant: moments are guarded, never divided by zero."""
    x, y = _pair(x, y)
    f = trailing(w, k)
    top = F.covar_pop(x, y).over(f)
    bottom = F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f)
    return at_least(F.when(bottom > 1e-14, top / F.when(bottom > 1e-14, bottom)), F.count(x).over(f), k if least is None else least)


def rolling_beta(x, y, w, k, least=None):
    """Covariance over the variance of y."""
    x2, y2 = _pair(x, y)
    f = trailing(w, k)
    return at_least(F.try_divide(F.covar_samp(x2, y2).over(f), F.nullif(F.var_samp(y2).over(f), F.lit(0.0))), F.count(x2).over(f), k if least is None else least)


def beta_through_origin(y, x, w, k):
    """Slope without intercept over the k bars before the current one."""
    f = w.rowsBetween(-k, -1)
    return at_least(F.try_divide(F.sum(col(x) * col(y)).over(f), F.sum(col(x) * col(x)).over(f)), F.count(col(x)).over(f), k)


def price_position(c, w, k):
    lo, hi = rolling_min(c, w, k, k), rolling_max(c, w, k, k)
    return (col(c) - lo) / (hi - lo + 1e-12)


def ratio_to_mean(c, w, k):
    return col(c) / (rolling_mean(c, w, k, k) + 1e-12)


def drawdown(c, w):
    peak = F.max(col(c)).over(running(w))
    return (col(c) - peak) / (peak + 1e-12)


def running_sum(c, w):
    return F.sum(col(c)).over(running(w))


def running_product(c, w):
    """Of positive factors, as the exponential of the running sum of logarithms."""
    return F.exp(F.sum(F.ln(col(c))).over(running(w)))


def change(c, w, first):
    """Difference to the bar before; the first bar's is to ``first``."""
    return col(c) - F.coalesce(lagged(c, w, 1), F.lit(first))


def fill_forward(c, w):
    return F.last(col(c), ignorenulls=True).over(running(w))


def fill_backward(c, w):
    """Looks ahead; for the head of a series only, on request."""
    return F.first(col(c), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def trend_regime(c, w, fast=6, slow=24):
    """1 where the fast mean is above the slow one, else 0, unknown included."""
    return F.coalesce((rolling_mean(c, w, fast) > rolling_mean(c, w, slow)).cast("int"), F.lit(0))


def average_rank(c, *keys: str) -> Column:
    """Rank with ties averaged, over non-null values of the group."""
    g = Window.partitionBy(*keys)
    r = F.rank().over(g.orderBy(col(c).asc_nulls_last()))
    ties = F.count(col(c)).over(Window.partitionBy(*keys, col(c)))
    return F.when(col(c).isNotNull(), r + (ties - 1) / 2)


def cross_rank(c, *keys: str) -> Column:
    """Average rank as a share of the group's non-null values."""
    return average_rank(c, *keys) / F.count(col(c)).over(Window.partitionBy(*keys))


def bollinger(c, w, k=21, width=2.0, population=True):
    sd = rolling(F.stddev_pop if population else F.stddev_samp, c, w, k, k)
    m = rolling_mean(c, w, k, k)
    return m - width * sd, m, m + width * sd


def spread_zscore(c, w, short, long):
    """(short mean - long mean) over the long deviation."""
    return F.try_divide(rolling_mean(c, w, short, short) - rolling_mean(c, w, long, long), F.nullif(rolling_std(c, w, long, long), F.lit(0.0)))


def forward_return(c, w, h=1, kind="return"):
    ahead = F.lead(col(c), h).over(w)
    if kind == "return":
        return F.try_divide(ahead, col(c)) - 1
    if kind == "log_return":
        return F.ln(F.try_divide(ahead, col(c)))
    if kind == "directional":  # the tail has no later bar and counts as 0
        return F.coalesce((ahead > col(c)).cast("int"), F.lit(0))
    raise ValueError(f"unknown target {kind!r}")

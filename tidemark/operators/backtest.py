"""Path-dependent simulators, one task a run; ledgers, their checks and grades as window queries."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import windows as W
from tidemark.functions.rolling import rolling_spearman

BARS_A_DAY, DAYS_A_YEAR = 75, 252
BARS_A_YEAR = BARS_A_DAY * DAYS_A_YEAR
LEDGER = "run string, ts timestamp_ntz, exposure double, cash double, turnover double, nav double"


@dataclass
class LongOnly:
    capital: float = 1e6
    entry_percentile: float = 70.0
    exit_percentile: float = 40.0
    fraction: float = 0.95
    turnover_cap: float = 0.02
    guard: int = 6
    gate: float = 0.02


@dataclass
class LongShort:
    capital: float = 1e6
    long_percentile: float = 80.0
    short_percentile: float = 20.0
    long_fraction: float = 0.95
    short_fraction: float = 0.5
    cap: float = 2e6
    turnover_cap: float = 0.02
    guard: int = 6
    gate: float = -0.02


def simulate(prices: np.ndarray, signal: np.ndarray, regime: np.ndarray, p) -> np.ndarray:
    """Rows (exposure, cash, turnover, nav) of one run.

    In this order each bar: the wanted shares (flat on the first and last bar and while the regime is closed; entries
    only ahead of the guard), the cap on what one bar may trade, what cash affords, the trade, the ceiling on
    exposure, the marks; the last bar sells what is left.
    """
    n, short = len(prices), isinstance(p, LongShort)
    enter, leave = np.percentile(signal, [p.long_percentile, p.short_percentile] if short else [p.entry_percentile, p.exit_percentile]) if n else (0, 0)
    cash, shares, out = p.capital, 0.0, np.zeros((n, 4))
    for t in range(n):
        price, s = prices[t], signal[t]
        last = t == n - 1
        if t == 0 or last or regime[t] < p.gate:
            want = 0.0
        elif shares == 0:
            want = 0.0
            if t < n - p.guard:
                if short:
                    base = min(cash, p.cap)
                    want = base * p.long_fraction / price if s > enter else -base * p.short_fraction / price if s < leave else 0.0
                elif s >= enter:
                    want = min(p.fraction * cash, p.fraction * p.capital) / price
        elif shares > 0:
            want = 0.0 if s < leave else shares
        else:
            want = 0.0 if s > enter else shares
        trade = want - shares
        if not last:
            most = p.turnover_cap * p.capital / price
            trade = max(-most, min(most, trade))
        if trade > 0 and trade * price > cash + 0.01:
            trade = max(0.0, cash / price)
        before = cash
        cash, shares = cash - trade * price, shares + trade
        if not short:
            cash = max(cash, 0.0)
        ceiling = p.cap if short else p.capital
        if abs(shares) * price > ceiling + 0.01:
            over = (abs(shares) - ceiling / price) * np.sign(shares)
            shares, cash = shares - over, cash + over * price
        if abs(shares) < 1e-12:
            shares = 0.0
        out[t] = abs(shares) * price, cash, abs(cash - before), cash + shares * price
    return out


def backtest(df: DataFrame, strategy, runs: DataFrame | None = None) -> DataFrame:
    """The ledger of each run of df(run, ts, price, signal, regime).

    A run is one sequential computation, so it is one task; runs are spread. ``runs`` may hold parameter sets
    (param columns named as the strategy's fields, and ``params``, a name): each run then goes with each of them.
    """
    fields = [c for c in runs.columns if c != "params"] if runs is not None else []
    d = df.join(F.broadcast(runs)) if runs is not None else df.withColumn("params", F.lit(""))
    base, kind = asdict(strategy), type(strategy)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        p = kind(**(base | {f: float(pdf[f].iloc[0]) for f in fields}))
        r = simulate(pdf["price"].to_numpy(), pdf["signal"].to_numpy(), pdf["regime"].to_numpy(), p)
        name = f"{pdf['run'].iloc[0]}{pdf['params'].iloc[0]}"
        return pd.DataFrame({"run": name, "ts": pdf["ts"].to_numpy(), "exposure": r[:, 0], "cash": r[:, 1], "turnover": r[:, 2], "nav": r[:, 3]})

    return recomputed(d.groupBy("run", "params").applyInPandas(one, LEDGER), strategy.capital)


def order(*by: str):
    return Window.partitionBy("run").orderBy(*(by or ("ts",)))


def recomputed(ledger: DataFrame, capital: float = 1e6) -> DataFrame:
    """Turnover as the rounded change of cash, the first bar against the capital; the rest rounded to eight places."""
    w = order()
    return ledger.select("run", "ts", F.round("exposure", 8).alias("exposure"), F.round("cash", 8).alias("cash"), F.round(F.abs(F.col("cash") - F.coalesce(F.lag("cash").over(w), F.lit(capital))), 8).alias("turnover"), F.round("nav", 8).alias("nav"))


def regime_ic(df: DataFrame, window: int = 2000, key: str = "run") -> DataFrame:
    """Adds ``regime``: the Spearman correlation of the signal in [t-W-1, t-1) with the return in [t-W, t); 1 before."""
    w = Window.partitionBy(key).orderBy("ts")
    d = df.withColumn("_a", F.lag("signal").over(w)).withColumn("_b", F.when(F.lag("price").over(w).isNotNull(), F.col("price") / F.lag("price").over(w) - 1).otherwise(F.lit(0.0)))
    rho = rolling_spearman(d, key, "ts", "_a", "_b", window, out="_rho", flat=0.0)
    return rho.withColumn("regime", F.coalesce(F.lag("_rho").over(w), F.lit(1.0))).select(*df.columns, "regime")


def violations(ledger: DataFrame, rows: int | None = None, capital: float = 1e6) -> DataFrame:
    """One row a run: counts of broken rules of a ledger, and whether it stands."""
    w = order()
    values = ["exposure", "cash", "turnover", "nav"]
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1).otherwise(0) for c in values), F.lit(0))
    d = ledger.withColumn("_dc", F.abs(F.col("cash") - F.coalesce(F.lag("cash").over(w), F.lit(capital)))).withColumn("_dup", (F.lag("ts").over(w) == F.col("ts")).cast("int"))
    g = d.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"), F.sum(bad).alias("not_finite"), F.count_if(F.col("exposure") < 0).alias("negative_exposure"), F.count_if(F.col("turnover") < 0).alias("negative_turnover"),
        F.count_if(F.col("ts").isNull()).alias("no_time"), F.coalesce(F.sum("_dup"), F.lit(0)).alias("repeated_time"), F.min_by("exposure", "ts").alias("_first"), F.max_by("exposure", "ts").alias("_last"),
        F.count_if(F.abs(F.abs(F.col("nav") - F.col("cash")) - F.col("exposure")) > 0.01).alias("nav_off"), F.count_if(F.abs(F.col("_dc") - F.col("turnover")) > 0.01).alias("cash_off"), F.count_if(F.col("cash") < -0.01).alias("negative_cash"),
    )
    g = g.withColumn("not_flat", F.when(F.abs("_first") > 0.01, 1).otherwise(0) + F.when(F.abs("_last") > 0.01, 1).otherwise(0)).drop("_first", "_last")
    wrong = sum((F.col(c) for c in ("not_finite", "negative_exposure", "negative_turnover", "no_time", "repeated_time", "nav_off", "cash_off", "not_flat")), F.lit(0))
    return g.withColumn("valid", (wrong == 0) & (F.col("n") == rows if rows else F.lit(True)))


def net_nav(ledger: DataFrame, bps: float = 10.0) -> DataFrame:
    return ledger.withColumn("net", F.col("nav") - F.sum(F.col("turnover") * (bps / 1e4)).over(W.running(order())))


def graded_sharpe(ledger: DataFrame, bps: float = 10.0) -> DataFrame:
    """run, sharpe: of the changes of NAV after fees, the first 0, annualised, to four places; 0 for a constant NAV."""
    r = net_nav(ledger, bps).select("run", F.coalesce(W.pct_change("net", order()), F.lit(0.0)).alias("r"))
    sd = F.stddev_samp("r")
    return r.groupBy("run").agg(F.round(F.when(sd > 0, F.avg("r") / sd * F.sqrt(F.lit(float(BARS_A_YEAR)))).otherwise(0.0), 4).alias("sharpe"))


def grades(ledger: DataFrame, cap: float, bps: float = 10.0, rows: int | None = None, capital: float = 1e6) -> DataFrame:
    """run, valid, status, sharpe: structure, margin, cap on exposure, bankruptcy after fees, then the Sharpe ratio."""
    v = violations(ledger, rows, capital)
    m = net_nav(ledger, bps).groupBy("run").agg(F.max("exposure").alias("top"), F.min("net").alias("least"))
    d = v.join(m, "run").join(graded_sharpe(ledger, bps), "run")
    status = F.when(~F.col("valid"), "structure").when(F.col("negative_cash") > 0, "margin").when(F.col("top") > cap, "cap").when(F.col("least") <= 0, "bankrupt").otherwise("valid")
    return d.select("run", status.alias("status"), F.when(status == "valid", F.col("sharpe")).otherwise(0.0).alias("sharpe"))


def leaderboard(long_only: DataFrame, long_short: DataFrame) -> DataFrame:
    """team, sharpe, status: the mean of both Sharpe ratios, a missing or invalid file counts 0; best first."""
    d = long_only.select(F.col("run").alias("team"), F.col("status").alias("a"), F.col("sharpe").alias("x")).join(long_short.select(F.col("run").alias("team"), F.col("status").alias("b"), F.col("sharpe").alias("y")), "team", "full")
    good = (F.coalesce("a", F.lit("missing")) == "valid") & (F.coalesce("b", F.lit("missing")) == "valid")
    return d.select("team", F.when(good, (F.col("x") + F.col("y")) / 2).otherwise(0.0).alias("sharpe"), F.when(good, "valid").otherwise("disqualified").alias("status")).orderBy(F.desc("sharpe"), "team")


def performance(df: DataFrame, per_year: float = BARS_A_YEAR, key: str = "run", c: str = "nav") -> DataFrame:
    """One row a run of all metrics of df(run, ts, nav, turnover); returns are the change over the current value."""
    w = Window.partitionBy(key).orderBy("ts")
    d = df.select(key, "ts", c, "turnover", ((F.col(c) - F.lag(c).over(w)) / F.col(c)).alias("r"), W.drawdown(c, w).alias("dd"))
    q = d.groupBy(key).agg(F.percentile("r", F.array(F.lit(0.05), F.lit(0.01), F.lit(0.99))).alias("q"))
    d = d.join(q, key)
    root, sd = F.sqrt(F.lit(float(per_year))), F.stddev_samp("r")
    down = F.when(F.col("r") < 0, F.col("r"))
    a = d.groupBy(key).agg(
        F.count(c).alias("n"), (F.max_by(c, "ts") / F.min_by(c, "ts") - 1).alias("total_return"), (F.pow(F.max_by(c, "ts") / F.min_by(c, "ts"), per_year / F.count(c)) - 1).alias("annual_return"),
        (sd * root).alias("volatility"), F.try_divide(F.avg("r"), F.nullif(sd, F.lit(0.0))).alias("_s"), F.when(F.count(down) >= 2, F.try_divide(F.avg("r"), F.nullif(F.stddev_samp(down), F.lit(0.0)))).otherwise(0.0).alias("_o"),
        F.min("dd").alias("max_drawdown"), F.avg(F.when(F.col("dd") < 0, F.col("dd"))).alias("average_drawdown"), F.first("q")[0].alias("var_95"), F.avg(F.when(F.col("r") <= F.col("q")[0], F.col("r"))).alias("cvar_95"),
        F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurtosis"), F.abs(F.first("q")[2] / F.first("q")[1]).alias("tail_ratio"), F.avg(F.when(F.col("turnover") > 0, F.col("turnover"))).alias("average_turnover"), F.avg(c).alias("_n"),
    )
    a = a.withColumn("sharpe", F.coalesce(F.col("_s") * root, F.lit(0.0))).withColumn("sortino", F.coalesce(F.col("_o") * root, F.lit(0.0)))
    return a.withColumn("calmar", F.try_divide("annual_return", F.abs("max_drawdown"))).withColumn("holding_days", F.try_divide(F.col("_n"), F.col("average_turnover") * BARS_A_DAY)).drop("_s", "_o", "_n")


def trades(df: DataFrame, key: str = "run") -> DataFrame:
    """(run, trade, pnl) of df(run, ts, change, pnl): each change of position opens or closes in turn; the bar that opens is left out, an open trade at the end stays."""
    w = Window.partitionBy(key).orderBy("ts")
    d = df.select(key, "ts", "pnl", F.col("change") != 0, F.sum((F.col("change") != 0).cast("int")).over(W.running(w)).alias("c")).toDF(key, "ts", "pnl", "moved", "c")
    inside = ((F.col("c") % 2 == 1) & ~F.col("moved")) | ((F.col("c") % 2 == 0) & F.col("moved"))
    return d.where(inside & (F.col("c") > 0)).groupBy(key, F.floor((F.col("c") + 1) / 2 - F.when(F.col("moved"), F.lit(0.5)).otherwise(0.0)).alias("trade")).agg(F.sum("pnl").alias("pnl"))


def trade_stats(t: DataFrame, key: str = "run") -> DataFrame:
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    a = t.groupBy(key).agg(F.count(F.lit(1)).alias("trades"), F.sum(win).alias("_w"), F.sum(loss).alias("_l"), F.avg((F.col("pnl") > 0).cast("int")).alias("hit"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"))
    factor = F.when(F.coalesce("_l", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.coalesce("_w", F.lit(0.0)) / F.abs("_l"))
    return a.select(key, "trades", factor.alias("profit_factor"), "hit", "average_win", "average_loss", F.try_divide("average_win", F.abs("average_loss")).alias("win_loss"))


def against_benchmark(df: DataFrame, per_year: float = DAYS_A_YEAR, key: str = "run") -> DataFrame:
    """alpha, beta, omega, sharpe of df(run, r, market)."""
    up, down = F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") < 0, -F.col("r")))
    a = df.groupBy(key).agg(F.regr_slope("r", "market").alias("beta"), (F.regr_intercept("r", "market") * per_year).alias("alpha"), F.try_divide(up, down).alias("omega"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(float(per_year)))).alias("sharpe"))
    return a



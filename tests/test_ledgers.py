"""Ledgers and strategies worked out by hand, bar by bar."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions.scan import average_ranks
from tidemark.functions import rolling as Y, stats as S
from tidemark.operators import backtest as B, models as M, pairs as K


def simulated(prices, signal, p):
    return [tuple(round(float(v), 6) for v in r) for r in B.simulate(np.array(prices, float), np.array(signal, float), np.ones(len(prices)), p)]


def test_long_only_ledger():
    """Bought at 10, cut to the capital itself as the price doubles twice, held below the entry, sold on the last bar."""
    p = B.LongOnly(capital=1000, entry_percentile=60, exit_percentile=40, fraction=0.95, turnover_cap=1.0, guard=2, gate=-1)
    got = simulated([10, 10, 20, 40, 40, 10, 10], [0, 5, 5, 5, 0, 0, 0], p)
    assert got == [(0, 1000, 0, 1000), (950, 50, 950, 1000), (1000, 950, 900, 1950), (1000, 1950, 1000, 2950), (1000, 1950, 0, 2950), (250, 1950, 0, 2200), (0, 2200, 250, 2200)]


def test_long_only_turnover_cap_and_guard():
    p = B.LongOnly(capital=1000, entry_percentile=60, exit_percentile=40, turnover_cap=0.02, guard=3, gate=-1)
    got = simulated([10] * 7, [0, 5, 5, 5, 0, 0, 0], p)
    assert [r[0] for r in got] == [0, 20, 20, 20, 20, 20, 0] and got[1][1] == 980
    late = simulated([10] * 7, [0, 0, 0, 0, 5, 5, 5], p)  # no entry within the guard
    assert all(r == (0, 1000, 0, 1000) for r in late)


@pytest.mark.parametrize("signal, ledger", [
    ([0, 9, 0, -9, 0, 0], [(0, 1000, 0, 1000), (500, 500, 500, 1000), (500, 500, 0, 1000), (0, 1000, 500, 1000), (0, 1000, 0, 1000), (0, 1000, 0, 1000)]),
    ([0, -9, 0, 9, 0, 0], [(0, 1000, 0, 1000), (200, 1200, 200, 1000), (200, 1200, 0, 1000), (0, 1000, 200, 1000), (0, 1000, 0, 1000), (0, 1000, 0, 1000)]),
])
def test_long_short_ledger(signal, ledger):
    p = B.LongShort(capital=1000, long_percentile=80, short_percentile=20, long_fraction=0.5, short_fraction=0.2, cap=2000, turnover_cap=1.0, guard=1, gate=-1)
    assert simulated([10] * 6, signal, p) == ledger


def test_pair_trade(spark):
    """Short the first leg above the mean, closed where the spread crosses it."""
    spread = [0, 3, 2, -1, 0]
    rows = [("p", t, x, 10.0, 0.5, float(s), 0.0, 1.0) for t, (x, s) in enumerate(zip((20.0, 25.0, 24.0, 20.0, 20.0), spread))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["pair", "ts", "x", "y", "weight", "spread", "mean", "sd"]).assign(ts=lambda d: pd.to_datetime(d["ts"], unit="D"))).selectExpr("pair", "cast(ts as timestamp_ntz) ts", "x", "y", "weight", "spread", "mean", "sd")
    got = [(r.positive, r.negative, list(r.days_open), r.profit, r.open, r.margin) for r in K.trade_pairs(df, 1.0, 1000.0).orderBy("ts").collect()]
    # 40 shares of x sold at 25, 50 of y bought at 10; margin 1.5 * 1000 - 500, then 1.5 * 960 - 500; closed at 20.
    assert got == [(0, 0, [], 0.0, 0, 0.0), (0, 0, [], 0.0, 1, 1000.0), (0, 0, [], 0.0, 1, 940.0), (1, 0, [2], 200.0, 0, 0.0), (0, 0, [], 0.0, 0, 0.0)]


def test_ratio_strategy_by_hand(spark):
    rng = np.random.default_rng(2)
    x, y = 20 + np.cumsum(rng.standard_normal(150) * 0.2), 10 + np.cumsum(rng.standard_normal(150) * 0.1)
    d = spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "pair string, ts int, x double, y double")
    got = {r.long: r.money for r in K.ratio_strategy(d, 4, [0, 1, 2, 9, 30, 200]).collect()}
    for long in got:
        shares, owed, money = 0.0, 0.0, 0.0
        for t in range(150):
            if long < 2 or t + 1 < max(4, long):
                continue
            some = x[t - long + 1 : t + 1] / y[t - long + 1 : t + 1]
            z = (np.mean(x[t - 3 : t + 1] / y[t - 3 : t + 1]) - some.mean()) / some.std(ddof=1)
            if abs(z) > 1:
                shares, owed = shares + math.copysign(1, z), owed + math.copysign(x[t] / y[t], z)
            elif abs(z) < 0.75:
                money, shares, owed = money + shares * x[t] - owed * y[t], 0.0, 0.0
        assert abs(got[long] - money) < 1e-6, long


def test_windows_of_one_pair_are_many_tasks(spark, monkeypatch):
    """Their number follows the bars of all windows, not the few pairs or the bytes before these bars are made."""
    d = spark.range(100).selectExpr("'p' AS pair", "CAST(id AS int) AS ts", "20 + sin(id) AS x", "10 + cos(id * id) AS y")
    want = sorted(map(tuple, K.ratio_strategy(d, 4, list(range(2, 42))).collect()))
    monkeypatch.setattr(K, "GRID_ROWS", 500)
    got = K.ratio_strategy(d, 4, list(range(2, 42)))
    assert sorted(map(tuple, got.collect())) == want and any(m for *_, m in want)
    assert "REPARTITION_BY_NUM" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(pair" in plan and ", 9), REPARTITION_BY_NUM" in plan


def test_window_ranks_and_spread_ranks(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 6, 90).astype(float), rng.standard_normal(90)
    b[40] = np.nan
    got = Y.window_spearman(a, b, 12)
    for t in range(90):
        x, y = pd.Series(a[max(0, t - 11) : t + 1]), pd.Series(b[max(0, t - 11) : t + 1])
        want = x.rank().corr(y.rank()) if t >= 11 and y.notna().all() else np.nan
        assert (np.isnan(got[t]) and np.isnan(want)) or abs(got[t] - want) < 1e-9
    frame = pd.DataFrame({"k": rng.integers(0, 2, 500), "v": rng.integers(0, 90, 500).astype(float)})
    ranked = average_ranks(spark.createDataFrame(frame), "v", ["k"], "r").toPandas()
    assert np.allclose(ranked["r"], ranked.groupby("k")["v"].rank())


def test_ensemble_of_the_best_three(spark):
    rng = np.random.default_rng(7)
    y = rng.standard_normal(400)
    frame = pd.DataFrame({"id": range(400), "y": y} | {f"m{i}": s * y + n * rng.standard_normal(400) for i, (s, n) in enumerate([(1, 2), (-1, 2.2), (1, 2.4), (0, 1)])})
    out, weights = M.ensemble(spark.createDataFrame(frame), ["m0", "m1", "m2", "m3"])
    ic = frame[["m0", "m1", "m2"]].corrwith(frame["y"])
    assert [m for m, _ in weights] == list(ic.abs().sort_values(ascending=False).index)
    assert all(abs(w - ic[m] / ic.abs().sum()) < 1e-9 for m, w in weights)
    alone = M.ensemble(spark.createDataFrame(frame.assign(m0=-y)), ["m0", "m1", "m2", "m3"])[1]
    assert alone == [("m0", -1.0)]

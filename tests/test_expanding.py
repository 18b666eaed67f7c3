"""Expanding and moving order statistics against plain versions, in small blocks."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.functions import expanding as X, rolling as Y
from tidemark.plans.windows import volatility_regime


@given(st.lists(st.integers(-4, 40), max_size=60))
@settings(max_examples=300, deadline=None)
def test_earlier_smaller(x):
    assert X.earlier_smaller(np.array(x, np.int64)).tolist() == [sum(y < v for y in x[:i]) for i, v in enumerate(x)]


@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 9), st.integers(0, 9))), max_size=50), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_moving_spearman(rows, window):
    a, b = np.array([float(x) for x, _ in rows]), np.array([np.nan if y is None else float(y) for _, y in rows])
    got = Y.window_spearman(a, b, window, 0.0)
    for t in range(len(rows)):
        x, y = pd.Series(a[max(0, t - window + 1) : t + 1]), pd.Series(b[max(0, t - window + 1) : t + 1])
        if t < window - 1 or y.isna().any():
            assert np.isnan(got[t])
            continue
        p, q = x.rank().to_numpy(), y.rank().to_numpy()
        bottom = p.std() * q.std()
        assert abs(got[t] - (np.cov(p, q, ddof=0)[0, 1] / bottom if bottom > 1e-12 else 0.0)) < 1e-9


@pytest.mark.parametrize("block", [7, 1 << 14])
def test_expanding_counts(spark, block):
    r = np.random.default_rng(2)
    rows = [("hot", t, 5.0 if r.random() < 0.4 else float(r.integers(0, 30))) for t in range(400)] + [("b", t, float(r.standard_normal())) for t in range(33)] + [("c", 0, 1.0), ("d", 0, None), ("d", 1, float("nan")), ("hot", 400, None)]
    d = spark.createDataFrame(rows, "ticker string, ts int, v double").repartition(5)
    got = X.expanding_counts(d, "ticker", "ts", "v", block).toPandas().set_index(["ticker", "ts"])
    frame = pd.DataFrame(rows, columns=["k", "t", "v"]).dropna()
    assert len(got) == len(frame)
    for _, g in frame.sort_values("t").groupby("k"):
        x = g["v"].to_numpy()
        for i, (k, t) in enumerate(zip(g["k"], g["t"])):
            row = got.loc[(k, t)]
            assert (row["_m"], row["less"], row["same"]) == (i, (x[:i] < x[i]).sum(), (x[:i] == x[i]).sum())


def test_regimes(spark):
    r = np.random.default_rng(4)
    days = pd.date_range("2024-01-01", periods=300)
    frame = pd.concat([pd.DataFrame({"ticker": k, "ts": days, "close": v}) for k, v in {"a": np.cumsum(r.integers(-2, 3, 300)).astype(float), "flat": np.ones(300)}.items()])
    got = volatility_regime(spark.createDataFrame(frame, "ticker string, ts timestamp_ntz, close double"), block=16).toPandas().sort_values(["ticker", "ts"])
    for k, g in frame.groupby("ticker"):
        vol = g["close"].rolling(24, 12).std()
        want = []
        for i, v in enumerate(vol):
            seen = vol[: i + 1].dropna()
            want.append(1 if np.isnan(v) else 2 if v >= seen.quantile(2 / 3) else 0 if v <= seen.quantile(1 / 3) else 1)
        assert got[got["ticker"] == k]["v"].tolist() == want, k


def test_one_long_series(spark):
    """10**6 rows of one series, in ranges and blocks of 2**14."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    d = spark.range(1_000_000).selectExpr("'a' AS ticker", "id AS ts", "cast((id * 7919) % 1000003 as double) AS v")
    got = X.expanding_counts(d, "ticker", "ts", "v").toPandas().sort_values("ts")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (got["less"].to_numpy() == X.earlier_smaller((np.arange(1_000_000) * 7919) % 1000003)).all()

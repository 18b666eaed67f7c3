"""Filters as scans against loops, with one series over many partitions."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import filters as R


def ema(x: np.ndarray, k: int) -> np.ndarray:
    """Starts from the mean of the first k values; nothing before."""
    out, a = np.full(len(x), np.nan), 2 / (k + 1)
    start = int(np.argmax(~np.isnan(x))) if np.isnan(x).any() else 0
    if len(x) - start < k:
        return out
    v = x[start : start + k].mean()
    out[start + k - 1] = v
    for i in range(start + k, len(x)):
        v += a * (x[i] - v)
        out[i] = v
    return out


def macd(x: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9):
    m = ema(x, fast) - ema(x, slow)
    s = ema(m, signal)
    return m, s, m - s


def rsi(x: np.ndarray, k: int = 14) -> np.ndarray:
    """With Wilder's smoothing."""
    out = np.full(len(x), np.nan)
    d = np.diff(x)
    if len(d) < k:
        return out
    up, down = np.maximum(d[:k], 0).mean(), np.maximum(-d[:k], 0).mean()
    for i in range(k, len(x)):
        if i > k:
            up, down = (up * (k - 1) + max(d[i - 1], 0)) / k, (down * (k - 1) + max(-d[i - 1], 0)) / k
        out[i] = 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    return out


def kalman(x: np.ndarray, q: float = 0.01, r: float = 1.0, mean: float = 0.0, var: float = 1.0) -> np.ndarray:
    """Level of a random walk with noise."""
    out = np.empty(len(x))
    for i, v in enumerate(x):
        p = var if i == 0 else var + q
        gain = p / (p + r)
        mean, var = mean + gain * (v - mean), (1 - gain) * p
        out[i] = mean
    return out


def _step(x: np.ndarray, low: np.ndarray, high: np.ndarray):
    at = (2 * np.arange(len(x) // 2)[:, None] + np.arange(len(low))[None, :]) % len(x)
    return x[at] @ low, x[at] @ high, at


def denoise(x: np.ndarray, levels: int = 3, share: float = 0.5) -> np.ndarray:
    """Soft threshold of the details at a share of the greatest value, on a periodic orthogonal transform."""
    low = np.array(R.DB6)[::-1]
    high = low[::-1] * (-1.0) ** np.arange(len(low))
    n, block = len(x), 1 << levels
    a, kept = np.pad(x, (0, -n % block), mode="edge"), []
    for _ in range(levels):
        if len(a) < len(low):
            break
        a, d, at = _step(a, low, high)
        kept.append((d, at))
    t = share * max((np.abs(d).max() for d, _ in kept), default=0.0)
    for d, at in reversed(kept):
        d = np.sign(d) * np.maximum(np.abs(d) - t, 0)
        out = np.zeros(2 * len(a))
        np.add.at(out, at, a[:, None] * low[None, :] + d[:, None] * high[None, :])
        a = out
    return a[:n]


@pytest.fixture
def many(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)


def series(seed):
    r = np.random.default_rng(seed)
    found = {"long": 100 + np.cumsum(r.standard_normal(700)), "flat": np.full(60, 7.0)} | {f"s{n}": r.standard_normal(n) for n in (1, 2, 11, 12, 14, 15, 16, 26, 34, 40, 97)}
    return found, pd.concat([pd.DataFrame({"ticker": k, "ts": pd.date_range("2024-01-01", periods=len(v)), "close": v}) for k, v in found.items()])


def test_filters_against_loops(many):
    found, frame = series(1)
    d = many.createDataFrame(frame, "ticker string, ts timestamp_ntz, close double").repartition(5)
    for run, loop in (
        (R.rsi(d, "close"), lambda x: [rsi(x)]), (R.macd(d, "close"), macd), (R.kalman(d, "close", q=0.2, mean=3.0, var=0.5), lambda x: [kalman(x, 0.2, 1.0, 3.0, 0.5)]),
        (R.ema(d, "close", 10), lambda x: [ema(x, 10)]), (R.denoise(d, "close"), lambda x: [denoise(x)]),
    ):
        got = run.toPandas().sort_values(["ticker", "ts"])
        assert len(got) == len(frame)
        for k, x in found.items():
            mine = got[got["ticker"] == k].iloc[:, 2:].to_numpy(float)
            assert np.allclose(mine, np.array(list(loop(x))).T, equal_nan=True, atol=1e-9), (k, got.columns)


def test_missing_values_are_passed_over(many):
    found, frame = series(2)
    x = found["long"].copy()
    x[[0, 1, 5, 300, 301, 699]] = np.nan
    rows = pd.DataFrame({"ticker": "a", "ts": pd.date_range("2024-01-01", periods=700), "close": x})
    d = many.createDataFrame(rows, "ticker string, ts timestamp_ntz, close double")
    known = ~np.isnan(x)
    for run, loop in ((R.rsi(d, "close"), rsi), (R.kalman(d, "close"), kalman), (R.ema(d, "close", 5), lambda x: ema(x, 5))):
        got = run.toPandas().sort_values("ts").iloc[:, 2].to_numpy(float)
        assert np.isnan(got[~known]).all() and np.allclose(got[known], loop(x[known]), equal_nan=True)


def test_ema_against_pandas():
    x = np.arange(40.0) ** 1.5
    want = pd.Series(np.r_[[x[:10].mean()], x[10:]]).ewm(span=10, adjust=False).mean()
    assert np.allclose(ema(x, 10)[9:], want)


def test_denoise_without_threshold_gives_the_series_back(many):
    found, frame = series(3)
    d = many.createDataFrame(frame, "ticker string, ts timestamp_ntz, close double")
    got = R.denoise(d, "close", share=0.0).toPandas().merge(frame, on=["ticker", "ts"])
    assert len(got) == len(frame) and np.allclose(got["smooth"], got["close"], atol=1e-8)


def test_one_long_series(many):
    """10**6 rows of one series, in 40 partitions."""
    many.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    many.conf.set("spark.sql.shuffle.partitions", "40")
    d = many.range(1_000_000).selectExpr("'a' AS ticker", "timestamp_ntz'2000-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "sin(id) + id % 7 AS close")
    got = R.rsi(d, "close").toPandas().sort_values("ts")["rsi"].to_numpy()
    i = np.arange(1_000_000)
    assert np.allclose(got, rsi(np.sin(i) + i % 7), equal_nan=True)

"""Tests of unit roots and cointegration from moments of blocks, against regressions on the whole series."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import pairs as K


@pytest.mark.parametrize("block", [None, 30])
def test_adf_from_moments(spark, block):
    r = np.random.default_rng(3)
    found = {"walk": 1000 + np.cumsum(r.standard_normal(400)), "noise": 5 + r.standard_normal(150), "short": r.standard_normal(9), "tiny": np.array([1.0, 2.0, 4.0, 3.0, 5.5, 4.5]), "wave": np.sin(np.arange(200) / 3) + 0.1 * r.standard_normal(200)}
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"name": k, "ts": range(len(v)), "v": v}) for k, v in found.items()])).repartition(4)
    got = K.adf_table(d, "name", "v", block=block).toPandas().set_index("name")
    for k, v in found.items():
        stat, lags, n = K.adf(v)
        assert got.loc[k, "lags"] == lags and abs(got.loc[k, "stat"] - stat) < 1e-5 * max(1, abs(stat)), k
        assert abs(got.loc[k, "p"] - K.p_value(stat)) < 1e-5 and abs(got.loc[k, "c5"] - K.critical_values(n)[1]) < 1e-12


@pytest.mark.parametrize("most,block", [(None, None), (None, 40), (1, 16)])
def test_engle_granger_from_moments(spark, most, block):
    r = np.random.default_rng(4)
    x = np.cumsum(r.standard_normal(300)) + 50
    found = {("a", "b"): (2 * x + r.standard_normal(300), x), ("a", "c"): (x, np.cumsum(r.standard_normal(300))), ("d", "e"): (3 * x + 1, x), ("f", "g"): (x[:20], r.standard_normal(20))}
    d = spark.createDataFrame(pd.concat([pd.DataFrame({"a": a, "b": b, "ts": range(len(u)), "x": u, "y": v}) for (a, b), (u, v) in found.items()])).repartition(4)
    got = {(w.a, w.b): (w.stat, w.p) for w in K.cointegration_scan(d, most, block).collect()}
    for k, (u, v) in found.items():
        stat, p = K.engle_granger(u, v, most)
        assert np.isclose(got[k][0], stat, rtol=1e-5) and abs(got[k][1] - p) < 1e-6, k


def test_one_long_series(spark):
    """10**6 rows in blocks of 2**14, none gathered."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    d = spark.range(1_000_000).selectExpr("'a' AS name", "id AS ts", "sin(id * id % 10007) AS v")
    got = K.adf_table(d, "name", "v").first()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    i = np.arange(1_000_000, dtype=np.int64)
    v = np.sin(i * i % 10007)
    k = got.lags
    rows = np.arange(k, len(v) - 1)
    change = np.diff(v)
    u = np.stack([v[rows], *[change[rows - j] for j in range(1, k + 1)], np.ones(len(rows))], axis=1)
    beta, e, se = K._least_squares(u, change[rows])
    assert abs(got.stat / (beta[0] / se[0]) - 1) < 1e-4


@pytest.mark.parametrize("seed", range(40))
def test_max_sharpe_meets_its_conditions(seed):
    from tidemark.operators.models import max_sharpe_weights

    r = np.random.default_rng(seed)
    n = int(r.integers(1, 12))
    x = r.standard_normal((60, n))
    cov, mean = x.T @ x / 60 + 0.01 * np.eye(n), r.standard_normal(n) - 0.3
    w = max_sharpe_weights(mean, cov)
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-12
    if (mean > 0).any():
        ratio = lambda v: v @ mean / np.sqrt(v @ cov @ v)
        gap = mean * (w @ cov @ w) / (w @ mean) - cov @ w  # zero where held, not positive elsewhere
        assert np.abs(gap[w > 0]).max() < 1e-9 and gap.max() < 1e-9
        assert all(ratio(w) >= ratio(v) - 1e-12 for v in r.dirichlet(np.ones(n), 200))
    else:
        assert mean[w > 0] / np.sqrt(np.diag(cov))[w > 0] == (mean / np.sqrt(np.diag(cov))).max()

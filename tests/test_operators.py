"""Numeric fixtures, simulators, sources and streams."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tidemark.functions import stats as S
from tidemark.operators import backtest as B, leadlag as G, models as M, pairs as K
from tidemark.operators.timing import PhaseTimer
from tidemark.sources import readers, synthetic, writers


def path(spark, x, y):
    return spark.createDataFrame([("p", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k string, ts int, x double, y double")


def test_signature_fixture(spark):
    r = G.signature(path(spark, (1, 3, 5, 8), (1, 4, 2, 6)), ["k"]).first()
    assert [r.s1, r.s2, r.s11, r.s12, r.s21, r.s22, r.levy] == [7, 5, 24.5, 19, 16, 12.5, 1.5]
    assert G.signature(path(spark, (0, 0.5, 2, 2.5), (0.5, 2, 2.5, 3.5)), ["k"]).first().levy < 0


def test_lag_of_a_follower(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(400)
    for sign in (1, -1):
        y = np.r_[0, sign * 0.5 * x[:-1]] + 0.1 * rng.standard_normal(400)
        d = spark.createDataFrame([("a", "b", i, float(p), float(q)) for i, (p, q) in enumerate(zip(x, y))], "a string, b string, place int, x double, y double")
        rho = G.lagged_correlations(d, 3)
        assert G.best_lag(rho).first().c1 == 1 and G.signed_mass(rho).first().c2 > 0


def test_corrected_moments(spark):
    r = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 9, 20)], "v double").agg(S.corrected_skew("v").alias("s"), S.corrected_kurtosis("v").alias("k"), F.skewness("v").alias("p")).first()
    assert abs(r.s - 1.49012) < 1e-4 and abs(r.k - 1.89543) < 1e-4 and abs(r.p - 0.99960) < 1e-4


def test_guarded_statistics(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0)] * 6, "g int, x double, y double")
    assert d.agg(S.pearson("x", "y").alias("v")).first().v is None
    assert S.spearman(d, "x", "y", ["g"]).first().ic is None


def test_models_on_gram_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 3)) * [1, 5, 0.2] + [0, 3, -1]
    y = x @ [2.0, -0.5, 4.0] + 1 + 0.1 * rng.standard_normal(300)
    df = spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=["a", "b", "c", "y"]))
    g = M.gram(df, ["a", "b", "c"])
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)
    m = M.fit_ols(g)
    assert np.allclose([m.intercept, *m.coefficients], beta, atol=1e-6)
    z = (x - x.mean(0)) / x.std(0)
    ridge = np.linalg.solve(z.T @ z + 10 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(M.fit_ridge(g, 10.0).coefficients, ridge, atol=1e-6)
    assert np.allclose(M.fit_lasso(g, 0.0, 5000, 1e-12).coefficients, beta[1:], atol=1e-5)
    assert not M.fit_lasso(g, 100.0).coefficients.any()
    w = M.max_sharpe_weights(np.array([0.1, 0.05]), np.diag([0.04, 0.04]))
    assert abs(w.sum() - 1) < 1e-9 and np.allclose(w, [2 / 3, 1 / 3], atol=0.02)


def test_model_round_trip(spark, tmp_path):
    M.save_model(M.Linear(["a"], 1.5, np.array([-2.0])), spark, f"{tmp_path}/m")
    m = M.load_model(spark, f"{tmp_path}/m")
    assert (m.features, m.intercept, m.coefficients.tolist()) == (["a"], 1.5, [-2.0]) and "- 2.000000*a" in m.formula()


def runs(spark, n=200):
    rng = np.random.default_rng(2)
    p = 100 * np.exp(np.cumsum(0.01 * rng.standard_normal(n)))
    return spark.createDataFrame([("r", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), float(v), float(rng.standard_normal()), 1.0) for i, v in enumerate(p)], "run string, ts timestamp_ntz, price double, signal double, regime double")


@pytest.mark.parametrize("strategy, cap", [(B.LongOnly(), 1e6), (B.LongShort(), 2e6)])
def test_simulators_write_ledgers_that_pass(spark, strategy, cap):
    d = B.backtest(runs(spark), strategy)
    v = B.violations(d).first()
    assert v.valid and d.agg(F.sum("turnover")).first()[0] > 0
    assert B.grades(d, cap + 1).first().status in ("valid", "margin")
    shut = B.backtest(runs(spark).withColumn("regime", F.lit(-1.0)), strategy)
    assert shut.agg(F.sum("turnover")).first()[0] == 0


NEGATIVE = ("negative_exposure", "negative_turnover", "nav_off", "not_finite", "cash_off", "not_flat", "repeated_time", "no_time")


@pytest.mark.parametrize("rule", NEGATIVE)
def test_each_broken_rule_is_found(spark, rule):
    d = B.backtest(runs(spark, 60), B.LongOnly()).toPandas().sort_values("ts").reset_index(drop=True)
    column, value = {"negative_exposure": ("exposure", -3.0), "negative_turnover": ("turnover", -3.0), "nav_off": ("nav", 5.0), "not_finite": ("nav", float("inf")), "cash_off": ("turnover", 77.0), "not_flat": ("exposure", 9.0), "repeated_time": ("ts", d["ts"][9]), "no_time": ("ts", None)}[rule]
    d.loc[0 if rule == "not_flat" else 10, column] = value
    v = B.violations(spark.createDataFrame(d, B.LEDGER)).first()
    assert v[rule] > 0 and not v.valid


def test_constant_nav_and_bankruptcy(spark):
    rows = [("r", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=5 * i), 0.0, 1e6, 0.0, 1e6) for i in range(5)]
    d = spark.createDataFrame(rows, B.LEDGER)
    assert B.graded_sharpe(d).first().sharpe == 0 and B.grades(d, 1e6, rows=5).first().status == "valid" and B.grades(d, 1e6, rows=6).first().status == "structure"


def test_cointegration():
    rng = np.random.default_rng(5)
    x = np.cumsum(rng.standard_normal(600))
    stat, p = K.engle_granger(x + rng.standard_normal(600), x)
    assert p < 0.01
    assert K.engle_granger(np.cumsum(rng.standard_normal(600)), x)[1] > 0.05
    assert K.p_value(K.adf(rng.standard_normal(300))[0]) < 0.01 < K.p_value(K.adf(x)[0])
    assert np.allclose(K.critical_values(10**9), [-3.43035, -2.86154, -2.56677])
    values, vectors, trace, rank = K.johansen(np.c_[x, 2 * x + rng.standard_normal(600)])
    assert rank >= 1 and trace[0] > 100 and abs(vectors[0, 0] / vectors[1, 0] + 2) < 0.1


def test_sources_round_trip(spark, tmp_path):
    bars = spark.createDataFrame([(dt.datetime(2024, 1, 1), "TICKER_01", 1.5, 2.0), (dt.datetime(2024, 1, 2), "TICKER_00", None, 3.0)], readers.BARS)
    writers.write_csv(bars, f"{tmp_path}/bars", ["Timestamp"])
    got = readers.read_bars(spark, f"{tmp_path}/bars").orderBy("ts").collect()
    assert [(r.ticker, r.close, r.volume) for r in got] == [("TICKER_01", 1.5, 2.0), ("TICKER_00", None, 3.0)]
    for kind in ("longonly", "longshort"):
        (tmp_path / f"red_{kind}_results.csv").write_text("Timestamp,Gross_Exposure,Cash_Balance,Interval_Turnover,Gross_NAV\n2024-01-01 09:30:00,0,1000000,0,1000000\nbad,x,1,2,3\n")
    a, b = readers.team_ledgers(spark, str(tmp_path))
    assert {(r.run, r.broken) for r in a.collect()} == {("red", False), ("red", True)} and b.count() == 2
    (tmp_path / "f.csv").write_text("skip\nskip\n1,2.5\n2,3.5\ntail\n")
    assert [tuple(r) for r in readers.read_skipping(spark, f"{tmp_path}/f.csv", "a int, b double", 2, 1).collect()] == [(1, 2.5), (2, 3.5)]
    writers.write_json_artifact(spark, {"signal_sign": 1}, f"{tmp_path}/sign")
    assert readers.read_json_artifact(spark, f"{tmp_path}/sign") == {"signal_sign": 1}
    store, calls = readers.Store(spark, f"{tmp_path}/store"), []
    for _ in range(2):
        assert store.compute("a/b", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1]
    with pytest.raises(LookupError):
        readers.read_vendor(spark, "none")
    readers.register_vendor("range", lambda s, n: s.range(n))
    assert readers.read_vendor(spark, "range", n=2).count() == 2


def test_synthetic(spark):
    assert synthetic.normal_walk(spark, 10, 2).count() == 20
    assert {r.x for r in synthetic.square_wave(spark, 8, 4).collect()} == {1.0, -1.0}
    assert synthetic.sigmoid_follower(synthetic.normal_walk(spark, 10)).where("y IS NULL").count() == 1
    d = synthetic.cointegrated_pair(spark, 300, 2.0).orderBy("t").toPandas()
    assert K.engle_granger(d["y"].to_numpy(), d["x"].to_numpy())[1] < 0.01


def test_walk_is_many_tasks(spark):
    """One series goes through all partitions of the range, without a shuffle, and its sums are those of one window."""
    n = 30_000
    walk = synthetic.normal_walk(spark, n, 2, seed=3)
    steps = spark.range(2 * n).select((F.col("id") / n).cast("long").alias("series"), (F.col("id") % n).alias("t"), F.randn(3).alias("e"))
    want = steps.select("series", "t", F.sum("e").over(Window.partitionBy("series").orderBy("t")).alias("y"))
    assert walk.rdd.getNumPartitions() == spark.range(n).rdd.getNumPartitions() > 1
    assert "Exchange" not in walk._jdf.queryExecution().executedPlan().toString()
    assert walk.join(want, ["series", "t"]).where(F.abs(F.col("x") - F.col("y")) < 1e-9).count() == 2 * n
    assert synthetic.normal_walk(spark, 0, 2).count() == 0


def test_phase_timer(spark, tmp_path):
    t = PhaseTimer()
    with t.phase("a", "m"):
        pass
    t.save(spark, str(tmp_path))
    assert t.by_module(spark).count() == 1 and "total" in t.report()


def stream(spark, tmp_path, name, df, make, key):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
    s = make(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}"))
    q = s.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}_state").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).orderBy(*key).toPandas()


def test_streams(spark, tmp_path):
    from tidemark.streaming import bars as T

    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), i, float(i)) for i in range(40)]
    ticks = spark.createDataFrame(rows, "series long, ts timestamp, tie long, x double")
    got = stream(spark, tmp_path, "bars", ticks, T.bars_from_ticks, ["ts"])
    assert got["n"].tolist()[:5] == [5] * 5 and got["close"].tolist()[:2] == [4.0, 9.0]
    closes = spark.createDataFrame([(1, r[1], r[3]) for r in rows], "series long, ts timestamp, close double").coalesce(1)
    got = stream(spark, tmp_path, "features", closes, T.running_features, ["ts"])
    assert got["momentum"].tolist()[5:8] == [5.0] * 3 and got["mean"].iloc[9] == sum(range(4, 10)) / 6
    signals = spark.createDataFrame([("r", r[1], 10.0 + r[3], 1.0 if r[3] < 20 else -1.0) for r in rows], "run string, ts timestamp, price double, signal double").coalesce(1)
    got = stream(spark, tmp_path, "ledger", signals, lambda d: T.trade(d, 0.5, 0.0), ["ts"])
    assert got["shares"].iloc[0] > 0 and got["shares"].iloc[-1] == 0 and got["nav"].iloc[-1] > 1e6
    assert T.breaches(spark.createDataFrame(got, T.LEDGER)).count() == 0

"""Window and time-series queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.functions.expanding import at_least, at_most, expanding_counts
from tidemark.functions.rolling import rolling_spearman
from tidemark.functions.stats import exact_quantiles
from tidemark.plans.registry import query
from tidemark.plans.views import SPEARMAN, bars, ticks

OVER = "PARTITION BY series ORDER BY ts, tie"
BAR = "PARTITION BY ticker ORDER BY ts"


def tick():
    return W.series_order("series")


def day():
    return W.series_order("ticker", by=("ts",))




def frame(k: int, over: str = OVER) -> str:
    return f"({over} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def rolled(expr: str, k: int, least: int, c: str = "x", over: str = OVER) -> str:
    return f"CASE WHEN count({c}) OVER {frame(k, over)} >= {least} THEN {expr} OVER {frame(k, over)} END"


def on_ticks(name: str, make, sql: str, kind: str = "d") -> None:
    query(name, f"series:l ts:t tie:l v:{kind}", lambda s, d: ticks(s, d).select("series", "ts", "tie", make().alias("v")), f"SELECT series, ts, tie, {sql} AS v FROM ticks", ("ticks",))


def on_bars(name: str, make, sql: str, kind: str = "d", before: str = "bars", prepare=lambda df: df) -> None:
    query(name, f"ticker:s ts:t v:{kind}", lambda s, d: prepare(bars(s, d)).select("ticker", "ts", make().alias("v")), f"SELECT ticker, ts, {sql} AS v FROM {before}", ("bars",))


on_ticks("w01_rolling_mean", lambda: W.rolling_mean("x", tick(), 12), rolled("avg(x)", 12, 6))
on_ticks("w02_rolling_median", lambda: W.rolling_median("x", tick(), 6), rolled("median(x)", 6, 3))
on_ticks("w03_rolling_std", lambda: W.rolling_std("x", tick(), 24), rolled("stddev_samp(x)", 24, 12))
on_ticks("w04_rolling_zscore", lambda: W.rolling_zscore("x", tick(), 12), f"(x - {rolled('avg(x)', 12, 6)}) / nullif({rolled('stddev_samp(x)', 12, 6)}, 0)")
on_ticks("w05_lag", lambda: W.lagged("x", tick(), 3), f"lag(x, 3) OVER ({OVER})")
on_ticks("w06_momentum", lambda: W.momentum("x", tick(), 6), f"x - lag(x, 6) OVER ({OVER})")
on_ticks("w07_pct_change", lambda: W.pct_change("x", tick(), 5), f"x / nullif(lag(x, 5) OVER ({OVER}), 0) - 1")
CORR = "CASE WHEN count(close) OVER {f} >= {k} AND stddev_pop(close) OVER {f} * stddev_pop(volume) OVER {f} > 1e-14 THEN covar_pop(close, volume) OVER {f} / (stddev_pop(close) OVER {f} * stddev_pop(volume) OVER {f}) END"
on_bars("w08_rolling_correlation", lambda: W.rolling_correlation("close", "volume", day(), 20), CORR.format(f=frame(20, BAR), k=20))
on_bars("w09_rolling_beta", lambda: W.rolling_beta("close", "volume", day(), 20), f"CASE WHEN count(close) OVER {frame(20, BAR)} >= 20 THEN covar_samp(close, volume) OVER {frame(20, BAR)} / nullif(var_samp(volume) OVER {frame(20, BAR)}, 0) END")
LO, HI = rolled("min(close)", 20, 20, "close", BAR), rolled("max(close)", 20, 20, "close", BAR)
on_bars("w10_price_position", lambda: W.price_position("close", day(), 20), f"(close - {LO}) / ({HI} - {LO} + 1e-12)")
on_bars("w11_volume_ratio", lambda: W.ratio_to_mean("volume", day(), 20), f"volume / ({rolled('avg(volume)', 20, 20, 'volume', BAR)} + 1e-12)")


def _changes(df):
    return df.select("ticker", "ts", W.pct_change("close", day()).alias("a"), W.pct_change("volume", day()).alias("b"))


query(
    "w12_price_volume_correlation", "ticker:s ts:t v:d", lambda s, d: _changes(bars(s, d)).select("ticker", "ts", W.rolling_correlation("a", "b", day(), 20).alias("v")),
    f"WITH c AS (SELECT ticker, ts, close / lag(close) OVER ({BAR}) - 1 AS a, volume / lag(volume) OVER ({BAR}) - 1 AS b FROM bars)\nFINALLY SELECT ticker, ts, "
    + CORR.format(f=frame(20, BAR), k=20).replace("close", "a").replace("volume", "b") + " AS v FROM c", ("bars",),
)


def feature_set(df, windows=(5, 10, 20, 50)):
    """All bar features of each window in one projection over shared frames."""
    out = []
    for k in windows:
        out += [W.pct_change("close", day(), k).alias(f"ret_{k}"), W.rolling_mean("close", day(), k, k).alias(f"ma_{k}"), W.rolling_std("close", day(), k, k).alias(f"std_{k}"), W.rolling_max("close", day(), k, k).alias(f"max_{k}"),
                W.rolling_min("close", day(), k, k).alias(f"min_{k}"), W.price_position("close", day(), k).alias(f"pos_{k}"), W.momentum("close", day(), k).alias(f"mom_{k}"), W.ratio_to_mean("volume", day(), k).alias(f"vol_{k}")]
    return df.select("ticker", "ts", *out)


def _feature_sql(k):
    r = lambda e, c="close": rolled(e, k, k, c, BAR)
    return f"close / lag(close, {k}) OVER ({BAR}) - 1 AS ret_{k}, {r('avg(close)')} AS ma_{k}, {r('stddev_samp(close)')} AS std_{k}, {r('max(close)')} AS max_{k}, {r('min(close)')} AS min_{k}, (close - {r('min(close)')}) / ({r('max(close)')} - {r('min(close)')} + 1e-12) AS pos_{k}, close - lag(close, {k}) OVER ({BAR}) AS mom_{k}, volume / ({r('avg(volume)', 'volume')} + 1e-12) AS vol_{k}"


query("w13_bar_features", "ticker:s ts:t " + " ".join(f"{n}_{k}:d" for k in (5, 10, 20, 50) for n in "ret ma std max min pos mom vol".split()), lambda s, d: feature_set(bars(s, d)), "SELECT ticker, ts, " + ", ".join(map(_feature_sql, (5, 10, 20, 50))) + " FROM bars", ("bars",))


def volatility_regime(df, key="ticker", c="close", k=24, parts=3, block=None):
    """0, 1 or 2 by the expanding 1/parts and (parts-1)/parts quantiles of the rolling deviation; 1 where that is missing.

    Where a value stands against the quantiles follows from counts of earlier values, which are taken in blocks.
    """
    vol = df.select(key, "ts", W.rolling_std(c, W.series_order(key, by=("ts",)), k).alias("vol"))
    counted = expanding_counts(vol, key, "ts", "vol", block)
    label = F.when(at_least((parts - 1) / parts), 2).when(at_most(1 / parts), 0).otherwise(1)
    return vol.select(key, "ts").join(counted.select(key, "ts", label.alias("v")), [key, "ts"], "left").na.fill(1, ["v"])


E = f"({BAR} ROWS UNBOUNDED PRECEDING)"
query("w14_volatility_regime", "ticker:s ts:t v:l", lambda s, d: volatility_regime(bars(s, d)), f"WITH v AS (SELECT ticker, ts, {rolled('stddev_samp(close)', 24, 12, 'close', BAR)} AS vol FROM bars)\nFINALLY SELECT ticker, ts, CASE WHEN vol >= quantile_cont(vol, 2.0 / 3) OVER {E} THEN 2 WHEN vol <= quantile_cont(vol, 1.0 / 3) OVER {E} THEN 0 ELSE 1 END AS v FROM v", ("bars",))
on_ticks("w15_trend_regime", lambda: W.trend_regime("x", tick()), f"coalesce(CAST({rolled('avg(x)', 6, 3)} > {rolled('avg(x)', 24, 12)} AS INT), 0)", "l")
on_bars("w16_cross_sectional_rank", lambda: W.cross_rank("volume", "ts"), "(rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY ts)")
on_bars("w17_relative_spread", lambda: F.col("close") - F.avg("close").over(Window.partitionBy("ts")), "close - avg(close) OVER (PARTITION BY ts)")


def engineered(df, windows=(6, 12, 24), lags=(1, 3, 6, 12, 24)):
    """Long-form engineered features in one projection, then the cross-section."""
    cols = [f(c, day(), k).alias(f"{c}_{n}_{k}") for c in ("close", "volume") for k in windows for n, f in (("rmean", W.rolling_mean), ("rstd", W.rolling_std), ("rzsc", W.rolling_zscore))]
    cols += [W.rolling_zscore(c, day(), 3).alias(f"{c}_rzsc_3") for c in ("close", "volume")]
    cols += [f(c, day(), k).alias(f"{c}_{n}{k}") for c in ("close", "volume") for k in lags for n, f in (("lag", W.lagged), ("mom", W.momentum))]
    cols += [W.trend_regime("close", day()).alias("close_trendreg"), W.cross_rank("close", "ts").alias("close_csrank"), (F.col("close") - F.avg("close").over(Window.partitionBy("ts"))).alias("close_spread"), (F.col("close") * F.col("volume")).alias("close_x_volume")]
    return df.select("ticker", "ts", *cols)


def _engineered():
    names, sql = [], []

    def add(n, e, k="d"):
        names.append(f"{n}:{k}")
        sql.append(f"{e} AS {n}")

    for c in ("close", "volume"):
        for k in (6, 12, 24):
            m, s = (rolled(f"{a}({c})", k, k // 2, c, BAR) for a in ("avg", "stddev_samp"))
            add(f"{c}_rmean_{k}", m)
            add(f"{c}_rstd_{k}", s)
            add(f"{c}_rzsc_{k}", f"({c} - {m}) / nullif({s}, 0)")
        m, s = (rolled(f"{a}({c})", 3, 1, c, BAR) for a in ("avg", "stddev_samp"))
        add(f"{c}_rzsc_3", f"({c} - {m}) / nullif({s}, 0)")
        for k in (1, 3, 6, 12, 24):
            add(f"{c}_lag{k}", f"lag({c}, {k}) OVER ({BAR})")
            add(f"{c}_mom{k}", f"{c} - lag({c}, {k}) OVER ({BAR})")
    add("close_trendreg", f"coalesce(CAST({rolled('avg(close)', 6, 3, 'close', BAR)} > {rolled('avg(close)', 24, 12, 'close', BAR)} AS INT), 0)", "l")
    add("close_csrank", "(rank() OVER (PARTITION BY ts ORDER BY close) + (count(*) OVER (PARTITION BY ts, close) - 1) / 2.0) / count(close) OVER (PARTITION BY ts)")
    add("close_spread", "close - avg(close) OVER (PARTITION BY ts)")
    add("close_x_volume", "close * volume")
    return "ticker:s ts:t " + " ".join(names), "SELECT ticker, ts, " + ", ".join(sql) + " FROM bars"


query("w18_engineer_features", _engineered()[0], lambda s, d: engineered(bars(s, d)), _engineered()[1], ("bars",))


def scoring_features(df):
    cols = [W.momentum("close", day(), k).alias(f"mom{k}") for k in (1, 3, 6, 12, 24)]
    cols += [((F.col("close") - W.rolling_mean("close", day(), k, k)) / (W.rolling_std("close", day(), k, k) + 1e-12)).alias(f"z{k}") for k in (3, 6, 12, 24)]
    return df.select("ticker", "ts", *cols)


query("w19_scoring_features", "ticker:s ts:t mom1:d mom3:d mom6:d mom12:d mom24:d z3:d z6:d z12:d z24:d", lambda s, d: scoring_features(bars(s, d)),
      "SELECT ticker, ts, " + ", ".join([f"close - lag(close, {k}) OVER ({BAR}) AS mom{k}" for k in (1, 3, 6, 12, 24)] + [f"(close - {rolled('avg(close)', k, k, 'close', BAR)}) / ({rolled('stddev_samp(close)', k, k, 'close', BAR)} + 1e-12) AS z{k}" for k in (3, 6, 12, 24)]) + " FROM bars", ("bars",))
on_bars("w20_target_return", lambda: W.forward_return("close", day(), 3), f"lead(close, 3) OVER ({BAR}) / close - 1")
on_bars("w20_target_log_return", lambda: W.forward_return("close", day(), 1, "log_return"), f"ln(lead(close) OVER ({BAR}) / close)")
on_bars("w20_target_directional", lambda: W.forward_return("close", day(), 1, "directional"), f"coalesce(CAST(lead(close) OVER ({BAR}) > close AS INT), 0)", "l")


def misaligned(s, d):
    """The audit of two stored targets, one right and one that was made a bar too early, against the return to the next bar."""
    stored = bars(s, d).select("ticker", "ts", "close", (F.lead("close").over(day()) / F.col("close") - 1).alias("good"), (F.col("close") / F.lag("close").over(day()) - 1).alias("early"))
    gap = lambda c: F.avg(F.abs(F.col(c) - F.col("truth"))).alias(c)
    return stored.withColumn("truth", W.forward_return("close", day())).groupBy("ticker").agg(gap("good"), gap("early"))


query(
    "w21_target_alignment", "ticker:s good:d early:d", misaligned,
    f"WITH t AS (SELECT ticker, lead(close) OVER ({BAR}) / close - 1 AS truth, close / lag(close) OVER ({BAR}) - 1 AS early FROM bars)\nFINALLY SELECT ticker, CASE WHEN count(truth) > 0 THEN 0 END AS good, avg(abs(early - truth)) AS early FROM t GROUP BY ticker",
    ("bars",),
)
on_bars("w22_drawdown", lambda: W.drawdown("close", day()), f"(close - max(close) OVER {E}) / (max(close) OVER {E} + 1e-12)")
on_bars("w23_running_sum", lambda: W.running_sum("volume", day()), f"sum(volume) OVER {E}")
query("w23_running_product", "ticker:s ts:t v:d", lambda s, d: bars(s, d).select("ticker", "ts", F.coalesce(1 + W.pct_change("close", day()) / 5000, F.lit(1.0)).alias("g")).select("ticker", "ts", W.running_product("g", day()).alias("v")), f"WITH g AS (SELECT ticker, ts, coalesce(1 + (close / lag(close) OVER ({BAR}) - 1) / 5000, 1) AS g FROM bars)\nFINALLY SELECT ticker, ts, exp(sum(ln(g)) OVER {E}) AS v FROM g", ("bars",))
on_bars("w24_change", lambda: W.change("close", day(), 1000.0), f"close - coalesce(lag(close) OVER ({BAR}), 1000)")
query("w25_rolling_ic", "ticker:s ts:t v:d", lambda s, d: bars(s, d).select("ticker", "ts", F.col("volume").alias("a"), W.forward_return("close", day()).alias("b")).select("ticker", "ts", W.rolling_correlation("a", "b", day(), 50).alias("v")),
      f"WITH c AS (SELECT ticker, ts, lead(close) OVER ({BAR}) / close - 1 AS b, CASE WHEN lead(close) OVER ({BAR}) IS NOT NULL THEN volume END AS a FROM bars)\nFINALLY SELECT ticker, ts, " + CORR.format(f=frame(50, BAR), k=50).replace("close", "a").replace("volume", "b") + " AS v FROM c", ("bars",))
RANK_IC = SPEARMAN.format(
    head="rows AS (SELECT ticker AS key, ts, row_number() OVER w AS n, volume AS a, lead(close) OVER w / close - 1 AS b FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))",
    last=49, window=50, flat="NULL",
)
query(
    "w25_rolling_rank_ic", "ticker:s ts:t v:d",
    lambda s, d: rolling_spearman(bars(s, d).select("ticker", "ts", F.col("volume").cast("double").alias("a"), W.forward_return("close", day()).alias("b")), "ticker", "ts", "a", "b", 50).select("ticker", "ts", "v"),
    f"WITH {RANK_IC}\nFINALLY SELECT key AS ticker, ts, v FROM rho", ("bars",),
)
LATE = f"({BAR} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"
on_bars("w29_beta_through_origin", lambda: W.beta_through_origin("close", "volume", day(), 30), f"CASE WHEN count(volume) OVER {LATE} >= 30 THEN sum(volume * close) OVER {LATE} / sum(volume * volume) OVER {LATE} END")
on_bars("w30_spread_zscore", lambda: W.spread_zscore("close", day(), 5, 60), f"({rolled('avg(close)', 5, 5, 'close', BAR)} - {rolled('avg(close)', 60, 60, 'close', BAR)}) / nullif({rolled('stddev_samp(close)', 60, 60, 'close', BAR)}, 0)")
for _i, _n in enumerate(("lower", "middle", "upper")):
    on_bars(f"w31_bollinger_{_n}", lambda i=_i: W.bollinger("close", day())[i], f"{rolled('avg(close)', 21, 21, 'close', BAR)} + {(_i - 1) * 2.0} * {rolled('stddev_pop(close)', 21, 21, 'close', BAR)}")
query("w34_reverse_product", "ticker:s ts:t v:d", lambda s, d: bars(s, d).select("ticker", "ts", (1 + F.coalesce(W.pct_change("close", day()), F.lit(0.0)) / 5000).alias("g")).select("ticker", "ts", W.running_product("g", Window.partitionBy("ticker").orderBy(F.desc("ts"))).alias("v")), f"WITH g AS (SELECT ticker, ts, 1 + coalesce(close / lag(close) OVER ({BAR}) - 1, 0) / 5000 AS g FROM bars)\nFINALLY SELECT ticker, ts, exp(sum(ln(g)) OVER (PARTITION BY ticker ORDER BY ts DESC ROWS UNBOUNDED PRECEDING)) AS v FROM g", ("bars",))
on_bars("w35_shift_ahead", lambda: F.lead("close", 2).over(day()), f"lead(close, 2) OVER ({BAR})")
on_bars("w36_normalised_return", lambda: W.normalised_return("close", day(), 6), f"pow(1 + (close / lag(close, 6) OVER ({BAR}) - 1), 1.0 / 6) - 1")
on_bars("w37_momentum_difference", lambda: W.normalised_return("close", day(), 12) - W.normalised_return("close", day(), 3), f"(pow(1 + (close / lag(close, 12) OVER ({BAR}) - 1), 1.0 / 12) - 1) - (pow(1 + (close / lag(close, 3) OVER ({BAR}) - 1), 1.0 / 3) - 1)")
for _k in (21, 42, 63):
    on_bars(f"w40_moving_average_{_k}", lambda k=_k: W.rolling_mean("close", day(), k, k), rolled("avg(close)", _k, _k, "close", BAR))
on_ticks("w42_ntile", lambda: F.ntile(4).over(tick()), f"ntile(4) OVER ({OVER})", "l")
on_ticks("w42_rank", lambda: F.rank().over(tick()), f"rank() OVER ({OVER})", "l")
on_ticks("w42_dense_rank", lambda: F.dense_rank().over(tick()), f"dense_rank() OVER ({OVER})", "l")
on_ticks("w42_percent_rank", lambda: F.percent_rank().over(tick()), f"percent_rank() OVER ({OVER})")
on_ticks("w42_cume_dist", lambda: F.cume_dist().over(tick()), f"cume_dist() OVER ({OVER})")
on_ticks("w42_nth_value", lambda: F.nth_value("x", 3).over(tick()), f"nth_value(x, 3) OVER ({OVER})")


def quantile_bucket(df, c: str, parts: int, *keys: str, out: str = "v"):
    """1..parts by interpolated quantile edges, right-closed; duplicate edges fall together, as do their buckets.

    Groups by keys are many and small, such as dates."""
    ps = [i / parts for i in range(1, parts)]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(F.expr(f"array_distinct(percentile({c}, array({', '.join(map(repr, ps))})))").alias("edges")), list(keys))
    else:
        joined = df.withColumn("edges", F.array(*[F.lit(e) for e in dict.fromkeys(exact_quantiles(df, c, ps))]))
    return joined.withColumn(out, F.when(F.col(c).isNotNull(), 1 + F.size(F.filter("edges", lambda e: e < F.col(c))))).drop("edges")


def _qsql(c, parts, by, columns, source):
    ps = ", ".join(repr(i / parts) for i in range(1, parts))
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN e USING ({by})" if by else "CROSS JOIN e"
    return f"WITH e AS (SELECT {by + ', ' if by else ''}list_distinct(quantile_cont({c}, [{ps}])) AS edges FROM {source} {group})\nFINALLY SELECT {columns}, 1 + len(list_filter(edges, lambda q: q < {c})) AS v FROM {source} {join}"


query("w38_quantile_buckets", "series:l ts:t tie:l v:l", lambda s, d: quantile_bucket(ticks(s, d), "x", 5), _qsql("x", 5, "", "series, ts, tie", "ticks"), ("ticks",))
query("w38_quantile_buckets_by_date", "ticker:s ts:t v:l", lambda s, d: quantile_bucket(bars(s, d), "close", 10, "ts"), _qsql("close", 10, "ts", "ticker, ts", "bars"), ("bars",))


def drawdown_duration(df, key="ticker", c="close"):
    """High-water mark and bars since it was last reached; each series starts below a mark of zero."""
    w = W.series_order(key, by=("ts",))
    d = df.select(key, "ts", c, F.row_number().over(w).alias("n"), F.greatest(F.lit(0.0), F.max(c).over(W.running(w))).alias("hwm"))
    return d.select(key, "ts", "hwm", (F.col("n") - F.max(F.when(F.col(c) >= F.col("hwm"), F.col("n"))).over(W.running(w))).alias("bars"))


query("w43_drawdown_duration", "ticker:s ts:t hwm:d bars:l", lambda s, d: drawdown_duration(bars(s, d)), f"WITH h AS (SELECT ticker, ts, close, row_number() OVER ({BAR}) AS n, max(close) OVER {E} AS hwm FROM bars)\nFINALLY SELECT ticker, ts, hwm, n - max(CASE WHEN close >= hwm THEN n END) OVER {E} AS bars FROM h", ("bars",))
W1 = f"({BAR} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def signal_stability(df, key="ticker", c="close", k=20):
    """Mean over full windows of the bars before t of the lag-one covariance (ddof 1) over the variance (ddof 0)."""
    w = W.series_order(key, by=("ts",))
    d = df.select(key, "ts", c, F.lag(c).over(w).alias("p"))
    f, g = w.rowsBetween(-k, -1), w.rowsBetween(-(k - 1), -1)
    v = d.select(key, F.when((F.count(c).over(f) == k) & (F.var_pop(c).over(f) > 1e-12), F.covar_samp(c, "p").over(g) / F.var_pop(c).over(f)).alias("s"))
    return v.groupBy(key).agg(F.avg("s").alias("v"))


query("w26_signal_stability", "ticker:s v:d", lambda s, d: signal_stability(bars(s, d)), f"WITH p AS (SELECT ticker, ts, close, lag(close) OVER ({BAR}) AS p FROM bars), s AS (SELECT ticker, CASE WHEN count(close) OVER {W1} = 20 AND var_pop(close) OVER {W1} > 1e-12 THEN covar_samp(close, p) OVER {W1.replace('20', '19')} / var_pop(close) OVER {W1} END AS s FROM p)\nFINALLY SELECT ticker, avg(s) AS v FROM s GROUP BY ticker", ("bars",))

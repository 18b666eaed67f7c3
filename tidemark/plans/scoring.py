"""Queries over the scoring of features and signals."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import stats as S, windows as W
from tidemark.operators import scoring as C
from tidemark.plans.registry import query
from tidemark.plans.views import bars, design
from tidemark.plans.windows import quantile_bucket



def day():
    return W.series_order("ticker", by=("ts",))


BAR = "PARTITION BY ticker ORDER BY ts"
FS = [f"f{i}" for i in range(1, 7)]
LONG = "l AS (SELECT id, y, unnest(['f1', 'f2', 'f3', 'f4', 'f5', 'f6']) AS feature, unnest([f1, f2, f3, f4, f5, f6]) AS x FROM design)"
RANKED = "k AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l)"
IC = f"WITH {LONG}, {RANKED}, ic AS (SELECT feature, corr(rx, ry) AS ic FROM k GROUP BY feature)\nFINALLY "
D = ("design",)
query("f01_pearson_ic", "feature:s v:d", lambda s, d: C.long_features(design(s, d), FS).groupBy("feature").agg(S.pearson("x", "y").alias("v")), f"WITH {LONG}\nFINALLY SELECT feature, corr(x, y) AS v FROM l GROUP BY feature", D)
query("f02_spearman_ic", "feature:s ic:d", lambda s, d: S.spearman(C.long_features(design(s, d), FS), "x", "y", ["feature"], spread=True), IC + "SELECT * FROM ic", D)
QS = ", ".join(repr(i / 20) for i in range(1, 20))
MI = f"{LONG}, q AS (SELECT feature, list_distinct(quantile_cont(x, [{QS}])) AS ex, list_distinct(quantile_cont(y, [{QS}])) AS ey FROM l GROUP BY feature), b AS (SELECT feature, 1 + len(list_filter(ex, lambda e: e < x)) AS i, 1 + len(list_filter(ey, lambda e: e < y)) AS j FROM l JOIN q USING (feature)), n AS (SELECT feature, i, j, count(*) AS n FROM b GROUP BY 1, 2, 3), cells AS (SELECT * FROM (SELECT DISTINCT feature, i FROM n) JOIN (SELECT DISTINCT feature, j FROM n) USING (feature)), p AS (SELECT feature, i, j, coalesce(n, 0) / sum(n) OVER (PARTITION BY feature) + 1e-12 AS p FROM cells LEFT JOIN n USING (feature, i, j)), m AS (SELECT feature, p, sum(p) OVER (PARTITION BY feature, i) AS px, sum(p) OVER (PARTITION BY feature, j) AS py FROM p), mi AS (SELECT feature, greatest(0, sum(p * ln(p / (px * py)))) AS mi FROM m GROUP BY feature)"
query("f03_mutual_information", "feature:s mi:d", lambda s, d: C.mutual_information(C.long_features(design(s, d), FS), "x", "y", 20, ["feature"]), f"WITH {MI}\nFINALLY SELECT * FROM mi", D)
TSTAT = "regr_sxy(y, x) / regr_sxx(y, x) / sqrt((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (count(*) - 2) / regr_sxx(y, x))"
query("f04_slope_t", "feature:s v:d", lambda s, d: C.long_features(design(s, d), FS).groupBy("feature").agg(S.slope_t("x", "y").alias("v")), f"WITH {LONG}\nFINALLY SELECT feature, {TSTAT} AS v FROM l GROUP BY feature", D)


def _signal(s, d):
    """Bars with a signal (momentum) and the next return."""
    return bars(s, d).select("ticker", "ts", W.momentum("close", day(), 3).alias("s"), W.forward_return("close", day()).alias("r"))


SIG = f"sig AS (SELECT ticker, ts, close - lag(close, 3) OVER ({BAR}) AS s, lead(close) OVER ({BAR}) / close - 1 AS r FROM bars), ok AS (SELECT * FROM sig WHERE s IS NOT NULL AND r IS NOT NULL)"
B = ("bars",)
GUARD = "CASE WHEN count(a) OVER {f} >= {k} AND stddev_pop(a) OVER {f} * stddev_pop(b) OVER {f} > 1e-14 THEN covar_pop(a, b) OVER {f} / (stddev_pop(a) OVER {f} * stddev_pop(b) OVER {f}) END"
ROLL = GUARD.format(f=f"({BAR} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", k=50)


def icir(df, k=50):
    """Mean, deviation and their ratio of the rolling IC of each series."""
    r = df.select("ticker", W.rolling_correlation("s", "r", day(), k).alias("ic"))
    return r.groupBy("ticker").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("sd"), (F.avg("ic") / (F.stddev_samp("ic") + 1e-12)).alias("icir"))


query("f05_icir", "ticker:s mean:d sd:d icir:d", lambda s, d: icir(_signal(s, d).na.drop()), f"WITH {SIG}, i AS (SELECT ticker, {ROLL.replace('(a)', '(s)').replace('(b)', '(r)').replace('(a, b)', '(s, r)')} AS ic FROM ok)\nFINALLY SELECT ticker, avg(ic) AS mean, stddev_samp(ic) AS sd, avg(ic) / (stddev_samp(ic) + 1e-12) AS icir FROM i GROUP BY ticker", B)
TABLE = f"WITH {MI}, {RANKED}, ic AS (SELECT feature, corr(rx, ry) AS spearman FROM k GROUP BY feature), t AS (SELECT feature, corr(x, y) AS pearson, {TSTAT} AS t FROM l GROUP BY feature), f AS (SELECT * FROM t JOIN ic USING (feature) JOIN mi USING (feature))"
SCORE = ", ".join(f"(abs({m}) - min(abs({m})) OVER ()) / (max(abs({m})) OVER () - min(abs({m})) OVER () + 1e-12) AS s_{m}" for m in ("pearson", "spearman", "mi"))
query("f06_composite", "feature:s score:d rank:l", lambda s, d: C.composite(C.feature_table(design(s, d), FS), ["pearson", "spearman", "mi"]), TABLE + f", g AS (SELECT feature, {SCORE} FROM f)\nFINALLY SELECT feature, (s_pearson + s_spearman + s_mi) / 3 AS score, row_number() OVER (ORDER BY (s_pearson + s_spearman + s_mi) DESC, feature) AS rank FROM g", D)
query("f07_select_features", "feature:s pearson:d spearman:d mi:d t:d", lambda s, d: C.feature_table(design(s, d), FS), TABLE + "\nFINALLY SELECT * FROM f", D)
query("f08_fast_ic_ranking", "feature:s ic:d abs_ic:d", lambda s, d: C.ranked_ic(design(s, d), FS, top=3), IC + "SELECT feature, ic, abs(ic) AS abs_ic FROM ic ORDER BY abs_ic DESC, feature LIMIT 3", D)
query("f09_feature_ic", "feature:s ic:d abs_ic:d", lambda s, d: C.ranked_ic(design(s, d), FS), IC + "SELECT feature, ic, abs(ic) AS abs_ic FROM ic", D)
query("f10_hit_ratio", "hit:d", lambda s, d: C.accuracy(_signal(s, d), "s", "r"), f"WITH {SIG}\nFINALLY SELECT avg(CAST(sign(s) * sign(r) > 0 AS INT)) AS hit FROM ok", B)
query("f11_directional_accuracy", "long_accuracy:d short_accuracy:d n_long:l n_short:l", lambda s, d: C.accuracy(_signal(s, d), "s", "r"), f"WITH {SIG}\nFINALLY SELECT avg(CASE WHEN s > 0 THEN CAST(r > 0 AS INT) END) AS long_accuracy, avg(CASE WHEN s < 0 THEN CAST(r < 0 AS INT) END) AS short_accuracy, count_if(s > 0) AS n_long, count_if(s < 0) AS n_short FROM ok", B)
RK = "rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2.0"
query("f12_signal_decay", "lag:l ic:d n:l", lambda s, d: C.decay(_signal(s, d).withColumn("bar", F.row_number().over(day())), "s", "r", 5), f"WITH {SIG}, p AS (SELECT *, row_number() OVER ({BAR}) AS bar FROM sig), j AS (SELECT lag, a.s, b.r FROM p a JOIN (SELECT unnest(range(0, 6)) AS lag) ON true JOIN p b ON a.ticker = b.ticker AND b.bar = a.bar + lag WHERE a.s IS NOT NULL AND b.r IS NOT NULL), k AS (SELECT lag, {RK.format(g='lag', c='s')} AS x, {RK.format(g='lag', c='r')} AS y FROM j)\nFINALLY SELECT lag, corr(x, y) AS ic, count(*) AS n FROM k GROUP BY lag", B)
query("f13_monthly_ic", "month:s ic:d n:l", lambda s, d: S.spearman(_signal(s, d).withColumn("month", F.date_format("ts", "yyyy-MM")), "s", "r", ["month"]), f"WITH {SIG}, m AS (SELECT strftime(ts, '%Y-%m') AS month, s, r FROM ok), k AS (SELECT month, {RK.format(g='month', c='s')} AS x, {RK.format(g='month', c='r')} AS y FROM m)\nFINALLY SELECT month, CASE WHEN count(*) >= 5 THEN corr(x, y) END AS ic, count(*) AS n FROM k GROUP BY month", B)
POP = "(sum(pow(s - mu, {p})) / count(*)) / pow(max(sd), {p})"
query("f14_prediction_distribution", "mean:d std:d min:d max:d skew:d kurtosis:d p5:d p25:d p50:d p75:d p95:d", lambda s, d: C.distribution(_signal(s, d).where("s IS NOT NULL"), "s"), f"WITH {SIG}, z AS (SELECT s, avg(s) OVER () AS mu, stddev_pop(s) OVER () AS sd FROM sig WHERE s IS NOT NULL)\nFINALLY SELECT avg(s) AS mean, stddev_pop(s) AS std, min(s) AS min, max(s) AS max, {POP.format(p=3)} AS skew, {POP.format(p=4)} - 3 AS kurtosis, " + ", ".join(f"quantile_cont(s, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM z", B)
query("f15_asymmetry", "side:s ic:d n:l", lambda s, d: S.spearman(_signal(s, d).where("s <> 0").withColumn("side", F.when(F.col("s") > 0, "long").otherwise("short")), "s", "r", ["side"], 50), f"WITH {SIG}, m AS (SELECT CASE WHEN s > 0 THEN 'long' ELSE 'short' END AS side, s, r FROM ok WHERE s <> 0), k AS (SELECT side, {RK.format(g='side', c='s')} AS x, {RK.format(g='side', c='r')} AS y FROM m)\nFINALLY SELECT side, corr(x, y) AS ic, count(*) AS n FROM k GROUP BY side", B)


def analysis(df):
    """(metric, value) of a signal: IC, hit ratio, accuracies and distribution."""
    d = C.accuracy(df, "s", "r").join(F.broadcast(C.distribution(df.where("s IS NOT NULL"), "s"))).join(F.broadcast(df.agg(S.pearson("s", "r").alias("pearson"))))
    names = ["hit", "long_accuracy", "short_accuracy", "mean", "std", "skew", "kurtosis", "pearson"]
    return d.select([F.col(n).cast("double") for n in names]).unpivot([], names, "metric", "value")


query("f16_analyze_signal", "metric:s value:d", lambda s, d: analysis(_signal(s, d)), f"WITH {SIG}, z AS (SELECT s, avg(s) OVER () AS mu, stddev_pop(s) OVER () AS sd FROM sig WHERE s IS NOT NULL)\nFINALLY SELECT 'hit' AS metric, avg(CAST(sign(s) * sign(r) > 0 AS INT)) AS value FROM ok UNION ALL SELECT 'long_accuracy', avg(CASE WHEN s > 0 THEN CAST(r > 0 AS INT) END) FROM ok UNION ALL SELECT 'short_accuracy', avg(CASE WHEN s < 0 THEN CAST(r < 0 AS INT) END) FROM ok UNION ALL SELECT 'pearson', corr(s, r) FROM ok UNION ALL SELECT 'mean', avg(s) FROM z UNION ALL SELECT 'std', stddev_pop(s) FROM z UNION ALL SELECT 'skew', {POP.format(p=3)} FROM z UNION ALL SELECT 'kurtosis', {POP.format(p=4)} - 3 FROM z", B)
query("f17_frozen_sign", "sign:l", lambda s, d: S.spearman(_signal(s, d).where("ts < timestamp_ntz'2000-01-01'").withColumn("g", F.lit(1)), "s", "r", ["g"]).select(F.when(F.coalesce("ic", F.lit(0.0)) >= 0, 1).otherwise(-1).alias("sign")), f"WITH {SIG}, k AS (SELECT {RK.format(g='1', c='s')} AS x, {RK.format(g='1', c='r')} AS y FROM ok WHERE ts < TIMESTAMP '2000-01-01')\nFINALLY SELECT CASE WHEN coalesce(corr(x, y), 0) >= 0 THEN 1 ELSE -1 END AS sign FROM k", B)


def _factor(s, d):
    """Factor (volume), its bucket of three by date, and forward returns."""
    f = bars(s, d).select("ticker", "ts", F.col("volume").alias("factor"), W.forward_return("close", day(), 1).alias("r1"), W.forward_return("close", day(), 5).alias("r5"))
    return quantile_bucket(f, "factor", 3, "ts")


FAC = f"f AS (SELECT ticker, ts, volume AS factor, lead(close) OVER ({BAR}) / close - 1 AS r1, lead(close, 5) OVER ({BAR}) / close - 1 AS r5 FROM bars), e AS (SELECT ts, list_distinct(quantile_cont(factor, [{1 / 3!r}, {2 / 3!r}])) AS edges FROM f GROUP BY ts), b AS (SELECT f.*, 1 + len(list_filter(edges, lambda q: q < factor)) AS v FROM f JOIN e USING (ts))"
query("f18_forward_returns", "ticker:s ts:t factor:d r1:d r5:d v:l", _factor, f"WITH {FAC}\nFINALLY SELECT * FROM b", B)
query("f19_mean_by_quantile", "v:l r1:d se:d", lambda s, d: _factor(s, d).groupBy("v").agg(F.avg("r1").alias("r1"), (F.stddev_samp("r1") / F.sqrt(F.count("r1"))).alias("se")), f"WITH {FAC}\nFINALLY SELECT v, avg(r1) AS r1, stddev_samp(r1) / sqrt(count(r1)) AS se FROM b GROUP BY v", B)
query("f20_yearly_factor_ic", "year:l ic:d", lambda s, d: S.spearman(_factor(s, d), "factor", "r1", ["ts"]).groupBy(F.year("ts").alias("year")).agg(F.avg("ic").alias("ic")), f"WITH {FAC}, ok AS (SELECT * FROM b WHERE r1 IS NOT NULL), k AS (SELECT ts, {RK.format(g='ts', c='factor')} AS x, {RK.format(g='ts', c='r1')} AS y FROM ok), i AS (SELECT ts, CASE WHEN count(*) >= 5 AND stddev_pop(x) * stddev_pop(y) > 1e-14 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS ic FROM k GROUP BY ts)\nFINALLY SELECT year(ts) AS year, avg(ic) AS ic FROM i GROUP BY 1", B)
query("f21_factor_turnover", "ts:t v:l turnover:d", lambda s, d: C.turnover(_factor(s, d)), f"WITH {FAC}, d AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS before FROM (SELECT DISTINCT ts FROM b))\nFINALLY SELECT b.ts, b.v, avg(CAST(o.ticker IS NULL AS INT)) AS turnover FROM b JOIN d ON b.ts = d.ts AND before IS NOT NULL LEFT JOIN b o ON o.ts = before AND o.ticker = b.ticker AND o.v = b.v GROUP BY 1, 2", B)
query("f22_cumulative_by_quantile", "ts:t v:l c:d", lambda s, d: _factor(s, d).groupBy("ts", "v").agg(F.avg("r1").alias("r")).select("ts", "v", F.sum(F.coalesce("r", F.lit(0.0)) / 1000).over(Window.partitionBy("v").orderBy("ts")).alias("c")), f"WITH {FAC}, r AS (SELECT ts, v, avg(r1) AS r FROM b GROUP BY 1, 2)\nFINALLY SELECT ts, v, sum(coalesce(r, 0) / 1000) OVER (PARTITION BY v ORDER BY ts) AS c FROM r", B)

"""Model queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import models as M
from tidemark.operators.joins import value_pairs
from tidemark.plans.registry import query
from tidemark.plans.unit_roots import eliminated
from tidemark.plans.views import bars, design

FS = [f"f{i}" for i in range(1, 6)]
D = ("design",)


def day():
    return W.series_order("ticker", by=("ts",))


BAR = "PARTITION BY ticker ORDER BY ts"
query("m01_ols_single", "intercept:d slope:d", lambda s, d: (lambda m: s.createDataFrame([(float(m.intercept), float(m.coefficients[0]))], "intercept double, slope double"))(M.fit_ols(M.gram(design(s, d), ["f1"]))), "SELECT regr_intercept(y, f1) AS intercept, regr_slope(y, f1) AS slope FROM design", D)


def gram_sql(standard: bool) -> str:
    """m(i, j, x): cross products of y (0), of 1 unless standardised, and of the features; st(j, mean, sd) and z are what they are made of."""
    columns = ["y", *([] if standard else ["1.0::DOUBLE"]), *FS]
    value = "CASE WHEN j = 0 THEN x - mean ELSE (x - mean) / sd END" if standard else "x"
    return f"""long AS MATERIALIZED (SELECT id, unnest(range({len(columns)})) AS j, unnest([{", ".join(columns)}]) AS x FROM design),
st AS (SELECT j, avg(x) AS mean, stddev_pop(x) + 1e-12 AS sd FROM long GROUP BY j), z AS MATERIALIZED (SELECT id, j, {value} AS x FROM long JOIN st USING (j)),
m AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS x FROM z a JOIN z b USING (id) GROUP BY 1, 2)"""


def solved_sql(penalty: float, standard: bool) -> str:
    """b(j, v): the solution with a penalty on the diagonal."""
    line = f"list_concat(list(CASE WHEN i = j THEN x + {penalty!r}::DOUBLE ELSE x END ORDER BY j) FILTER (WHERE j >= 1), list(x) FILTER (WHERE j = 0))"
    return f"""{gram_sql(standard)}, a0 AS (SELECT 0 AS id, 0 AS lags, list(line ORDER BY i) AS a FROM (SELECT i, {line} AS line FROM m WHERE i >= 1 GROUP BY i)), {eliminated("e", "a0")},
b AS (SELECT unnest(range(1, len(a) + 1)) AS j, unnest(list_transform(a, lambda line: line[len(a) + 1])) AS v FROM e WHERE p = len(a) + 1)"""


NAMES = "CASE j " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FS, 1)) + " END"
#: From coefficients b(j, v) of standardised features to those of the features, with the intercept.
UNSCALED = f"""w AS (SELECT b.j, v / sd AS v, mean FROM b JOIN st USING (j))
FINALLY SELECT {NAMES} AS feature, v AS coefficient FROM w UNION ALL SELECT 'intercept', (SELECT mean FROM st WHERE j = 0) - sum(v * mean) FROM w"""
OLS = f"WITH RECURSIVE {solved_sql(1e-8, False)}, o AS (SELECT j - 1 AS j, v FROM b)"


def lasso_sql(alpha: float, most: int = 500, tolerance: float = 1e-4) -> str:
    """One row a step of the cyclic descent: k counts steps, moved is the greatest change of the sweep."""
    p = len(FS)
    j, beta = f"(k % {p} + 1)", "d.beta"
    rho = f"(g.v[{j}] - list_inner_product(g.c[{j}], {beta}) + g.c[{j}][{j}] * {beta}[{j}])"
    new = f"sign({rho}) * greatest(abs({rho}) - {alpha!r}::DOUBLE * g.n, 0) / (g.c[{j}][{j}] + 1e-12)"
    return f"""WITH RECURSIVE {gram_sql(True)}, g AS MATERIALIZED (SELECT (SELECT count(*) FROM design) AS n, (SELECT list(x ORDER BY i) FROM m WHERE j = 0 AND i > 0) AS v, (SELECT list(line ORDER BY i) FROM (SELECT i, list(x ORDER BY j) AS line FROM m WHERE i > 0 AND j > 0 GROUP BY i)) AS c),
d AS (SELECT 0::BIGINT AS k, list_transform(range({p}), lambda x: 0.0::DOUBLE) AS beta, 0.0::DOUBLE AS moved UNION ALL
SELECT k + 1, list_transform(beta, lambda x, i: CASE WHEN i = {j} THEN {new} ELSE x END), greatest(CASE WHEN {j} = 1 THEN 0 ELSE moved END, abs({new} - {beta}[{j}])) FROM d, g WHERE k < {most * p} AND NOT (k > 0 AND k % {p} = 0 AND moved < {tolerance!r})),
b AS (SELECT unnest(range(1, {p + 1})) AS j, unnest(beta) AS v FROM (SELECT arg_max(beta, k) AS beta FROM d)), {UNSCALED}"""


query("m01_ols", "feature:s coefficient:d", lambda s, d: M.fit_ols(M.gram(design(s, d), FS)).table(s), f"{OLS}\nFINALLY SELECT coalesce({NAMES}, 'intercept') AS feature, v AS coefficient FROM o", D)
query("m02_ridge", "feature:s coefficient:d", lambda s, d: M.fit_ridge(M.gram(design(s, d), FS), 10.0).table(s), f"WITH RECURSIVE {solved_sql(10.0, True)}, {UNSCALED}", D)
query("m03_lasso", "feature:s coefficient:d", lambda s, d: M.fit_lasso(M.gram(design(s, d), FS), 0.05).table(s), lasso_sql(0.05), D)
query("m04_rolling_ols", "ticker:s ts:t prediction:d", lambda s, d: M.rolling_ols(bars(s, d), ["volume"], "close", 60, ["ticker"]), f"WITH w AS (SELECT ticker, ts, volume, count(*) OVER q AS n, sum(volume) OVER q AS sx, sum(close) OVER q AS sy, sum(volume * volume) OVER q + 1e-6 AS sxx, sum(volume * close) OVER q AS sxy FROM bars WINDOW q AS ({BAR} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))\nFINALLY SELECT ticker, ts, ((sxx * sy - sx * sxy) + volume * ((n + 1e-6) * sxy - sx * sy)) / ((n + 1e-6) * sxx - sx * sx) AS prediction FROM w WHERE n >= 60", ("bars",))
LONG = "l AS (SELECT id, y, unnest(['f1', 'f2', 'f3', 'f4', 'f5']) AS feature, unnest([f1, f2, f3, f4, f5]) AS x FROM design)"
RX = "rank() OVER (PARTITION BY feature ORDER BY {c}) + (count(*) OVER (PARTITION BY feature, {c}) - 1) / 2.0"
SCORED = f"r AS (SELECT id, feature, ({RX.format(c='x')} - 1) / (count(*) OVER (PARTITION BY feature) - 1) AS r FROM l)"
query("m05_factor_score", "id:l prediction:d", lambda s, d: M.rank_score(design(s, d), M.rank_weights(design(s, d), FS)), f"WITH {LONG}, w AS (SELECT feature, corr(x, y) AS w FROM l GROUP BY feature), {SCORED}\nFINALLY SELECT id, sum(w * r) AS prediction FROM r JOIN w USING (feature) GROUP BY id", D)
query("m06_rank_alpha", "id:l prediction:d", lambda s, d: M.rank_score(design(s, d), M.rank_weights(design(s, d), FS, how="spearman")), f"WITH {LONG}, k AS (SELECT feature, {RX.format(c='x')} AS x, {RX.format(c='y')} AS y FROM l), w AS (SELECT feature, corr(x, y) AS w FROM k GROUP BY feature), {SCORED}\nFINALLY SELECT id, sum(w * r) AS prediction FROM r JOIN w USING (feature) GROUP BY id", D)
query("m07_fit_metrics", "ic:d rank_ic:d mse:d rmse:d mae:d r2:d", lambda s, d: M.fit_metrics(design(s, d).withColumn("p", 4 + F.col("f1") * 2), "y", "p"),
      "WITH e AS (SELECT y, 4 + f1 * 2 AS p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY f1) + (count(*) OVER (PARTITION BY f1) - 1) / 2.0 AS rp FROM design)\nFINALLY SELECT corr(y, p) AS ic, corr(ry, rp) AS rank_ic, avg((y - p) * (y - p)) AS mse, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 1 - sum((y - p) * (y - p)) / var_pop(y) / count(*) AS r2 FROM e", D)
query("m08_compare_models", "model:s train_ic:d train_rank_ic:d test_ic:d test_rank_ic:d test_mse:d test_r2:d", lambda s, d: M.compare(design(s, d).where("id % 4 <> 0"), design(s, d).where("id % 4 = 0"), FS))


def members(s, d):
    """Five predictions of y, of which the three with the greatest absolute IC count."""
    f = F.col
    return design(s, d).select("id", "y", f("f1").alias("a"), (-f("f2") + 0.2 * f("f1")).alias("b"), (f("f3") * f("f4")).alias("c"), (f("f5") - f("f6")).alias("e"), F.abs("f2").alias("g"))


MEMBERS = ("a", "b", "c", "e", "g")
MEMBERS_SQL = "mem AS (SELECT id, y, f1 AS a, -f2 + 0.2::DOUBLE * f1 AS b, f3 * f4 AS c, f5 - f6 AS e, abs(f2) AS g FROM design)"
LONG_MEMBERS = "l AS (" + " UNION ALL ".join(f"SELECT id, y, '{m}' AS m, {m} AS x FROM mem" for m in MEMBERS) + ")"
query(
    "m09_ensemble", "id:l prediction:d", lambda s, d: M.ensemble(members(s, d), list(MEMBERS))[0],
    f"""WITH {MEMBERS_SQL}, {LONG_MEMBERS}, ic AS (SELECT m, corr(x, y) AS v FROM l GROUP BY m), best AS (SELECT m, v, row_number() OVER (ORDER BY abs(v) DESC, m) AS k FROM ic QUALIFY k <= 3),
w AS (SELECT m, k, v, v / sum(abs(v)) OVER () AS w FROM best), mix AS (SELECT id, any_value(y) AS y, sum(w * x) AS p FROM l JOIN w USING (m) GROUP BY id), ok AS (SELECT abs(corr(p, y)) > 1.1 * (SELECT abs(v) FROM best WHERE k = 1) AS used FROM mix),
one AS (SELECT id, CASE WHEN v >= 0 THEN x ELSE -x END AS p FROM l JOIN best USING (m) WHERE k = 1)
FINALLY SELECT mix.id, CASE WHEN used THEN mix.p ELSE one.p END AS prediction FROM mix JOIN one USING (id), ok""", D,
)
query("m10_formula", "formula:s", lambda s, d: s.createDataFrame([(M.fit_ols(M.gram(design(s, d), FS)).formula(),)], "formula string"),
      f"""{OLS}
FINALLY SELECT 'y = ' || max(printf('%.6f', v)) FILTER (WHERE j = 0) || coalesce(string_agg(CASE WHEN v >= 0 THEN ' + ' ELSE ' - ' END || printf('%.6f', abs(v)) || '*' || {NAMES}, '' ORDER BY j) FILTER (WHERE j > 0 AND v <> 0), '') AS formula FROM o""", D)  # fmt: skip
query("m11_full_signal", "id:l signal:d", lambda s, d: design(s, d).select("id", (-M.Linear(FS[:2], 0.5, [2.0, -3.0]).predict()).alias("signal")), "SELECT id, -(0.5 + 2 * f1 - 3 * f2) AS signal FROM design", D)
PAIR = "p AS (SELECT a.ticker || ':' || b.ticker AS pair, a.ts, a.close AS x, b.close AS y FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker < b.ticker)"


def pairs(s, d):
    """pair, ts, x, y: daily closes of every two tickers."""
    return value_pairs(bars(s, d), "close", "ticker").select(F.concat_ws(":", "a", "b").alias("pair"), "ts", "x", "y")


def both_ways(df):
    """The regression of either side of a pair on the other; the one with the larger slope, rounded to two places."""
    r = df.groupBy("pair").agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.regr_slope("x", "y").alias("c"), F.regr_intercept("x", "y").alias("d"))
    first = F.col("a") >= F.col("c")
    return r.select("pair", F.when(first, "y on x").otherwise("x on y").alias("way"), F.round(F.when(first, F.col("a")).otherwise(F.col("c")), 2).alias("slope"), F.round(F.when(first, F.col("b")).otherwise(F.col("d")), 2).alias("intercept"))


def residuals(df):
    line = df.groupBy("pair").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    return df.join(line, "pair").select("pair", "ts", (F.col("y") - F.col("a") - F.col("b") * F.col("x")).alias("v"))


query("m12_pair_regression", "pair:s way:s slope:d intercept:d", lambda s, d: both_ways(pairs(s, d)),
      f"""WITH {PAIR}, r AS (SELECT pair, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_slope(x, y) AS c, regr_intercept(x, y) AS d FROM p GROUP BY pair)
FINALLY SELECT pair, CASE WHEN a >= c THEN 'y on x' ELSE 'x on y' END AS way, round(CASE WHEN a >= c THEN a ELSE c END, 2) AS slope, round(CASE WHEN a >= c THEN b ELSE d END, 2) AS intercept FROM r""", ("bars",))  # fmt: skip
query("m13_residual_spread", "pair:s ts:t v:d", lambda s, d: residuals(pairs(s, d)), f"WITH {PAIR}, r AS (SELECT pair, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p GROUP BY pair)\nFINALLY SELECT pair, ts, y - a - b * x AS v FROM p JOIN r USING (pair)", ("bars",))


#: Added to the variances, so that few common dates leave one optimum.
RIDGE = 1e-6
TICKERS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def optimal_weights(s, d):
    names = TICKERS
    r = bars(s, d).select("ticker", "ts", (W.pct_change("close", day()) / 1000).alias("r")).groupBy("ts").pivot("ticker", names).agg(F.max("r"))
    g = M.gram(r.withColumn("y", F.lit(0.0)), names)
    mean = g.sx / g.n
    cov = (g.xx - g.n * mean[:, None] * mean[None, :]) / (g.n - 1)
    return s.createDataFrame([(n, float(v)) for n, v in zip(names, M.max_sharpe_weights(mean * 252, cov * 252 + RIDGE * np.eye(len(names))))], "ticker string, weight double")


def sharpe_sql() -> str:
    """Every set of names is solved for; the one whose solution meets all conditions of the optimum is the answer."""
    n = len(TICKERS)
    names = ", ".join(f"('{t}', {k})" for k, t in enumerate(TICKERS))
    return f"""WITH RECURSIVE names(ticker, k) AS (VALUES {names}),
r AS (SELECT ticker, ts, (close / lag(close) OVER ({BAR}) - 1) / 1000 AS r FROM bars),
ok AS MATERIALIZED (SELECT k, ts, r FROM r JOIN names USING (ticker) WHERE r IS NOT NULL QUALIFY count(*) OVER (PARTITION BY ts) = {n}),
mu AS (SELECT k, avg(r) * 252 AS mu FROM ok GROUP BY k), c AS MATERIALIZED (SELECT a.k AS i, b.k AS j, covar_samp(a.r, b.r) * 252 + CASE WHEN a.k = b.k THEN {RIDGE!r} ELSE 0 END::DOUBLE AS c FROM ok a JOIN ok b USING (ts) GROUP BY a.k, b.k),
sets AS (SELECT unnest(range(1, {1 << n})) AS id), inside AS (SELECT id, k FROM sets, names WHERE (id >> k) & 1 = 1),
a0 AS (SELECT id, 0 AS lags, list(line ORDER BY i) AS a FROM (SELECT x.id, x.k AS i, list_concat(list(c ORDER BY y.k), [any_value(mu)]) AS line FROM inside x JOIN inside y ON x.id = y.id JOIN c ON c.i = x.k AND c.j = y.k JOIN mu ON mu.k = x.k GROUP BY x.id, x.k) GROUP BY id),
{eliminated("e", "a0")}, z AS (SELECT id, k, a[row_number() OVER (PARTITION BY id ORDER BY k)][len(a) + 1] AS z FROM e JOIN inside USING (id) WHERE p = len(a) + 1),
good AS (SELECT id FROM z GROUP BY id HAVING min(z) > 0), fits AS (SELECT id, i, sum(c * z) AS s FROM z JOIN good USING (id) JOIN c ON c.j = z.k GROUP BY 1, 2),
best AS (SELECT id FROM fits JOIN mu ON mu.k = i GROUP BY id HAVING min(s - mu) > -1e-7 ORDER BY id LIMIT 1)
FINALLY SELECT ticker, coalesce(z / sum(z) OVER (), 0) AS weight FROM names LEFT JOIN (SELECT k, z FROM z JOIN best USING (id)) USING (k)"""


query("m14_max_sharpe", "ticker:s weight:d", optimal_weights, sharpe_sql(), ("bars",))
query("w28_rolling_betas", "ticker:s ts:t beta:d", lambda s, d: M.rolling_ols(bars(s, d), ["volume"], "close", 24, ["ticker"], betas=True).select("ticker", "ts", F.col("betas")[0].alias("beta")),
      f"WITH w AS (SELECT ticker, ts, count(*) OVER q + 1e-6 AS n, count(*) OVER q AS k, sum(volume) OVER q AS sx, sum(close) OVER q AS sy, sum(volume * volume) OVER q + 1e-6 AS sxx, sum(volume * close) OVER q AS sxy FROM bars WINDOW q AS ({BAR} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))\nFINALLY SELECT ticker, ts, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS beta FROM w WHERE k = 24", ("bars",))

"""Cointegration and pair-trading queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.operators import joins as J, pairs as K
from tidemark.plans.registry import query
from tidemark.plans.unit_roots import adf_sql, cointegration_sql, critical_sql, unit_root_sql
from tidemark.plans.views import bars, nation_months

N, B = ("nation_months",), ("bars",)


def monthly_pairs(s, d):
    """a, b, ts, x, y: monthly totals of the nations of a region."""
    m = nation_months(s, d)
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), "n_regionkey")
    return J.value_pairs(m.withColumn("v", F.col("v") / 1000).join(n, "name"), "v", within=["n_regionkey"])


PAIRS = "p AS (SELECT x.name AS a, y.name AS b, x.ts, x.v / 1000 AS x, y.v / 1000 AS y FROM nation_months x JOIN nation_months y ON x.ts = y.ts AND x.name < y.name JOIN nation m ON m.n_name = x.name JOIN nation n ON n.n_name = y.name AND m.n_regionkey = n.n_regionkey)"


def daily_pairs(s, d):
    """pair, ts, x, y: daily closes of every two tickers."""
    return J.value_pairs(bars(s, d), "close", "ticker").select(F.concat_ws(":", "a", "b").alias("pair"), "ts", "x", "y")


DAILY = "p AS (SELECT a.ts, a.close AS x, b.close AS y, a.ticker || ':' || b.ticker AS pair FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker < b.ticker)"
PAIR = "PARTITION BY pair"


def z_scores(s, d):
    p = daily_pairs(s, d).select("pair", "ts", (F.col("x") - 0.5 * F.col("y")).alias("spread"))
    m = p.groupBy("pair").agg(F.avg("spread").alias("m"), F.stddev_samp("spread").alias("sd"))
    return p.join(F.broadcast(m), "pair").select("pair", "ts", "spread", ((F.col("spread") - F.col("m")) / F.col("sd")).alias("z"))


def johansen_table(s, d):
    return K.johansen_scan(monthly_pairs(s, d))


query("k01_adf", "name:s stat:d p:d lags:l c1:d c5:d c10:d", lambda s, d: K.adf_table(nation_months(s, d), "name", "v"), unit_root_sql(), N)
query("k02_engle_granger", "a:s b:s stat:d p:d", lambda s, d: K.cointegration_scan(monthly_pairs(s, d), 1), cointegration_sql(PAIRS, 1), N)
query("k03_cointegration_scan", "a:s b:s stat:d p:d", lambda s, d: K.cointegration_scan(monthly_pairs(s, d)).where("p < 0.05"), cointegration_sql(PAIRS, None, "p < 0.05"), N)
query("k04_johansen", "a:s b:s eigenvalue:d trace0:d trace1:d rank:l weight:d", johansen_table)
Z = f"{DAILY}, s AS (SELECT pair, ts, x - 0.5 * y AS spread FROM p), z AS (SELECT pair, ts, spread, (spread - avg(spread) OVER ({PAIR})) / stddev_samp(spread) OVER ({PAIR}) AS z FROM s)"
HELD = f"""{Z}, e AS (SELECT *, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 WHEN sign(z) <> sign(lag(z) OVER ({PAIR} ORDER BY ts)) THEN 0 END AS event FROM z),
h AS (SELECT pair, ts, spread, z, coalesce(last_value(event IGNORE NULLS) OVER ({PAIR} ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS position FROM e)"""
query("k05_spread_zscore", "pair:s ts:t spread:d z:d", z_scores, f"WITH {Z}\nFINALLY SELECT * FROM z", B)
query("k06_reversion_positions", "pair:s ts:t z:d position:l", lambda s, d: K.reversion_positions(z_scores(s, d)), f"WITH {HELD}\nFINALLY SELECT pair, ts, z, position FROM h", B)


def pw():
    return Window.partitionBy("pair").orderBy("ts")


def spread_pnl(s, d):
    """The spread in units of 10,000,000, so that a change is a return."""
    z = z_scores(s, d)
    held = K.reversion_positions(z).select("pair", "ts", "position").join(z.select("pair", "ts", (F.col("spread") / 10_000_000).alias("spread")), ["pair", "ts"])
    return K.spread_returns(held)


query("k07_spread_pnl", "pair:s ts:t pnl:d total:d compound:d", spread_pnl,
      f"""WITH {HELD}, q AS (SELECT pair, ts, lag(position) OVER w * coalesce(spread / 10000000 - lag(spread / 10000000) OVER w, 0) AS pnl FROM h WINDOW w AS ({PAIR} ORDER BY ts))
FINALLY SELECT *, sum(pnl) OVER w AS total, product(1 + pnl) OVER w - 1 AS compound FROM q WINDOW w AS ({PAIR} ORDER BY ts ROWS UNBOUNDED PRECEDING)""", B)  # fmt: skip
query("k08_pair_correlations", "a:s b:s rho:d", lambda s, d: K.pair_correlations(monthly_pairs(s, d)), f"WITH {PAIRS}\nFINALLY SELECT a, b, coalesce(round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 2), -2) AS rho FROM p GROUP BY 1, 2", N)


def grown_pairs(s, d):
    """a, b, ts, x, y: each nation's total so far over its first month's, for the nations of a region."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name"), "n_regionkey")
    w = Window.partitionBy("name").orderBy("ts")
    grown = nation_months(s, d).select("name", "ts", (F.sum("v").over(W.running(w)) / F.first("v").over(w)).alias("v"))
    return J.value_pairs(grown.join(n, "name"), "v", within=["n_regionkey"])


GROWN = """i AS (SELECT name, ts, sum(v) OVER w / first_value(v) OVER w AS v FROM nation_months WINDOW w AS (PARTITION BY name ORDER BY ts ROWS UNBOUNDED PRECEDING)),
p AS (SELECT x.name AS a, y.name AS b, x.ts, x.v AS x, y.v AS y FROM i x JOIN i y ON x.ts = y.ts AND x.name < y.name JOIN nation m ON m.n_name = x.name JOIN nation n ON n.n_name = y.name AND m.n_regionkey = n.n_regionkey)"""
SELECTED = f"""{GROWN}, g AS (SELECT a, b, coalesce(round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 2), -2) AS rho, regr_slope(x, y) AS s1, regr_intercept(x, y) AS i1, regr_slope(y, x) AS s2, regr_intercept(y, x) AS i2 FROM p GROUP BY 1, 2),
c AS (SELECT a, b, s2 > s1 AS flip, round(CASE WHEN s2 > s1 THEN s2 ELSE s1 END, 2) AS weight, round(CASE WHEN s2 > s1 THEN i2 ELSE i1 END, 2) AS intercept FROM g WHERE rho >= 0.75),
y AS MATERIALIZED (SELECT a || '|' || b AS id, row_number() OVER (PARTITION BY a, b ORDER BY ts) - 1 AS r, CASE WHEN flip THEN y - intercept - weight * x ELSE x - intercept - weight * y END AS v FROM p JOIN c USING (a, b) WHERE weight <= 6 AND abs(intercept) <= 100)"""
query("k09_select_pairs", "a:s b:s weight:d intercept:d deviation:d", lambda s, d: K.select_pairs(grown_pairs(s, d)),
      f"""WITH RECURSIVE {adf_sql(SELECTED, True)}, dev AS (SELECT id, stddev_pop(v) AS deviation FROM y GROUP BY id)
FINALLY SELECT CASE WHEN flip THEN b ELSE a END AS a, CASE WHEN flip THEN a ELSE b END AS b, weight, intercept, deviation FROM c JOIN adf ON adf.id = c.a || '|' || c.b JOIN dev ON dev.id = adf.id
WHERE stat < {critical_sql('n', 2)} ORDER BY deviation DESC, 1, 2 LIMIT 100""", N)  # fmt: skip
query("k10_random_pairs", "a:s b:s", lambda s, d: K.random_pairs(monthly_pairs(s, d), 10), f"WITH {PAIRS}\nFINALLY SELECT DISTINCT a, b FROM p QUALIFY dense_rank() OVER (ORDER BY md5(a || '|' || b || '|7'), a, b) <= 10", N)


def windowed(s, d):
    return K.back_window(z_scores(s, d).select("pair", "ts", F.floor("spread").cast("double").alias("spread")), 21)


BW = "(PARTITION BY pair ORDER BY ts ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)"
query("k11_back_window", "pair:s ts:t spread:d mean:d sd:d", lambda s, d: windowed(s, d), f"WITH {DAILY}, s AS (SELECT pair, ts, floor(x - 0.5 * y) AS spread FROM p)\nFINALLY SELECT pair, ts, spread, CASE WHEN count(*) OVER {BW} >= 21 THEN round(avg(spread) OVER {BW}, 2) END AS mean, CASE WHEN count(*) OVER {BW} >= 21 THEN round(stddev_pop(spread) OVER {BW}, 2) END AS sd FROM s", B)


def traded(s, d):
    p = daily_pairs(s, d).withColumn("weight", F.lit(0.5)).withColumn("spread", F.col("x") - 0.5 * F.col("y"))
    return K.trade_pairs(K.back_window(p, 21), 1.0, 100_000.0)


COLS = "ts:t positive:l negative:l profit:d ret:d open:l margin:d"
query("k12_k14_pair_trades", "pair:s " + COLS, traded)
query("k13_margin", "pair:s ts:t margin:d", lambda s, d: traded(s, d).where("open > 0"))
query("k15_day_rollup", COLS, lambda s, d: K.day_rollup(traded(s, d), daily_pairs(s, d).select("pair").distinct().count()))
def liquidated(s, d):
    """The last bar of each pair, where nothing may stay open, beside what the bar before held and what closing it brought."""
    w = Window.partitionBy("pair").orderBy("ts")
    t = traded(s, d).withColumn("held", F.lag("open").over(w)).withColumn("later", F.lead("ts").over(w))
    return t.where("later IS NULL").select("pair", "ts", "held", "open", F.size("days_open").alias("closed"), "profit")


query("k16_liquidation", "pair:s ts:t held:l open:l closed:l profit:d", liquidated)


def walked(s, d):
    return K.walk_forward(monthly_pairs(s, d), inside=48, step=12, back=6, least=-1.0, top=5, farthest=1e9)


query("k17_walk_forward", "period:l pair:s " + COLS, walked)
def ratio_sql(short: int, windows: str) -> str:
    """The strategy bar by bar as window sums; windows is a table function of the long windows."""
    bar = f"OVER ({PAIR} ORDER BY n)"
    return f"""WITH {DAILY}, r AS (SELECT *, x / y AS ratio, row_number() OVER ({PAIR} ORDER BY ts) AS n FROM p), e AS (SELECT *, ratio - avg(ratio) OVER ({PAIR}) AS c FROM r),
s AS (SELECT *, sum(c) {bar} AS s1, sum(c * c) {bar} AS s2, CASE WHEN n >= {short} THEN avg(c) OVER ({PAIR} ORDER BY n ROWS {short - 1} PRECEDING) END AS near FROM e),
k(k) AS (SELECT * FROM {windows}),
z AS (SELECT s.pair, k, s.n, s.x, s.y, s.ratio, s.near, s.s1 - coalesce(q.s1, 0) AS a, s.s2 - coalesce(q.s2, 0) AS b FROM s JOIN k ON k >= 2 AND s.n >= k LEFT JOIN s q ON q.pair = s.pair AND q.n = s.n - k),
v AS (SELECT *, CASE WHEN (b - a * a / k) / (k - 1) > 1e-18 THEN (near - a / k) / sqrt((b - a * a / k) / (k - 1)) END AS z FROM z),
t AS (SELECT *, CASE WHEN z > 1 THEN 1 WHEN z < -1 THEN -1 ELSE 0 END AS side, coalesce(abs(z) < 0.75, false) AS sale FROM v),
h AS (SELECT *, sum(side) OVER w AS held, sum(side * ratio) OVER w AS owed FROM t WINDOW w AS (PARTITION BY pair, k ORDER BY n)),
f AS (SELECT pair, k, (held - lag(held, 1, 0) OVER w) * x - (owed - lag(owed, 1, 0) OVER w) * y AS money FROM h WHERE sale WINDOW w AS (PARTITION BY pair, k ORDER BY n)),
m AS (SELECT pair, k, coalesce(sum(money), 0) AS money FROM (SELECT DISTINCT pair FROM p) CROSS JOIN k LEFT JOIN f USING (pair, k) GROUP BY pair, k)
FINALLY """


query("k18_ratio_strategy", "pair:s money:d", lambda s, d: K.ratio_strategy(daily_pairs(s, d), 5, [60]), ratio_sql(5, "range(60, 61)") + "SELECT pair, money FROM m", B)
query("k19_window_search", "pair:s long:l money:d place:l", lambda s, d: K.ratio_strategy(daily_pairs(s, d), 5, list(range(255))).withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc(F.round("money", 2)), "long"))),
      ratio_sql(5, "range(0, 255)") + f"SELECT pair, k AS long, money, row_number() OVER ({PAIR} ORDER BY round(money, 2) DESC, k) AS place FROM m", B)


def portfolio_curve(s, d):
    """Balance, required margin, and the benchmark bought with the same money; with the return of the calendar year so far."""
    everything = W.running(Window.orderBy("ts"))  # one row a day
    benchmark = bars(s, d).where("ticker = 'MEDIUM'").select("ts", "close")
    curve = K.day_rollup(traded(s, d), daily_pairs(s, d).select("pair").distinct().count()).select("ts", (100_000 + F.sum("profit").over(everything)).alias("balance"), "margin").join(benchmark, "ts", "left")
    curve = curve.withColumn("close", F.last("close", ignorenulls=True).over(everything))
    year = Window.partitionBy(F.year("ts")).orderBy("ts")
    first = lambda c: F.first(c, ignorenulls=True)
    return curve.select("ts", "balance", "margin", (100_000 * F.col("close") / first("close").over(everything)).alias("benchmark"), (F.col("balance") / F.first("balance").over(year) - 1).alias("year_return"), (F.col("close") / first("close").over(year) - 1).alias("benchmark_year_return"))


query("k20_portfolio_curve", "ts:t balance:d margin:d benchmark:d year_return:d benchmark_year_return:d", portfolio_curve)
query("k21_compounding", "pair:s ts:t r:d c:d", lambda s, d: daily_pairs(s, d).select("pair", "ts", W.pct_change("x", pw()).alias("r")).select("pair", "ts", "r", F.sum(F.ln(1 + F.col("r"))).over(W.running(pw())).alias("c")),
      f"WITH {DAILY}, r AS (SELECT pair, ts, x / lag(x) OVER ({PAIR} ORDER BY ts) - 1 AS r FROM p)\nFINALLY SELECT pair, ts, r, sum(ln(1 + r)) OVER ({PAIR} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM r", B)


def _filter(name: str):
    def run(s, d):
        from tidemark.operators import filters

        return getattr(filters, name)(bars(s, d), "close")

    return run


NUMBERED = "b AS (SELECT ticker, ts, close AS x, row_number() OVER w - 1 AS n, close - lag(close) OVER w AS c FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))"


def ema_sql(name: str, source: str, c: str, start: int, k: int) -> str:
    """A recursive table name(ticker, n, v) over source(ticker, n, c), whose values begin at place start."""
    first = start + k - 1
    return f"""{name} AS (SELECT ticker, {first}::BIGINT AS n, avg({c}) AS v FROM {source} WHERE n BETWEEN {start} AND {first} GROUP BY ticker HAVING count(*) = {k}
UNION ALL SELECT e.ticker, s.n, e.v + {2 / (k + 1)!r}::DOUBLE * (s.{c} - e.v) FROM {name} e JOIN {source} s ON s.ticker = e.ticker AND s.n = e.n + 1)"""


query("w32_rsi", "ticker:s ts:t rsi:d", _filter("rsi"),
      f"""WITH RECURSIVE {NUMBERED}, r AS (SELECT ticker, 14::BIGINT AS n, avg(greatest(c, 0)) AS u, avg(greatest(-c, 0)) AS d FROM b WHERE n BETWEEN 1 AND 14 GROUP BY ticker HAVING count(*) = 14
UNION ALL SELECT r.ticker, b.n, (r.u * 13 + greatest(b.c, 0)) / 14, (r.d * 13 + greatest(-b.c, 0)) / 14 FROM r JOIN b ON b.ticker = r.ticker AND b.n = r.n + 1)
FINALLY SELECT ticker, ts, CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END AS rsi FROM b LEFT JOIN r USING (ticker, n)""", B)  # fmt: skip
query("w33_macd", "ticker:s ts:t macd:d signal:d histogram:d", _filter("macd"),
      f"WITH RECURSIVE {NUMBERED}, {ema_sql('fast', 'b', 'x', 0, 12)}, {ema_sql('slow', 'b', 'x', 0, 26)}, m AS (SELECT ticker, n, fast.v - slow.v AS m FROM fast JOIN slow USING (ticker, n)), {ema_sql('sig', 'm', 'm', 25, 9)}\nFINALLY SELECT ticker, ts, m AS macd, sig.v AS signal, m - sig.v AS histogram FROM b LEFT JOIN m USING (ticker, n) LEFT JOIN sig USING (ticker, n)", B)
query("w39_kalman", "ticker:s ts:t level:d", _filter("kalman"),
      f"""WITH RECURSIVE {NUMBERED}, k AS (SELECT ticker, n, x / 2 AS m, 0.5::DOUBLE AS v FROM b WHERE n = 0
UNION ALL SELECT k.ticker, b.n, k.m + (k.v + 0.01::DOUBLE) / (k.v + 1.01::DOUBLE) * (b.x - k.m), (1 - (k.v + 0.01::DOUBLE) / (k.v + 1.01::DOUBLE)) * (k.v + 0.01::DOUBLE) FROM k JOIN b ON b.ticker = k.ticker AND b.n = k.n + 1)
FINALLY SELECT ticker, ts, m AS level FROM b JOIN k USING (ticker, n)""", B)  # fmt: skip


def wavelet_sql(levels: int = 3, share: float = 0.5) -> str:
    """The transform by its definition: each place of a level gathers the values under its taps."""
    from tidemark.operators.filters import DB6

    low, n = DB6[::-1], len(DB6)
    high = [x * (-1.0) ** k for k, x in enumerate(DB6)]
    taps = ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in enumerate(zip(low, high)))
    block = 1 << levels
    parts = [
        f"f(k, lo, hi) AS (VALUES {taps})",
        f"size AS (SELECT ticker, max(n) + 1 AS m, arg_max(x, n) AS e, (max(n) + {block}) // {block} * {block} AS len FROM b GROUP BY ticker)",
        "a0 AS (SELECT ticker, n AS i, x AS v FROM b UNION ALL SELECT ticker, unnest(range(m, len)), e FROM size)",
    ]
    for k in range(levels):
        long = f"len // {1 << k} >= {n}"
        places = f"(SELECT ticker, len // {1 << k} AS l, unnest(range(len // {2 << k})) AS i FROM size WHERE {long})"
        parts.append(f"b{k} AS MATERIALIZED (SELECT o.ticker, o.i, sum(v * lo) AS v, sum(v * hi) AS d FROM {places} o CROSS JOIN f JOIN a{k} a ON a.ticker = o.ticker AND a.i = (2 * o.i + k) % l GROUP BY 1, 2)")
        parts.append(f"a{k + 1} AS MATERIALIZED (SELECT ticker, i, v FROM b{k} UNION ALL SELECT ticker, i, v FROM a{k} JOIN size USING (ticker) WHERE NOT {long})")
    every = " UNION ALL ".join(f"SELECT ticker, d FROM b{k}" for k in range(levels))
    parts.append(f"t AS MATERIALIZED (SELECT ticker, {share} * max(abs(d)) AS t FROM ({every}) GROUP BY 1)")
    parts.append(f"c{levels} AS (SELECT * FROM a{levels})")
    for k in reversed(range(levels)):
        long = f"len // {1 << k} >= {n}"
        soft = "sign(d) * greatest(abs(d) - t, 0)"
        parts.append(f"""c{k} AS MATERIALIZED (SELECT c.ticker, (2 * c.i + k) % (len // {1 << k}) AS i, sum(c.v * lo + {soft} * hi) AS v FROM c{k + 1} c JOIN b{k} d ON d.ticker = c.ticker AND d.i = c.i
JOIN t ON t.ticker = c.ticker JOIN size ON size.ticker = c.ticker CROSS JOIN f WHERE {long} GROUP BY 1, 2 UNION ALL SELECT ticker, i, v FROM c{k + 1} JOIN size USING (ticker) WHERE NOT {long})""")
    return f"WITH {NUMBERED}, " + ", ".join(parts) + "\nFINALLY SELECT b.ticker, b.ts, c0.v AS smooth FROM b JOIN c0 ON c0.ticker = b.ticker AND c0.i = b.n"


query("w41_wavelet_denoise", "ticker:s ts:t smooth:d", _filter("denoise"), wavelet_sql(), B)

"""Back-test, ledger, grading and performance queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.operators import backtest as B, timing
from tidemark.plans.registry import query
from tidemark.plans.views import SPEARMAN, bars, ledger, ticks

L = ("bars", "ledger")


def day():
    return W.series_order("ticker", by=("ts",))


RUN = "PARTITION BY run ORDER BY ts"


def signals(s, d):
    """Runs for the simulators: price, momentum as signal, open regime."""
    b = bars(s, d).select(F.col("ticker").alias("run"), "ts", F.col("close").alias("price"), F.coalesce(W.momentum("close", day(), 3), F.lit(0.0)).alias("signal"))
    return b.withColumn("regime", F.lit(1.0))


STATE = "run:s ts:t exposure:d cash:d turnover:d nav:d"
def simulated_sql(short: bool) -> str:
    """The simulators' rules as a recursion over bars, with their standard parameters."""
    upper, lower, ceiling = (0.8, 0.2, 2_000_000) if short else (0.7, 0.4, 1_000_000)
    entry = "CASE WHEN s > upper THEN least(cash, 2000000) * 0.95::DOUBLE / p WHEN s < lower THEN -least(cash, 2000000) * 0.5::DOUBLE / p ELSE 0 END" if short else "CASE WHEN s >= upper THEN least(0.95::DOUBLE * cash, 950000) / p ELSE 0 END"
    left = "cash - trade * p" if short else "greatest(cash - trade * p, 0)"
    return f"""WITH RECURSIVE sig AS (SELECT ticker AS run, ts, close AS p, coalesce(close - lag(close, 3) OVER w, 0) AS s, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY ticker) AS n FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
cuts AS (SELECT run, quantile_cont(s, {upper}) AS upper, quantile_cont(s, {lower}) AS lower FROM sig GROUP BY run), bar AS (SELECT * FROM sig JOIN cuts USING (run)),
sim AS (SELECT run, ts, t, p, 1000000::DOUBLE AS cash, 0::DOUBLE AS shares FROM bar WHERE t = 0
UNION ALL SELECT run, ts, t, p, cash + over * p, CASE WHEN abs(shares - over) < 1e-12 THEN 0 ELSE shares - over END FROM (
  SELECT *, CASE WHEN abs(shares) * p > {ceiling} + 0.01::DOUBLE THEN (abs(shares) - {ceiling} / p) * sign(shares) ELSE 0 END AS over FROM (
    SELECT run, ts, t, p, {left} AS cash, shares + trade AS shares FROM (
      SELECT * EXCLUDE (raw), CASE WHEN raw > 0 AND raw * p > cash + 0.01::DOUBLE THEN greatest(0, cash / p) ELSE raw END AS trade FROM (
        SELECT * EXCLUDE (want), CASE WHEN t = n - 1 THEN want - shares ELSE greatest(-20000 / p, least(20000 / p, want - shares)) END AS raw FROM (
          SELECT b.*, m.cash, m.shares, CASE WHEN b.t = b.n - 1 THEN 0 WHEN shares = 0 THEN CASE WHEN b.t < b.n - 6 THEN {entry.replace(' p', ' b.p')} ELSE 0 END
            WHEN shares > 0 THEN CASE WHEN s < lower THEN 0 ELSE shares END ELSE CASE WHEN s > upper THEN 0 ELSE shares END END AS want FROM sim m JOIN bar b ON b.run = m.run AND b.t = m.t + 1))))))
FINALLY SELECT run, ts, round(abs(shares) * p, 8) AS exposure, round(cash, 8) AS cash, round(abs(cash - coalesce(lag(cash) OVER (PARTITION BY run ORDER BY ts), 1000000)), 8) AS turnover, round(cash + shares * p, 8) AS nav FROM sim"""


query("b01_long_only", STATE, lambda s, d: B.backtest(signals(s, d), B.LongOnly()), simulated_sql(False), ("bars",))
query("b02_long_short", STATE, lambda s, d: B.backtest(signals(s, d), B.LongShort()), simulated_sql(True), ("bars",))
query("b03_recomputed_turnover", STATE, lambda s, d: B.recomputed(ledger(s, d).withColumn("turnover", F.lit(0.0))), f"SELECT run, ts, round(exposure, 8) AS exposure, round(cash, 8) AS cash, round(abs(cash - coalesce(lag(cash) OVER ({RUN}), 1000000)), 8) AS turnover, round(nav, 8) AS nav FROM ledger", L)
CHECKS = "run:s n:l negative_exposure:l negative_turnover:l repeated_time:l nav_off:l cash_off:l negative_cash:l not_flat:l valid:b"
VIOLATIONS = f"d AS (SELECT *, abs(cash - coalesce(lag(cash) OVER ({RUN}), 1000000)) AS dc, lag(ts) OVER ({RUN}) = ts AS dup FROM {{t}}), v AS (SELECT run, count(*) AS n, count_if(exposure < 0) AS negative_exposure, count_if(turnover < 0) AS negative_turnover, count_if(dup) AS repeated_time, count_if(abs(abs(nav - cash) - exposure) > 0.01) AS nav_off, count_if(abs(dc - turnover) > 0.01) AS cash_off, count_if(cash < -0.01) AS negative_cash, CAST(abs(arg_min(exposure, ts)) > 0.01 AS INT) + CAST(abs(arg_max(exposure, ts)) > 0.01 AS INT) AS not_flat FROM d GROUP BY run), w AS (SELECT *, negative_exposure + negative_turnover + repeated_time + nav_off + cash_off + not_flat = 0 AS valid FROM v)"
BROKEN = "b AS (SELECT run, ts, exposure, CASE WHEN run = 'LARGE' AND day(ts) = 3 THEN cash + 5 ELSE cash END AS cash, CASE WHEN run = 'SMALL' AND day(ts) = 9 THEN -turnover ELSE turnover END AS turnover, nav FROM ledger)"


def broken(s, d):
    return ledger(s, d).withColumn("cash", F.when((F.col("run") == "LARGE") & (F.dayofmonth("ts") == 3), F.col("cash") + 5).otherwise(F.col("cash"))).withColumn("turnover", F.when((F.col("run") == "SMALL") & (F.dayofmonth("ts") == 9), -F.col("turnover")).otherwise(F.col("turnover")))


query("b04_validate_ledger", CHECKS, lambda s, d: B.violations(ledger(s, d)), f"WITH {VIOLATIONS.format(t='ledger')}\nFINALLY SELECT * FROM w", L)
query("b05_structural_grading", CHECKS, lambda s, d: B.violations(broken(s, d)), f"WITH {BROKEN}, {VIOLATIONS.format(t='b')}\nFINALLY SELECT * FROM w", L)
NET = f"net AS (SELECT *, nav - sum(turnover * 0.001) OVER ({RUN} ROWS UNBOUNDED PRECEDING) AS net FROM {{t}}), r AS (SELECT run, coalesce(net / lag(net) OVER ({RUN}) - 1, 0) AS r FROM net), s AS (SELECT run, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(18900.0) ELSE 0 END, 4) AS sharpe FROM r GROUP BY run)"
GRADED = f"{VIOLATIONS.format(t='b')}, {NET.format(t='b')}, m AS (SELECT run, max(exposure) AS top, min(net) AS least FROM net GROUP BY run), g AS (SELECT run, CASE WHEN NOT valid THEN 'structure' WHEN negative_cash > 0 THEN 'margin' WHEN top > {{cap}} THEN 'cap' WHEN least <= 0 THEN 'bankrupt' ELSE 'valid' END AS status, sharpe AS s FROM w JOIN m USING (run) JOIN s USING (run)), grade AS (SELECT run, status, CASE WHEN status = 'valid' THEN s ELSE 0 END AS sharpe FROM g)"
query("b06_strategy_grading", "run:s status:s sharpe:d", lambda s, d: B.grades(broken(s, d), 700000.0), f"WITH {BROKEN}, {GRADED.format(cap=700000)}\nFINALLY SELECT * FROM grade", L)
query("b07_leaderboard", "team:s sharpe:d status:s", lambda s, d: B.leaderboard(B.grades(broken(s, d), 700000.0), B.grades(broken(s, d), 2000000.0)),
      f"WITH {BROKEN}, {GRADED.format(cap=700000)}, grade2 AS (SELECT run, CASE WHEN NOT valid THEN 'structure' WHEN negative_cash > 0 THEN 'margin' WHEN top > 2000000 THEN 'cap' WHEN least <= 0 THEN 'bankrupt' ELSE 'valid' END AS status, s.sharpe FROM w JOIN m USING (run) JOIN s USING (run))\nFINALLY SELECT a.run AS team, CASE WHEN a.status = 'valid' AND b.status = 'valid' THEN (a.sharpe + b.sharpe) / 2 ELSE 0 END AS sharpe, CASE WHEN a.status = 'valid' AND b.status = 'valid' THEN 'valid' ELSE 'disqualified' END AS status FROM grade a JOIN grade2 b ON a.run = b.run", L)
query("b08_graded_sharpe", "run:s sharpe:d", lambda s, d: B.graded_sharpe(ledger(s, d)), f"WITH {NET.format(t='ledger')}\nFINALLY SELECT * FROM s", L)
PERF = f"p AS (SELECT run, ts, nav, turnover, (nav - lag(nav) OVER ({RUN})) / nav AS r, (nav - max(nav) OVER ({RUN} ROWS UNBOUNDED PRECEDING)) / (max(nav) OVER ({RUN} ROWS UNBOUNDED PRECEDING) + 1e-12) AS dd FROM ledger), q AS (SELECT run, quantile_cont(r, 0.05) AS q5, quantile_cont(r, 0.01) AS q1, quantile_cont(r, 0.99) AS q99, avg(r) AS mu, stddev_pop(r) AS sp FROM p GROUP BY run), a AS (SELECT run, count(nav) AS n, arg_max(nav, ts) / arg_min(nav, ts) - 1 AS total_return, pow(arg_max(nav, ts) / arg_min(nav, ts), 18900.0 / count(nav)) - 1 AS annual_return, stddev_samp(r) * sqrt(18900.0) AS volatility, avg(r) / stddev_samp(r) * sqrt(18900.0) AS sharpe, avg(r) / stddev_samp(r) FILTER (WHERE r < 0) * sqrt(18900.0) AS sortino, min(dd) AS max_drawdown, avg(dd) FILTER (WHERE dd < 0) AS average_drawdown, max(q5) AS var_95, avg(r) FILTER (WHERE r <= q5) AS cvar_95, (sum(pow(r - mu, 3)) / count(r)) / pow(max(sp), 3) AS skew, (sum(pow(r - mu, 4)) / count(r)) / pow(max(sp), 4) - 3 AS kurtosis, abs(max(q99) / max(q1)) AS tail_ratio, avg(turnover) FILTER (WHERE turnover > 0) AS average_turnover, avg(nav) AS an FROM p JOIN q USING (run) GROUP BY run)"
for name, columns in (
    ("b09_annual_return", ["annual_return"]), ("b10_total_return", ["total_return"]), ("b11_risk_ratios", ["volatility", "sharpe", "sortino", "calmar"]), ("b12_drawdowns", ["max_drawdown", "average_drawdown"]),
    ("b15_tail_risk", ["var_95", "cvar_95", "skew", "kurtosis", "tail_ratio"]), ("b16_turnover_and_holding", ["average_turnover", "holding_days"]),
    ("b17_all_metrics", ["n", "total_return", "annual_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "average_drawdown", "var_95", "cvar_95", "skew", "kurtosis", "tail_ratio", "average_turnover", "holding_days"]),
):
    query(name, "run:s " + " ".join(f"{c}:{'l' if c == 'n' else 'd'}" for c in columns), lambda s, d: B.performance(ledger(s, d)), f"WITH {PERF}\nFINALLY SELECT run, " + ", ".join({"calmar": "annual_return / abs(max_drawdown) AS calmar", "holding_days": "an / (average_turnover * 75) AS holding_days"}.get(c, c) for c in columns) + " FROM a", L)


def trade_input(s, d):
    w = Window.partitionBy("run").orderBy("ts")
    return ledger(s, d).select("run", "ts", F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(0)).alias("change"), F.coalesce(F.col("nav") - F.lag("nav").over(w), F.lit(0.0)).alias("pnl"))


TRADES = f"x AS (SELECT run, ts, coalesce(pos - lag(pos) OVER ({RUN}), 0) AS change, coalesce(nav - lag(nav) OVER ({RUN}), 0) AS pnl FROM ledger), c AS (SELECT run, pnl, change <> 0 AS moved, sum(CAST(change <> 0 AS INT)) OVER ({RUN} ROWS UNBOUNDED PRECEDING) AS c FROM x), t AS (SELECT run, CAST(floor((c + 1) / 2 - CASE WHEN moved THEN 0.5 ELSE 0 END) AS BIGINT) AS trade, sum(pnl) AS pnl FROM c WHERE c > 0 AND ((c % 2 = 1 AND NOT moved) OR (c % 2 = 0 AND moved)) GROUP BY 1, 2)"
query("b13_trades", "run:s trade:l pnl:d", lambda s, d: B.trades(trade_input(s, d)), f"WITH {TRADES}\nFINALLY SELECT * FROM t", L)
query("b14_trade_stats", "run:s trades:l profit_factor:d hit:d average_win:d average_loss:d win_loss:d", lambda s, d: B.trade_stats(B.trades(trade_input(s, d))), f"WITH {TRADES}\nFINALLY SELECT run, count(*) AS trades, sum(pnl) FILTER (WHERE pnl > 0) / abs(sum(pnl) FILTER (WHERE pnl < 0)) AS profit_factor, avg(CAST(pnl > 0 AS INT)) AS hit, avg(pnl) FILTER (WHERE pnl > 0) AS average_win, avg(pnl) FILTER (WHERE pnl < 0) AS average_loss, avg(pnl) FILTER (WHERE pnl > 0) / abs(avg(pnl) FILTER (WHERE pnl < 0)) AS win_loss FROM t GROUP BY run", L)
REGIME = SPEARMAN.format(
    head="rows AS (SELECT ticker AS key, ts, row_number() OVER w AS n, lag(signal) OVER w AS a, coalesce(close / lag(close) OVER w - 1, 0) AS b FROM (SELECT *, coalesce(close - lag(close, 3) OVER (PARTITION BY ticker ORDER BY ts), 0) AS signal FROM bars) WINDOW w AS (PARTITION BY ticker ORDER BY ts))",
    last=1999, window=2000, flat=0,
) + ", regime AS (SELECT key AS run, ts, coalesce(lag(v) OVER (PARTITION BY key ORDER BY ts), 1) AS regime FROM rho)"
query("w27_regime_ic", "run:s ts:t regime:d", lambda s, d: B.regime_ic(signals(s, d).drop("regime")), f"WITH {REGIME}\nFINALLY SELECT * FROM regime", ("bars",))
query("b18_regime_gate", "run:s open:l n:l", lambda s, d: B.regime_ic(signals(s, d).drop("regime")).groupBy("run").agg(F.count_if(F.col("regime") >= 0.02).alias("open"), F.count(F.lit(1)).alias("n")), f"WITH {REGIME}\nFINALLY SELECT run, count_if(regime >= 0.02) AS open, count(*) AS n FROM regime GROUP BY run", ("bars",))


#: The sweep's parameters, in percent and shares of capital.
LONG_GRID = [(a, b, c) for a in (85.0, 95.0, 97.0) for b in (15.0, 42.0, 30.0) for c in (0.85, 0.90, 0.95)]
SHORT_GRID = [(a, b, c) for a in (93.0, 95.0, 97.0) for b in (0.08, 0.10, 0.12) for c in (0.01, 0.02, 0.03)]


def grid_search(s, d):
    """Long-only and long-short sweeps over every ticker; place within the sweep of a run, and the mean of the best two."""
    sides = []
    for side, grid, fields, kind in (("long", LONG_GRID, ("entry_percentile", "exit_percentile", "fraction"), B.LongOnly()), ("short", SHORT_GRID, ("long_percentile", "long_fraction", "short_fraction"), B.LongShort())):
        runs = s.createDataFrame([(f"/{side}/" + "/".join(f"{v:g}" for v in x), *x) for x in grid], "params string, " + ", ".join(f"{f} double" for f in fields))
        sides.append(B.graded_sharpe(B.backtest(signals(s, d), kind, runs)).select(F.split("run", "/")[0].alias("ticker"), F.lit(side).alias("side"), "run", "sharpe"))
    swept = sides[0].unionByName(sides[1])
    best = Window.partitionBy("ticker")
    top = lambda side: F.max(F.when(F.col("side") == side, F.col("sharpe"))).over(best)
    return swept.withColumn("place", F.row_number().over(Window.partitionBy("ticker", "side").orderBy(F.desc("sharpe"), "run"))).withColumn("blended", (top("long") + top("short")) / 2)


query("b19_grid_search", "ticker:s side:s run:s sharpe:d place:l blended:d", grid_search)


def weekly(s, d, n=2):
    """Weights at the start of each week: the n lowest factors long, the n highest short, others none; and the week's return of the portfolio."""
    w = Window.partitionBy("ticker").orderBy("week")
    x = bars(s, d).groupBy("ticker", F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(F.max_by("close", "ts").alias("p"))
    x = x.select("ticker", "week", (F.col("p") / F.lag("p").over(w) - 1).alias("r")).na.drop()
    place = Window.partitionBy("week")
    x = x.withColumn("a", F.row_number().over(place.orderBy("r", "ticker"))).withColumn("m", F.count(F.lit(1)).over(place))
    return x.select("ticker", "week", "r", F.when(F.col("a") <= n, 1.0 / n).when(F.col("a") > F.col("m") - n, -1.0 / n).otherwise(0.0).alias("weight"))


WEEK = "x AS (SELECT ticker, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week, arg_max(close, ts) AS p FROM bars GROUP BY 1, 2), y AS (SELECT ticker, week, p / lag(p) OVER (PARTITION BY ticker ORDER BY week) - 1 AS r FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY r, ticker) AS a, count(*) OVER (PARTITION BY week) AS m FROM y WHERE r IS NOT NULL), w AS (SELECT ticker, week, r, CASE WHEN a <= 2 THEN 0.5 WHEN a > m - 2 THEN -0.5 ELSE 0 END AS weight FROM z)"
K = ("bars",)
WT = "PARTITION BY ticker ORDER BY week"
query("b20_weekly_rebalance", "week:t v:d", lambda s, d: (lambda x: x.select("week", (F.lag("weight").over(Window.partitionBy("ticker").orderBy("week")) * F.col("r")).alias("v")).groupBy("week").agg(F.sum("v").alias("v")))(weekly(s, d)), f"WITH {WEEK}, l AS (SELECT week, lag(weight) OVER ({WT}) * r AS v FROM w)\nFINALLY SELECT week, sum(v) AS v FROM l GROUP BY week", K)
query("b21_costs", "week:t cost:d", lambda s, d: weekly(s, d).withColumn("dw", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(Window.partitionBy("ticker").orderBy("week")), F.lit(0.0)))).groupBy("week").agg(F.sum(F.col("dw") * 10000 * 0.00075 + F.pow("dw", 2) * 0.1).alias("cost")), f"WITH {WEEK}, l AS (SELECT week, abs(weight - coalesce(lag(weight) OVER ({WT}), 0)) AS dw FROM w)\nFINALLY SELECT week, sum(dw * 10000 * 0.00075 + pow(dw, 2) * 0.1) AS cost FROM l GROUP BY week", K)
query("b22_positions_and_transactions", "run:s ts:t position:d traded:d r:d", lambda s, d: ledger(s, d).select("run", "ts", F.col("exposure").alias("position"), F.col("turnover").alias("traded"), W.pct_change("nav", Window.partitionBy("run").orderBy("ts")).alias("r")), f"SELECT run, ts, exposure AS position, turnover AS traded, nav / lag(nav) OVER ({RUN}) - 1 AS r FROM ledger", L)
MKT = f"r AS (SELECT run, ts, close / lag(close) OVER ({RUN}) - 1 AS r FROM ledger), m AS (SELECT ts, avg(r) AS market FROM r GROUP BY ts), j AS (SELECT run, ts, r, market FROM r JOIN m USING (ts) WHERE r IS NOT NULL)"


def benchmarked(s, d):
    r = ledger(s, d).select("run", "ts", W.pct_change("close", Window.partitionBy("run").orderBy("ts")).alias("r"))
    return r.where("r IS NOT NULL").join(r.groupBy("ts").agg(F.avg("r").alias("market")), "ts")


query("b23_against_benchmark", "run:s beta:d alpha:d omega:d sharpe:d", lambda s, d: B.against_benchmark(benchmarked(s, d)), f"WITH {MKT}\nFINALLY SELECT run, regr_slope(r, market) AS beta, regr_intercept(r, market) * 252 AS alpha, sum(r) FILTER (WHERE r > 0) / -sum(r) FILTER (WHERE r < 0) AS omega, avg(r) / stddev_samp(r) * sqrt(252.0) AS sharpe FROM j GROUP BY run", L)
F60 = f"({RUN} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def rw():
    return Window.partitionBy("run").orderBy("ts")


query("b24_rolling_sharpe_beta", "run:s ts:t sharpe:d beta:d", lambda s, d: benchmarked(s, d).select("run", "ts", (W.rolling_mean("r", rw(), 60, 60) / W.rolling_std("r", rw(), 60, 60) * F.sqrt(F.lit(252.0))).alias("sharpe"), W.rolling_beta("r", "market", rw(), 60).alias("beta")), f"WITH {MKT}\nFINALLY SELECT run, ts, CASE WHEN count(r) OVER {F60} >= 60 THEN avg(r) OVER {F60} / stddev_samp(r) OVER {F60} * sqrt(252.0) END AS sharpe, CASE WHEN count(r) OVER {F60} >= 60 THEN covar_samp(r, market) OVER {F60} / var_samp(market) OVER {F60} END AS beta FROM j", L)
query("b25_event_window", "run:s ts:t c:d market_c:d", lambda s, d: benchmarked(s, d).where("ts BETWEEN timestamp_ntz'1998-01-01' AND timestamp_ntz'1998-03-31'").select("run", "ts", F.sum(F.col("r") / 100).over(rw()).alias("c"), F.sum(F.col("market") / 100).over(rw()).alias("market_c")), f"WITH {MKT}, e AS (SELECT * FROM j WHERE ts BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-31')\nFINALLY SELECT run, ts, sum(r / 100) OVER ({RUN}) AS c, sum(market / 100) OVER ({RUN}) AS market_c FROM e", L)


def summary_metrics(s, d):
    """total, apr, sharpe, sortino with population deviations, greatest drawdown and its longest duration in bars."""
    w = rw()
    x = ledger(s, d).select("run", "ts", "nav", W.pct_change("nav", w).alias("r"), F.max("nav").over(W.running(w)).alias("hwm"), F.row_number().over(w).alias("n"))
    x = x.withColumn("since", F.col("n") - F.max(F.when(F.col("nav") >= F.col("hwm"), F.col("n"))).over(W.running(w)))
    down = F.stddev_pop(F.when(F.col("r") < 0, F.col("r")))
    return x.groupBy("run").agg((F.max_by("nav", "ts") / F.min_by("nav", "ts") - 1).alias("total"), (F.pow(F.max_by("nav", "ts") / F.min_by("nav", "ts"), 252.0 / F.count("r")) - 1).alias("apr"), (F.avg("r") / F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.avg("r") / down * F.sqrt(F.lit(252.0))).alias("sortino"), F.min(F.col("nav") / F.col("hwm") - 1).alias("mdd"), F.max("since").alias("longest"))


query("b26_summary_metrics", "run:s total:d apr:d sharpe:d sortino:d mdd:d longest:l", summary_metrics, f"WITH x AS (SELECT run, ts, nav, nav / lag(nav) OVER ({RUN}) - 1 AS r, max(nav) OVER ({RUN} ROWS UNBOUNDED PRECEDING) AS hwm, row_number() OVER ({RUN}) AS n FROM ledger), y AS (SELECT *, n - max(CASE WHEN nav >= hwm THEN n END) OVER ({RUN} ROWS UNBOUNDED PRECEDING) AS since FROM x)\nFINALLY SELECT run, arg_max(nav, ts) / arg_min(nav, ts) - 1 AS total, pow(arg_max(nav, ts) / arg_min(nav, ts), 252.0 / count(r)) - 1 AS apr, avg(r) / stddev_pop(r) * sqrt(252.0) AS sharpe, avg(r) / stddev_pop(r) FILTER (WHERE r < 0) * sqrt(252.0) AS sortino, min(nav / hwm - 1) AS mdd, max(since) AS longest FROM y GROUP BY run", L)


def phase_log(s, d):
    """A log of timings: kinds of events are phases, their series' last digit the module, their sizes the seconds."""
    return ticks(s, d).select(F.col("kind").alias("phase"), (F.col("series") % 10).cast("string").alias("module"), F.abs("x").alias("seconds"))


query("b27_phase_timer", "phase:s module:s seconds:d percent:d", lambda s, d: timing.shares(phase_log(s, d)),
      "WITH p AS (SELECT kind AS phase, CAST(series % 10 AS VARCHAR) AS module, sum(abs(x)) AS seconds FROM ticks GROUP BY 1, 2)\nFINALLY SELECT *, 100 * seconds / sum(seconds) OVER () AS percent FROM p", ("ticks",))
query("b27_module_rollup", "module:s seconds:d n:l", lambda s, d: timing.by_module(phase_log(s, d)), "SELECT CAST(series % 10 AS VARCHAR) AS module, sum(abs(x)) AS seconds, count(*) AS n FROM ticks GROUP BY 1", ("ticks",))

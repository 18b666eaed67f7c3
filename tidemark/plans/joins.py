"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.functions.stats import exact_quantiles
from tidemark.operators import joins as J
from tidemark.plans.registry import query
from tidemark.plans.views import bars, entities, nation_months, table, ticks



def day():
    return W.series_order("ticker", by=("ts",))


BAR = "PARTITION BY ticker ORDER BY ts"
B = ("bars",)
MARKET = "m AS (SELECT ts, avg(close) AS market FROM bars GROUP BY ts)"


def market(df):
    return df.groupBy("ts").agg(F.avg("close").alias("market"))


query("j01_join_on_date", "ticker:s ts:t close:d market:d", lambda s, d: bars(s, d).join(market(bars(s, d)), "ts"), f"WITH {MARKET}\nFINALLY SELECT ticker, ts, close, market FROM bars JOIN m USING (ts)", B)
query("j02_lagged_left_join", "ticker:s ts:t close:d before:d", lambda s, d: bars(s, d).join(bars(s, d).select("ticker", "ts", F.lag("close").over(day()).alias("before")).na.drop(), ["ticker", "ts"], "left"), f"SELECT ticker, ts, close, lag(close) OVER ({BAR}) AS before FROM bars", B)
query("j03_metadata_left_join", "ticker:s ts:t parts:l", lambda s, d: bars(s, d).join(F.broadcast(entities(s, d).groupBy(F.col("sector").alias("ticker")).agg(F.count(F.lit(1)).alias("parts"))), "ticker", "left"), "SELECT ticker, ts, parts FROM bars LEFT JOIN (SELECT sector AS ticker, count(*) AS parts FROM entities GROUP BY 1) USING (ticker)", ("bars", "entities"))
query("j04_index_alignment", "ts:t v:d", lambda s, d: bars(s, d).where("ticker = 'LARGE'").select("ts", F.col("close").alias("a")).join(bars(s, d).where("ticker = 'SMALL'").select("ts", F.col("close").alias("b")), "ts").select("ts", (F.col("a") - F.col("b")).alias("v")), "SELECT a.ts, a.close - b.close AS v FROM bars a JOIN bars b ON a.ts = b.ts AND a.ticker = 'LARGE' AND b.ticker = 'SMALL'", B)
query("j05_semi_join", "o_orderkey:l", lambda s, d: table(s, d, "orders").join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi"), "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
query("j06_reindex", "name:s n:l", lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).join(table(s, d, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", "left").na.fill(0, ["n"]), "SELECT n_name AS name, coalesce(n, 0) AS n FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) ON n_nationkey = s_nationkey")
query("j07_asof", "series:l ts:t tie:l close:d", lambda s, d: J.asof(ticks(s, d).where("kind = 'click'").select("series", "ts", "tie"), ticks(s, d).where("kind = 'purchase'").groupBy("series", "ts").agg(F.max("x").alias("close")), "close", ["series"]),
      "WITH p AS (SELECT series, ts, max(x) AS close FROM ticks WHERE kind = 'purchase' GROUP BY 1, 2), c AS (SELECT series, ts, tie FROM ticks WHERE kind = 'click')\nFINALLY SELECT c.series, c.ts, tie, close FROM c ASOF LEFT JOIN p ON c.series = p.series AND c.ts >= p.ts", ("ticks",))


def _names(s, d):
    return table(s, d, "nation").select(F.col("n_name").alias("name"))


query("j08_unordered_pairs", "a:s b:s", lambda s, d: J.unordered_pairs(_names(s, d)), "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name")
query("j09_antisymmetric_pairs", "a:s b:s v:d", lambda s, d: (lambda p: p.union(p.select("b", "a", -F.col("v"))))(J.unordered_pairs(_names(s, d)).select("a", "b", (F.length("a") - F.length("b")).alias("v"))), "SELECT a.n_name AS a, b.n_name AS b, length(a.n_name) - length(b.n_name) AS v FROM nation a JOIN nation b ON a.n_name <> b.n_name")
query("j10_pairs_within_sector", "a:s b:s sector:s", lambda s, d: (lambda n: n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey").where("a < b").join(table(s, d, "region").select("r_regionkey", F.col("r_name").alias("sector")), F.col("n_regionkey") == F.col("r_regionkey")))(table(s, d, "nation")), "SELECT a.n_name AS a, b.n_name AS b, r_name AS sector FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON a.n_regionkey = r_regionkey")
query("j11_intersection", "k:l", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select(F.col("s_nationkey").alias("k"))), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
query("j12_difference", "k:l", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(s, d, "orders").select(F.col("o_custkey").alias("k"))), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
query("j12_union", "k:l", lambda s, d: table(s, d, "customer").where("c_acctbal > 9500").select(F.col("c_custkey").alias("k")).union(table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("k"))).distinct(), "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9500 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
query("j13_outer_pairing", "k:l a:l b:l", lambda s, d: table(s, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a")).join(table(s, d, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b")), "k", "full").na.fill(0), "SELECT k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) USING (k)")
def parameter_grid(s, d):
    """Entry and exit levels at quantiles of the data, with shares of capital: every combination."""
    x = exact_quantiles(ticks(s, d), "x", [0.3, 0.4, 0.5, 0.6, 0.7, 0.8])
    rows = [(entry, leave, share) for entry in x[3:] for leave in x[:3] for share in (0.5, 0.75, 0.95)]
    return s.createDataFrame(rows, "entry double, exit double, frac double")


query("j14_parameter_grid", "entry:d exit:d frac:d", parameter_grid,
      "WITH q AS (SELECT unnest(quantile_cont(x, [0.6, 0.7, 0.8])) AS entry FROM ticks), r AS (SELECT unnest(quantile_cont(x, [0.3, 0.4, 0.5])) AS exit FROM ticks)\nFINALLY SELECT entry, exit, frac FROM q, r, (VALUES (0.5), (0.75), (0.95)) t(frac)", ("ticks",))


def _lagged(s, d):
    p = ticks(s, d).withColumn("place", F.row_number().over(W.series_order("series"))).select("series", "place", F.col("x"), (F.col("x") * F.col("place") % 17).alias("y"))
    return J.lag_pairs(p, 3, ["series"]).groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") - F.col("y")).alias("v"))


query("j15_lag_join", "lag:l n:l v:d", _lagged, "WITH p AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts, tie) AS place, x FROM ticks), q AS (SELECT *, (x * place) % 17 AS y FROM p)\nFINALLY SELECT lag, count(*) AS n, avg(a.x - b.y) AS v FROM q a JOIN (SELECT unnest(range(-3, 4)) AS lag) ON true JOIN q b ON a.series = b.series AND b.place = a.place + lag GROUP BY lag", ("ticks",))
query("x06_date_indicators", "name:s ts:t year:l month:l", lambda s, d: nation_months(s, d).select("name", "ts", F.year("ts").alias("year"), F.month("ts").alias("month")), "SELECT name, ts, year(ts) AS year, month(ts) AS month FROM nation_months", ("nation_months",))

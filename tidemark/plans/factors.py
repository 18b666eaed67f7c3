"""Cross-sectional factor queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.operators import factors as X
from tidemark.plans.registry import query
from tidemark.plans.views import bars, entities
from tidemark.plans.windows import quantile_bucket, rolled



def day():
    return W.series_order("ticker", by=("ts",))


BAR = "PARTITION BY ticker ORDER BY ts"
B = ("bars",)


def reverted(s, d):
    m = bars(s, d).select("ticker", "ts", "close", "volume", (F.col("close") / F.lag("close", 21).over(day()) - 1).alias("monthly"))
    return m.select("ticker", "ts", X.FACTORS["mean_reversion"](day()).alias("v"), X.FACTORS["dollar_volume"](day()).alias("dv"))


M = f"m AS (SELECT ticker, ts, close, volume, close * volume AS cv, close / lag(close, 21) OVER ({BAR}) - 1 AS monthly FROM bars), f AS (SELECT ticker, ts, (monthly - {rolled('avg(monthly)', 252, 252, 'monthly', BAR)}) / nullif({rolled('stddev_samp(monthly)', 252, 252, 'monthly', BAR)}, 0) AS v, {rolled('avg(cv)', 30, 30, 'cv', BAR)} AS dv FROM m)"
query("x01_mean_reversion", "ticker:s ts:t v:d", reverted, f"WITH {M}\nFINALLY SELECT ticker, ts, v FROM f", B)
query("x02_dollar_volume_screen", "ticker:s ts:t dv:d", lambda s, d: X.screened(reverted(s, d), "dv", "dv", 3, 2), f"WITH {M}\nFINALLY SELECT ticker, ts, dv FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY dv DESC, ticker) AS k FROM f WHERE dv IS NOT NULL) WHERE k <= 3", B)
query("x03_ranked_factor", "ticker:s ts:t rank:l longs:b shorts:b", lambda s, d: X.screened(reverted(s, d), "v", "dv", 4, 2), f"WITH {M}\nFINALLY SELECT ticker, ts, rank, l <= 2 AS longs, rank <= 2 AS shorts FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY v DESC, ticker) AS rank, row_number() OVER (PARTITION BY ts ORDER BY v, ticker) AS l, row_number() OVER (PARTITION BY ts ORDER BY dv DESC, ticker) AS k FROM f WHERE v IS NOT NULL) WHERE k <= 4", B)


def size(s, d):
    """Market values of the last bar carried back by returns, as deciles of a date."""
    r = bars(s, d).select("ticker", "ts", "close")
    cap = r.withColumn("cap", F.last("close").over(day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * 1000 * F.col("close") / F.last("close").over(day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return quantile_bucket(cap, "cap", 5, "ts")


QS = ", ".join(repr(i / 5) for i in range(1, 5))
query("x04_size_proxy", "ticker:s ts:t cap:d v:l", size, f"WITH c AS (SELECT ticker, ts, last_value(close) OVER w * 1000 * close / last_value(close) OVER w AS cap FROM bars WINDOW w AS ({BAR} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), e AS (SELECT ts, list_distinct(quantile_cont(cap, [{QS}])) AS edges FROM c GROUP BY ts)\nFINALLY SELECT ticker, ts, cap, 1 + len(list_filter(edges, lambda q: q < cap)) AS v FROM c JOIN e USING (ts)", B)
query("x05_age_proxy", "entity:l v:l", lambda s, d: quantile_bucket(entities(s, d), "year", 5), f"WITH e AS (SELECT list_distinct(quantile_cont(year, [{QS}])) AS edges FROM entities)\nFINALLY SELECT entity, 1 + len(list_filter(edges, lambda q: q < year)) AS v FROM entities CROSS JOIN e", ("entities",))

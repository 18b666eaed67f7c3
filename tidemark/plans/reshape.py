"""Queries over reshaping, cleaning and splitting."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.operators import reshape as R
from tidemark.plans.registry import query
from tidemark.plans.views import bars, design, entities, nation_months, table, ticks

B = ("bars",)
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
BAR = "PARTITION BY ticker ORDER BY ts"
PIV = "max(CASE WHEN ticker = '{t}' THEN {c} END)"
query("p01_pivot_wide", "ts:t close:d f1:d f2:d f3:d f4:d f5:d volume:d", lambda s, d: R.to_wide(bars(s, d), "LARGE", TYPES),
      "SELECT ts, " + ", ".join([PIV.format(t="LARGE", c="close") + " AS close"] + [PIV.format(t=t, c="close") + f" AS f{i + 1}" for i, t in enumerate(t for t in TYPES if t != "LARGE")] + [PIV.format(t="LARGE", c="volume") + " AS volume"]) + " FROM bars GROUP BY ts", B)
query("p02_ticker_order", "name:s place:l", lambda s, d: table(s, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("name"), F.row_number().over(Window.orderBy(F.expr("cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int)"), "p_brand")).alias("place")),
      "SELECT p_brand AS name, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def missing_target(s, d):
    """What pivoting says where the target is not among the tickers."""
    try:
        R.to_wide(bars(s, d), "NONE", ["LARGE", "SMALL"])
    except ValueError as e:
        return s.createDataFrame([(str(e),)], "message string")
    raise AssertionError("a missing target went unnoticed")


query("p03_missing_target", "message:s", missing_target, "SELECT 'target ''NONE'' is not among the tickers' AS message")
query("p06_unique_columns", "n_nationkey:l n_name:s", lambda s, d: R.unique_columns(table(s, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("n_name"))), "SELECT n_nationkey, n_name FROM nation")
query("p04_stack", "id:l name:s value:d", lambda s, d: R.to_long(design(s, d), "id", ["f1", "f2", "f3"]), "SELECT id, unnest(['f1', 'f2', 'f3']) AS name, unnest([f1, f2, f3]) AS value FROM design", ("design",))
query("p05_concat_rows", "ticker:s ts:t close:d volume:d", lambda s, d: R.stacked([bars(s, d).where("ticker = 'LARGE'"), bars(s, d).where("ticker = 'SMALL'").drop("volume")]), "SELECT ticker, ts, close, CASE WHEN ticker = 'LARGE' THEN volume END AS volume FROM bars WHERE ticker IN ('LARGE', 'SMALL')", B)
for keep, o in (("first", ""), ("last", "DESC")):
    query(f"p07_deduplicate_{keep}", "ts:t tie:l x:d", lambda s, d, keep=keep: R.deduplicate(ticks(s, d).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz")), ["ts"], ["tie"], keep), f"WITH h AS (SELECT date_trunc('hour', ts) AS ts, tie, x FROM ticks)\nFINALLY SELECT ts, tie, x FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY tie {o}) AS n FROM h) WHERE n = 1", ("ticks",))
query("p07_deduplicate_none", "ts:t tie:l x:d", lambda s, d: R.deduplicate(ticks(s, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz")), ["ts"], ["tie"], "none"), "WITH h AS (SELECT date_trunc('minute', ts) AS ts, tie, x FROM ticks)\nFINALLY SELECT ts, tie, x FROM (SELECT *, count(*) OVER (PARTITION BY ts) AS n FROM h) WHERE n = 1", ("ticks",))
query("p08_first_entry", "ticker:s entity:l", lambda s, d: R.deduplicate(entities(s, d), ["ticker"], ["entity"]), "SELECT ticker, min(entity) AS entity FROM entities GROUP BY ticker", ("entities",))
query("p10_missing_profile", "name:s missing:l percent:d", lambda s, d: R.missing_profile(R.to_wide(bars(s, d), "LARGE", TYPES), ["close", "f1", "f2", "f3", "f4", "f5", "volume"]),
      "WITH w AS (SELECT ts, " + ", ".join(PIV.format(t=t, c="close") + f" AS {n}" for t, n in zip(["LARGE", "ECONOMY", "MEDIUM", "PROMO", "SMALL", "STANDARD"], ["close", "f1", "f2", "f3", "f4", "f5"])) + ", " + PIV.format(t="LARGE", c="volume") + " AS volume FROM bars GROUP BY ts), u AS (SELECT unnest(['close', 'f1', 'f2', 'f3', 'f4', 'f5', 'volume']) AS name, unnest([close, f1, f2, f3, f4, f5, volume]) AS value FROM w)\nFINALLY SELECT name, count(*) - count(value) AS missing, 100.0 * (count(*) - count(value)) / count(*) AS percent FROM u GROUP BY name HAVING count(*) > count(value)", B)
GRID = "g AS (SELECT t.ticker, d.ts, close, volume FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN (SELECT DISTINCT ts FROM bars) d LEFT JOIN bars USING (ticker, ts))"
query("p11_drop_sparse_groups", "ticker:s n:l", lambda s, d: R.grid(bars(s, d)).groupBy("ticker").agg(F.count("close").alias("n"), F.avg(F.col("close").isNull().cast("int")).alias("m")).where("m <= 0.5").drop("m"), f"WITH {GRID}\nFINALLY SELECT ticker, count(close) AS n FROM g GROUP BY ticker HAVING avg(CAST(close IS NULL AS INT)) <= 0.5", B)
query("p12_forward_fill", "ticker:s ts:t close:d", lambda s, d: R.filled(R.grid(bars(s, d)), "close"), f"WITH {GRID}\nFINALLY SELECT ticker, ts, last_value(close IGNORE NULLS) OVER ({BAR} ROWS UNBOUNDED PRECEDING) AS close FROM g", B)
query("p13_back_fill", "ticker:s ts:t close:d", lambda s, d: R.filled(R.grid(bars(s, d)), "close", head=True), f"WITH {GRID}\nFINALLY SELECT ticker, ts, coalesce(last_value(close IGNORE NULLS) OVER ({BAR} ROWS UNBOUNDED PRECEDING), first_value(close IGNORE NULLS) OVER ({BAR} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM g", B)
query("p14_drop_missing_rows", "ticker:s ts:t", lambda s, d: R.grid(bars(s, d)).na.drop(subset=["close"]), f"WITH {GRID}\nFINALLY SELECT ticker, ts FROM g WHERE close IS NOT NULL", B)
query("p15_complete_in_window", "ticker:s n:l", lambda s, d: R.grid(bars(s, d)).where("ts < timestamp_ntz'1995-06-01'").groupBy("ticker").agg(F.count("close").alias("n"), F.count(F.lit(1)).alias("a")).where("n >= a - 12").drop("a"), f"WITH {GRID}\nFINALLY SELECT ticker, count(close) AS n FROM g WHERE ts < TIMESTAMP '1995-06-01' GROUP BY ticker HAVING count(close) >= count(*) - 12", B)
NUM = f"n AS (SELECT *, row_number() OVER ({BAR}) AS bar, count(*) OVER (PARTITION BY ticker) AS n FROM bars)"
query("p16_trim_warm_up", "ticker:s ts:t close:d", lambda s, d: R.numbered(bars(s, d)).where("bar > 50"), f"WITH {NUM}\nFINALLY SELECT ticker, ts, close FROM n WHERE bar > 50", B)
query("p17_tail", "ticker:s ts:t close:d", lambda s, d: R.numbered(bars(s, d)).where("bar > n - 100"), f"WITH {NUM}\nFINALLY SELECT ticker, ts, close FROM n WHERE bar > n - 100", B)
query("p18_slice", "ticker:s ts:t close:d", lambda s, d: bars(s, d).where("ts BETWEEN timestamp_ntz'1996-01-01' AND timestamp_ntz'1996-06-30'"), "SELECT ticker, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'", B)
query("p19_mask", "ticker:s ts:t close:d", lambda s, d: bars(s, d).where("close > 3000 AND NOT volume < 50"), "SELECT ticker, ts, close FROM bars WHERE close > 3000 AND NOT volume < 50", B)
query("p20_split_by_fraction", "ticker:s part:s n:l", lambda s, d: R.chronological(bars(s, d)).groupBy("ticker", "part").agg(F.count(F.lit(1)).alias("n")), f"WITH {NUM}\nFINALLY SELECT ticker, CASE WHEN bar <= floor(n * {1 - 0.2 - 0.1!r}::DOUBLE) THEN 'train' WHEN bar <= floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS part, count(*) AS n FROM n GROUP BY 1, 2", B)
query("p21_split_by_date", "ticker:s part:s n:l", lambda s, d: R.last_year(bars(s, d)).groupBy("ticker", "part").agg(F.count(F.lit(1)).alias("n")), "SELECT ticker, CASE WHEN ts <= (SELECT max(ts) - INTERVAL 1 YEAR FROM bars) THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM bars GROUP BY 1, 2", B)
query("p22_drop_infinite", "series:l ts:t v:d", lambda s, d: ticks(s, d).select("series", "ts", F.expr("CASE WHEN tie % 7 = 0 THEN double('infinity') WHEN tie % 11 = 0 THEN double('NaN') ELSE x END").alias("q")).select("series", "ts", R.finite("q").alias("v")).na.drop(), "SELECT series, ts, x AS v FROM ticks WHERE tie % 7 <> 0 AND tie % 11 <> 0", ("ticks",))
query("p23_winsorise", "series:l ts:t tie:l x:d", lambda s, d: R.winsorise(ticks(s, d), "x"), "SELECT series, ts, tie, least(greatest(x, (SELECT quantile_cont(x, 0.01) FROM ticks)), (SELECT quantile_cont(x, 0.99) FROM ticks)) AS x FROM ticks", ("ticks",))
query("p24_within_sigmas", "series:l ts:t tie:l x:d", lambda s, d: R.within_sigmas(ticks(s, d), "x", 2), "SELECT series, ts, tie, x FROM ticks WHERE abs(x - (SELECT avg(x) FROM ticks)) <= 2 * (SELECT stddev_samp(x) FROM ticks)", ("ticks",))
for i, (how, a, b) in enumerate((("minmax", "min(x)", "max(x) - min(x)"), ("sample", "avg(x)", "stddev_samp(x)"), ("population", "avg(x)", "stddev_pop(x)"))):
    query(f"p{25 + i}_scale_{how}", "series:l ts:t tie:l scaled:d", lambda s, d, how=how: R.scaled(ticks(s, d), "x", how), f"SELECT series, ts, tie, (x - (SELECT {a} FROM ticks)) / (SELECT {b} FROM ticks) AS scaled FROM ticks", ("ticks",))
query("p28_one_hot", "entity:l " + " ".join(f"sector_{t}:l" for t in TYPES), lambda s, d: R.one_hot(entities(s, d), "sector", TYPES, "sector"), "SELECT entity, " + ", ".join(f"CASE WHEN sector = '{t}' THEN 1 ELSE 0 END AS sector_{t}" for t in TYPES) + " FROM entities", ("entities",))
query("p29_fill_constant", "ticker:s ts:t v:d", lambda s, d: R.grid(bars(s, d)).select("ticker", "ts", F.coalesce("close", F.lit(-1.0)).alias("v")), f"WITH {GRID}\nFINALLY SELECT ticker, ts, coalesce(close, -1) AS v FROM g", B)
query("p30_group_mean_imputation", "ticker:s ts:t v:d", lambda s, d: R.grid(bars(s, d)).select("ticker", "ts", F.coalesce("close", F.avg("close").over(Window.partitionBy("ticker"))).alias("v")), f"WITH {GRID}\nFINALLY SELECT ticker, ts, coalesce(close, avg(close) OVER (PARTITION BY ticker)) AS v FROM g", B)
query("p31_groups_with_history", "series:l n:l", lambda s, d: ticks(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series"))).where("n > 65").select("series", "n").distinct(), "SELECT series, count(*) AS n FROM ticks GROUP BY series HAVING count(*) > 65", ("ticks",))
PAIRS = [(a, b) for i, a in enumerate(range(1, 6)) for b in range(1, 6)[i + 1 :]]
query("p32_interactions", "id:l " + " ".join(f"f{a}_x_f{b}:d" for a, b in PAIRS), lambda s, d: design(s, d).select("id", *R.interactions([f"f{i}" for i in range(1, 6)])), "SELECT id, " + ", ".join(f"f{a} * f{b} AS f{a}_x_f{b}" for a, b in PAIRS) + " FROM design", ("design",))
query("p33_label_extraction", "name:s number:s tail:s", lambda s, d: table(s, d, "part").select(F.col("p_brand").alias("name"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"), F.regexp_replace("p_brand", "^[A-Za-z]+#?", "").alias("tail")).distinct(), "SELECT DISTINCT p_brand AS name, regexp_extract(p_brand, '([0-9]+)', 1) AS number, regexp_replace(p_brand, '^[A-Za-z]+#?', '') AS tail FROM part")
query("p34_explode_lists", "series:l v:d", lambda s, d: ticks(s, d).where("series <= 20").groupBy("series").agg(F.collect_list("x").alias("l")).select("series", F.explode("l").alias("v")), "SELECT series, x AS v FROM ticks WHERE series <= 20", ("ticks",))
query("p09_sorted_months", "name:s ts:t place:l v:d", lambda s, d: nation_months(s, d).withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("ts"))), "SELECT name, ts, row_number() OVER (PARTITION BY name ORDER BY ts) AS place, v FROM nation_months", ("nation_months",))

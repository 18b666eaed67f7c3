"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import stats as S
from tidemark.functions.scan import average_ranks
from tidemark.plans.registry import query
from tidemark.plans.views import bars, design, nation_months, table, ticks

B, T = ("bars",), ("ticks",)
query("a01_describe", "series:l n:l first:t last:t mean:d sd:d low:d high:d skew:d kurt:d positive:d missing:l", lambda s, d: ticks(s, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high"), S.corrected_skew("x").alias("skew"), S.corrected_kurtosis("x").alias("kurt"), F.avg((F.col("x") > 50).cast("int")).alias("positive"), F.count_if(F.col("x").isNull()).alias("missing")),
      "SELECT series, count(*) AS n, min(ts) AS first, max(ts) AS last, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS low, max(x) AS high, skewness(x) AS skew, kurtosis(x) AS kurt, avg(CAST(x > 50 AS INT)) AS positive, count(*) - count(x) AS missing FROM ticks GROUP BY series", T)
query("a02_distinct", "n:l first_ten:s", lambda s, d: table(s, d, "part").agg(F.count_distinct("p_brand").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 10), ",").alias("first_ten")), "SELECT count(DISTINCT p_brand) AS n, array_to_string(list_sort(list(DISTINCT p_brand))[1:10], ',') AS first_ten FROM part")
query("a03_group_size", "kind:s n:l", lambda s, d: ticks(s, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "SELECT kind, count(*) AS n FROM ticks GROUP BY kind", T)
query("a04_group_sum_sorted", "kind:s v:d place:l", lambda s, d: ticks(s, d).groupBy("kind").agg(F.sum("x").alias("v")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("v")))), "SELECT kind, sum(x) AS v, row_number() OVER (ORDER BY sum(x) DESC) AS place FROM ticks GROUP BY kind", T)
query("a05_day_of_month_running", "day:l v:d", lambda s, d: table(s, d, "orders").groupBy(F.dayofmonth("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("x")).select("day", F.sum("x").over(Window.orderBy("day")).alias("v")), "SELECT day, sum(x) OVER (ORDER BY day) AS v FROM (SELECT day(o_orderdate) AS day, sum(o_totalprice) AS x FROM orders GROUP BY 1)")


def _crosstab(s, d):
    c = table(s, d, "part").groupBy(F.col("p_type").alias("a"), F.col("p_brand").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    cells = c.select("a").distinct().join(F.broadcast(c.select("b").distinct()))
    return cells.join(c, ["a", "b"], "left").select("a", "b", (F.coalesce("n", F.lit(0)) / F.sum("n").over(Window.partitionBy())).alias("v"))


query("a06_contingency", "a:s b:s v:d", _crosstab, "SELECT a, b, coalesce(n, 0) / (SELECT count(*) FROM part) AS v FROM (SELECT DISTINCT p_type AS a FROM part) CROSS JOIN (SELECT DISTINCT p_brand AS b FROM part) LEFT JOIN (SELECT p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY 1, 2) USING (a, b)")


def summary(df, c: str = "x"):
    moments = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"))
    quarters = S.exact_quantiles(df, c, [0.25, 0.5, 0.75])
    return moments.select("*", *[F.lit(v).cast("double").alias(f"q{k + 1}") for k, v in enumerate(quarters)])


query("a07_summary", "n:l mean:d sd:d low:d q1:d q2:d q3:d high:d", lambda s, d: summary(ticks(s, d)),
      "SELECT count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS low, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3, max(x) AS high FROM ticks", T)
FS = [f"f{i}" for i in range(1, 7)]
PAIRS = [(a, b) for i, a in enumerate(FS) for b in FS[i + 1 :]]
query("a08_correlation_matrix", "a:s b:s v:d", lambda s, d: design(s, d).agg(*[S.pearson(a, b).alias(f"{a}_{b}") for a, b in PAIRS]).select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("v")) for a, b in PAIRS])).alias("p")).select("p.*"), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM design" for a, b in PAIRS), ("design",))


def rank_correlations(s, d):
    """Spearman of each pair of columns: all columns are ranked in one pass in long form, and brought together by row."""
    names = sorted({c for p in PAIRS for c in p})
    long = design(s, d).unpivot(["id"], names, "name", "x")
    ranked = average_ranks(long.where("x IS NOT NULL AND NOT isnan(x)"), "x", ["name"], "r").groupBy("id").agg(*[F.max(F.when(F.col("name") == c, F.col("r"))).alias(c) for c in names])
    one = ranked.agg(*[S.pearson(a, b).alias(f"{a}_{b}") for a, b in PAIRS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("v")) for a, b in PAIRS])).alias("p")).select("p.*")


RANKED = "k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in sorted({c for p in PAIRS for c in p})) + " FROM design)"
query("a08_rank_correlation_matrix", "a:s b:s v:d", rank_correlations, f"WITH {RANKED}\nFINALLY " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS v FROM k" for a, b in PAIRS), ("design",))
query("a09_row_mean", "id:l total:d mean:d", lambda s, d: design(s, d).select("id", sum((F.col(f) for f in FS[1:]), F.col("f1")).alias("total"), (sum((F.col(f) for f in FS[1:]), F.col("f1")) / 6).alias("mean")), "SELECT id, f1 + f2 + f3 + f4 + f5 + f6 AS total, (f1 + f2 + f3 + f4 + f5 + f6) / 6 AS mean FROM design", ("design",))
query("a10_quantile", "kind:s q10:d q90:d", lambda s, d: S.quantiles(ticks(s, d), "x", [0.1, 0.9], ["kind"]).select("kind", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q90")), "SELECT kind, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.9) AS q90 FROM ticks GROUP BY kind", T)
query("a11_median", "kind:s v:d", lambda s, d: S.quantiles(ticks(s, d), "x", [0.5], ["kind"]).select("kind", F.col("q")[0].alias("v")), "SELECT kind, median(x) AS v FROM ticks GROUP BY kind", T)
query("a12_resample", "ticker:s month:t last:d mean:d", lambda s, d: bars(s, d).groupBy("ticker", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.max_by("close", "ts").alias("last"), F.avg("close").alias("mean")), "SELECT ticker, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(close, ts) AS last, avg(close) AS mean FROM bars GROUP BY 1, 2", B)
query("a13_count_of_counts", "n:l names:l", lambda s, d: table(s, d, "nation").alias("a").join(F.broadcast(table(s, d, "nation").alias("b")), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_name") < F.col("b.n_name"))).select(F.explode(F.array("a.n_name", "b.n_name")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("names")), "SELECT n, count(*) AS names FROM (SELECT name, count(*) AS n FROM (SELECT unnest([a.n_name, b.n_name]) AS name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name) GROUP BY name) GROUP BY n")


def yearly_returns(df, key="ticker", c="close"):
    """Last over first of each calendar year, less one; the final year is left out. A year of one row starts from the last value of the year before."""
    y = df.groupBy(key, F.year("ts").alias("year")).agg(F.min_by(c, "ts").alias("a"), F.max_by(c, "ts").alias("b"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("year")
    y = y.select(key, "year", "b", F.when(F.col("n") == 1, F.coalesce(F.lag("b").over(w), "a")).otherwise(F.col("a")).alias("a"), F.max("year").over(Window.partitionBy(key)).alias("top"))
    return y.where("year < top").select(key, "year", (F.col("b") / F.col("a") - 1).alias("v"))


YEARS = "WITH y AS (SELECT ticker, year(ts) AS year, arg_min(close, ts) AS a, arg_max(close, ts) AS b, count(*) AS n FROM bars GROUP BY 1, 2), z AS (SELECT ticker, year, b, CASE WHEN n = 1 THEN coalesce(lag(b) OVER (PARTITION BY ticker ORDER BY year), a) ELSE a END AS a, max(year) OVER (PARTITION BY ticker) AS top FROM y), r AS (SELECT ticker, year, b / a - 1 AS v FROM z WHERE year < top)\nFINALLY "
query("a14_yearly_return", "ticker:s year:l v:d", lambda s, d: yearly_returns(bars(s, d)), YEARS + "SELECT * FROM r", B)


def _summaries(s, d):
    r = yearly_returns(bars(s, d)).select("ticker", F.col("year").cast("string").alias("year"), "v")
    return r.unionByName(r.groupBy("ticker").agg(F.lit("mean").alias("year"), F.avg("v").alias("v"))).unionByName(r.groupBy("ticker").agg(F.lit("median").alias("year"), F.median("v").alias("v")))


query("a15_summary_rows", "ticker:s year:s v:d", _summaries, YEARS + "SELECT ticker, CAST(year AS VARCHAR) AS year, v FROM r UNION ALL SELECT ticker, 'mean', avg(v) FROM r GROUP BY ticker UNION ALL SELECT ticker, 'median', median(v) FROM r GROUP BY ticker", B)
query("a16_percent_share", "kind:s v:d", lambda s, d: ticks(s, d).groupBy("kind").agg(F.sum("x").alias("x")).select("kind", (100 * F.col("x") / F.sum("x").over(Window.partitionBy())).alias("v")), "SELECT kind, 100 * sum(x) / (SELECT sum(x) FROM ticks) AS v FROM ticks GROUP BY kind", T)
query("g18_monthly_table", "name:s year:l month:l v:d", lambda s, d: nation_months(s, d).select("name", F.year("ts").alias("year"), F.month("ts").alias("month"), "v"), "SELECT name, year(ts) AS year, month(ts) AS month, v FROM nation_months", ("nation_months",))

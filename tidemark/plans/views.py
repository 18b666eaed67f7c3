"""Derived tables that the queries run on, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, sf_dir):
    """Irregular series: series, ts, tie, x, kind."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), "ts", F.col("event_id").alias("tie"), F.col("value").alias("x"), F.col("event_type").alias("kind"))


def bars(spark, sf_dir):
    """Daily bars with gaps: ticker, ts, close, volume."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("ticker"), F.col("l_shipdate").alias("ts")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")) + F.lit(0.0012345), 2).alias("close"), F.sum("l_quantity").alias("volume"))


def design(spark, sf_dir, k=6):
    """A model matrix: id, f1..fk, y."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"f{i + 1}") for i in range(k)], F.col("label").cast("double").alias("y"))


def entities(spark, sf_dir):
    """Metadata: ticker, sector, cap, year."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity"), F.col("p_brand").alias("ticker"), F.col("p_type").alias("sector"), F.col("p_retailprice").alias("cap"), F.col("p_size").alias("year"))


def nation_months(spark, sf_dir):
    """Monthly totals by nation: name, ts, v."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("name", "ts").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))


SQL = {
    "ticks": "ticks AS (SELECT user_id AS series, ts, event_id AS tie, value AS x, event_type AS kind FROM events)",
    "bars": "bars AS (SELECT p_type AS ticker, l_shipdate AS ts, round(avg(l_extendedprice / l_quantity) + 0.0012345::DOUBLE, 2) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
    "design": "design AS (SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS f{i}" for i in range(1, 7)) + ", CAST(label AS DOUBLE) AS y FROM embeddings)",
    "entities": "entities AS (SELECT p_partkey AS entity, p_brand AS ticker, p_type AS sector, p_retailprice AS cap, p_size AS year FROM part)",
    "nation_months": "nation_months AS (SELECT n_name AS name, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, round(sum(o_totalprice), 2) AS v FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)",
}

SQL["ledger"] = """num AS (SELECT ticker AS run, ts, close, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS n, count(*) OVER (PARTITION BY ticker) AS m FROM bars),
held AS (SELECT run, ts, close, CASE WHEN n = 1 OR n = m THEN 0 ELSE 10 * ((n // 7) % 3) END AS pos FROM num),
flows AS (SELECT run, ts, close, pos, (pos - coalesce(lag(pos) OVER (PARTITION BY run ORDER BY ts), 0)) * close AS paid FROM held),
ledger AS (SELECT run, ts, pos, close, pos * close AS exposure, round(1000000 - sum(paid) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS cash, abs(paid) AS turnover, round(1000000 - sum(paid) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) + pos * close, 2) AS nav FROM flows)"""


def ledger(spark, sf_dir):
    """A ledger for each ticker: holdings of 0, 10 or 20 shares that change every seven bars, flat at both ends."""
    from pyspark.sql import Window

    w = Window.partitionBy("run").orderBy("ts")
    d = bars(spark, sf_dir).withColumnRenamed("ticker", "run").select("run", "ts", "close", F.row_number().over(w).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("run")).alias("m"))
    d = d.withColumn("pos", F.when((F.col("n") == 1) | (F.col("n") == F.col("m")), 0).otherwise(10 * (F.floor(F.col("n") / 7) % 3)).cast("long"))
    d = d.withColumn("paid", (F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0))) * F.col("close"))
    cash = 1000000 - F.sum("paid").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.select("run", "ts", "pos", "close", (F.col("pos") * F.col("close")).alias("exposure"), F.round(cash, 2).alias("cash"), F.abs("paid").alias("turnover"), F.round(cash + F.col("pos") * F.col("close"), 2).alias("nav"))


#: Spearman over moving windows, from head with rows(key, ts, n, a, b): a table rho(key, ts, v).
SPEARMAN = """{head}, pairs AS (SELECT x.key, x.ts, x.n, y.a, y.b FROM rows x JOIN rows y ON x.key = y.key AND y.n BETWEEN x.n - {last} AND x.n),
ranks AS (SELECT key, ts, a, b, rank() OVER (PARTITION BY key, n ORDER BY a) + (count(*) OVER (PARTITION BY key, n, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY key, n ORDER BY b) + (count(*) OVER (PARTITION BY key, n, b) - 1) / 2.0 AS rb FROM pairs),
rho AS (SELECT key, ts, CASE WHEN count(a) = {window} AND count(b) = {window} THEN CASE WHEN stddev_pop(ra) * stddev_pop(rb) > 1e-14 THEN corr(ra, rb) ELSE {flat} END END AS v FROM ranks GROUP BY 1, 2)"""

"""Sources: bars, ledgers and artifacts as files; no reader infers a schema by reading twice."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BARS = "Timestamp timestamp_ntz, Ticker string, Close double, Volume double"
LEDGER = "Timestamp string, Gross_Exposure double, Cash_Balance double, Interval_Turnover double, Gross_NAV double"


def read_bars(spark: SparkSession, path: str, schema: str = BARS) -> DataFrame:
    """ts, ticker, close, volume, and line: where a row stood in its file, for first and last of repeated rows."""
    d = spark.read.schema(schema).option("header", True).csv(path)
    return d.select(F.col("Timestamp").alias("ts"), F.col("Ticker").alias("ticker"), F.when(~F.isnan("Close"), F.col("Close")).alias("close"), F.when(~F.isnan("Volume"), F.col("Volume")).alias("volume"), F.monotonically_increasing_id().alias("line"))


def read_ledgers(spark: SparkSession, path: str) -> DataFrame:
    """run, ts, exposure, cash, turnover, nav, broken: a line that does not parse is kept and marked, not dropped."""
    d = spark.read.schema(LEDGER + ", _corrupt string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    name = F.regexp_extract("_metadata.file_name", r"^(.*)\.csv$", 1)
    return d.select(name.alias("run"), F.try_to_timestamp("Timestamp").cast("timestamp_ntz").alias("ts"), F.col("Gross_Exposure").alias("exposure"), F.col("Cash_Balance").alias("cash"), F.col("Interval_Turnover").alias("turnover"), F.col("Gross_NAV").alias("nav"), F.col("_corrupt").isNotNull().alias("broken"))


def team_ledgers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The long-only and the long-short ledgers of a folder, by team: names end in _longonly_results or _longshort_results."""
    out = []
    for kind in ("longonly", "longshort"):
        d = read_ledgers(spark, f"{folder}/*_{kind}_results.csv")
        out.append(d.withColumn("run", F.regexp_replace("run", f"_{kind}_results$", "")))
    return tuple(out)


def read_skipping(spark: SparkSession, path: str, schema: str, head: int, tail: int = 0) -> DataFrame:
    """Text tables with lines to skip at the head and the tail of each file, in whatever splits they are read.

    Lines are counted by split first, one row a split. Only in the few splits that hold a line to skip are lines
    numbered; those of all others go straight to the parser.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")]
    lines = spark.read.text(path).select(F.col("value").alias("line"), *place, F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("_file").orderBy("_at")
    splits = splits.select("_file", "_at", "n", (F.sum("n").over(order) - F.col("n")).alias("before"), (F.sum("n").over(Window.partitionBy("_file")) - F.sum("n").over(order)).alias("after"))
    first, last = F.least(F.greatest(F.lit(head) - F.col("before"), F.lit(0)), F.col("n")), F.least(F.greatest(F.lit(tail) - F.col("after"), F.lit(0)), F.col("n"))
    cut = splits.select("_file", "_at", "n", first.alias("first"), last.alias("last")).where("first > 0 OR last > 0")
    touched = lines.join(cut, ["_file", "_at"])  # at most head + tail splits a file
    number = F.row_number().over(Window.partitionBy("_file", "_at").orderBy("_id"))
    inside = touched.withColumn("_k", number).where((F.col("_k") > F.col("first")) & (F.col("_k") <= F.col("n") - F.col("last")))
    whole = lines.join(cut, ["_file", "_at"], "left_anti")
    return whole.select("line").unionByName(inside.select("line")).select(F.from_csv("line", schema).alias("r")).select("r.*")


def read_json_artifact(spark: SparkSession, path: str) -> dict:
    """A small JSON object, read by Spark so that any store will do."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True) if row else {}


class Store:
    """Named tables under one folder: put, get, and compute only what is missing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _path(self, key: str) -> str:
        return f"{self.root}/{key.strip('/')}"

    def exists(self, key: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(key) + "/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def put(self, key: str, df: DataFrame, partition_by: list[str] = ()) -> None:
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self._path(key))

    def get(self, key: str) -> DataFrame:
        return self.spark.read.parquet(self._path(key))

    def compute(self, key: str, make) -> DataFrame:
        if not self.exists(key):
            self.put(key, make())
        return self.get(key)


#: Vendor readers by name. None ships: a reader is a function (spark, **options) -> DataFrame that a user registers.
VENDORS: dict = {}


def register_vendor(name: str, reader) -> None:
    VENDORS[name] = reader


def read_vendor(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in VENDORS:
        raise LookupError(f"no vendor reader named {name!r}; register one, or read its files with read_bars")
    return VENDORS[name](spark, **options)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the place that driver and executors share; only a local session may do without spark.checkpoint.dir."""
    key = "spark.checkpoint.dir"
    root = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{key} must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/tidemark"
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"

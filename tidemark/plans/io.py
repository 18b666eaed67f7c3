"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.operators import models
from tidemark.plans.views import bars, design, ledger, nation_months, table
from tidemark.sources import readers, synthetic, writers
from tidemark.streaming import bars as stream

B, L = ("bars",), ("bars", "ledger")


def through_csv(s, d):
    path = readers.scratch(s, "bars")
    writers.write_csv(bars(s, d).select(F.col("ts").alias("Timestamp"), F.col("ticker").alias("Ticker"), F.col("close").alias("Close"), F.col("volume").cast("double").alias("Volume")), path, ["Timestamp", "Ticker"], single=False)
    return readers.read_bars(s, path)


query("s01_csv_bars", "ticker:s ts:t close:d volume:d", through_csv, "SELECT ticker, ts, close, volume FROM bars", B)


def through_ledger_csv(s, d):
    path = readers.scratch(s, "ledger")
    ledger(s, d).where("run = 'LARGE'").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("exposure").alias("Gross_Exposure"), F.col("cash").alias("Cash_Balance"), F.col("turnover").alias("Interval_Turnover"), F.col("nav").alias("Gross_NAV")).write.option("header", True).csv(path)
    return readers.read_ledgers(s, path)


query("s02_csv_ledger", "ts:t exposure:d cash:d turnover:d nav:d broken:b", through_ledger_csv, "SELECT ts, exposure, cash, turnover, nav, false AS broken FROM ledger WHERE run = 'LARGE'", L)


def through_team_folder(s, d):
    """A folder with two teams' pairs of ledgers, one of which lacks its long-short file."""
    path, rows = readers.scratch(s, "teams"), ledger(s, d).select("run", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("exposure").alias("Gross_Exposure"), F.col("cash").alias("Cash_Balance"), F.col("turnover").alias("Interval_Turnover"), F.col("nav").alias("Gross_NAV"))
    for run, team, kind in (("LARGE", "north", "longonly"), ("SMALL", "north", "longshort"), ("MEDIUM", "south", "longonly")):
        writers.write_named_csv(rows.where(F.col("run") == run).drop("run"), path, f"{team}_{kind}_results.csv", ["Timestamp"])
    long_only, long_short = readers.team_ledgers(s, path)
    last = lambda x, kind: x.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max_by("nav", "ts").alias("nav")).select(F.col("run").alias("team"), F.lit(kind).alias("kind"), "n", "nav")
    return last(long_only, "longonly").unionByName(last(long_short, "longshort"))


query("s03_team_folder", "team:s kind:s n:l nav:d", through_team_folder, "SELECT CASE run WHEN 'MEDIUM' THEN 'south' ELSE 'north' END AS team, CASE run WHEN 'SMALL' THEN 'longshort' ELSE 'longonly' END AS kind, count(*) AS n, arg_max(nav, ts) AS nav FROM ledger WHERE run IN ('LARGE', 'SMALL', 'MEDIUM') GROUP BY run", L)


def through_skipping(s, d):
    """A text table with three lines of heading and a total at its end."""
    path = readers.scratch(s, "nations")
    rows = [f"{r.n_nationkey},{r.n_name}" for r in table(s, d, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    writers.write_text(s, "\n".join(["A report", "", "key,name", *rows, "total,"]), path)
    return readers.read_skipping(s, path, "key int, name string", 3, 1)


query("s05_skipping_csv", "key:l name:s", through_skipping, "SELECT n_nationkey AS key, n_name AS name FROM nation")


def through_vendor(s, d):
    readers.register_vendor("orders of a nation", lambda spark, nation: nation_months(spark, d).where(F.col("name") == nation))
    return readers.read_vendor(s, "orders of a nation", nation="NATION_3")


query("s06_vendor_reader", "name:s ts:t v:d", through_vendor, "SELECT * FROM nation_months WHERE name = 'NATION_3'", ("nation_months",))


def through_model_file(s, d):
    """A fitted model written, read back, and used."""
    path, design_ = readers.scratch(s, "model"), design(s, d)
    models.save_model(models.Linear(["f1", "f2"], 0.5, [2.0, -3.0]), s, path)
    return design_.select("id", models.load_model(s, path).predict().alias("p"))


query("s07_model_file", "id:l p:d", through_model_file, "SELECT id, 0.5 + 2 * f1 - 3 * f2 AS p FROM design", ("design",))


def through_csv_sink(s, d):
    path = readers.scratch(s, "sink")
    writers.write_csv(nation_months(s, d).select("name", F.col("ts").cast("string").alias("ts"), "v"), path, ["name", "ts"])
    return s.read.schema("name string, ts timestamp_ntz, v double").option("header", True).csv(path)


query("s09_csv_sink", "name:s ts:t v:d", through_csv_sink, "SELECT * FROM nation_months", ("nation_months",))


def through_text_report(s, d):
    path = readers.scratch(s, "report")
    n = table(s, d, "nation").count()
    writers.write_text(s, f"Report\nnations: {n}\nend", path)
    return s.read.text(path).select(F.col("value").alias("line"))


query("s10_text_report", "line:s", through_text_report, "SELECT unnest(['Report', 'nations: ' || (SELECT count(*) FROM nation), 'end']) AS line")


def through_cache(s, d):
    """The second call finds the table and does not compute the other one."""
    store = readers.Store(s, readers.scratch(s, "cache"))
    store.compute("months", lambda: nation_months(s, d))
    return store.compute("months", lambda: nation_months(s, d).where("false"))


query("s11_compute_or_load", "name:s ts:t v:d", through_cache, "SELECT * FROM nation_months", ("nation_months",))


def through_store(s, d):
    store = readers.Store(s, readers.scratch(s, "store"))
    return store.compute("prices/daily", lambda: bars(s, d))


query("s04_store", "ticker:s ts:t close:d", through_store, "SELECT ticker, ts, close FROM bars", B)


def through_json(s, d):
    """The sign of the slope of closes on volumes and the number of bars, stored and read again."""
    path = readers.scratch(s, "sign")
    found = bars(s, d).agg(F.signum(F.regr_slope("close", "volume")).cast("long").alias("signal_sign"), F.count(F.lit(1)).alias("bars")).first()
    writers.write_json_artifact(s, found.asDict(), path)
    back = readers.read_json_artifact(s, path)
    return s.createDataFrame([(int(back["signal_sign"]), int(back["bars"]))], "signal_sign long, bars long")


query("s08_json_artifact", "signal_sign:l bars:l", through_json, "SELECT sign(regr_slope(close, volume)) AS signal_sign, count(*) AS bars FROM bars", B)
query("s12_square_wave", "t:l x:d", lambda s, d: synthetic.square_wave(s, table(s, d, "events").count(), 20, 2.0), "SELECT range AS t, CASE WHEN range % 20 < 10 THEN 2.0 ELSE -2.0 END AS x FROM range((SELECT count(*) FROM events))")
query("s12_normal_walk", "series:l t:l x:d", lambda s, d: synthetic.normal_walk(s, table(s, d, "orders").count(), table(s, d, "region").count(), seed=4))  # as long as the orders
query("c12_scalar_functions", "entity:l v1:d v2:d v3:d v4:d s1:s s2:s s3:s", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("entity"), F.ln("p_retailprice").alias("v1"), F.sqrt("p_size").alias("v2"), (1 / (1 + F.exp(-F.col("p_size") / 10))).alias("v3"), F.signum(F.col("p_size") - 25).alias("v4"), F.upper("p_name").alias("s1"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("s2"), F.split("p_name", " ")[0].alias("s3")),
      "SELECT p_partkey AS entity, ln(p_retailprice) AS v1, sqrt(p_size) AS v2, 1 / (1 + exp(-p_size / 10)) AS v3, sign(p_size - 25) AS v4, upper(p_name) AS s1, replace(p_brand, '#', '-') AS s2, string_split(p_name, ' ')[1] AS s3 FROM part")


def dates(s, d):
    day = F.col("o_orderdate").cast("date")
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("entity"), F.year(day).alias("y"), F.quarter(day).alias("q"), F.month(day).alias("m"), F.dayofmonth(day).alias("dom"), F.dayofweek(day).alias("dow"), F.date_add(day, 7).cast("timestamp_ntz").alias("later"),
        F.last_day(day).cast("timestamp_ntz").alias("last"), F.date_diff(F.lit("1999-01-01").cast("date"), day).alias("days"), F.date_format(day, "yyyy-MM").alias("label"), F.to_date(F.date_format(day, "dd/MM/yyyy"), "dd/MM/yyyy").cast("timestamp_ntz").alias("parsed"),
    )


query(
    "c12_date_functions", "entity:l y:l q:l m:l dom:l dow:l later:t last:t days:l label:s parsed:t", dates,
    """WITH o AS (SELECT o_orderkey AS entity, CAST(o_orderdate AS DATE) AS day FROM orders)
FINALLY SELECT entity, year(day) AS y, quarter(day) AS q, month(day) AS m, day(day) AS dom, dayofweek(day) + 1 AS dow, day + 7 AS later, last_day(day) AS last, date_diff('day', day, DATE '1999-01-01') AS days, strftime(day, '%Y-%m') AS label, day AS parsed FROM o""",
)


def patterns(s, d):
    c, brand, name = F.col, "p_brand", "p_name"
    json = F.to_json(F.struct(c("p_size").alias("size"), F.array(brand, name).alias("names")))
    return table(s, d, "part").select(
        c("p_partkey").alias("entity"), F.regexp_extract(brand, r"(\d+)", 1).alias("digits"), F.regexp_replace(name, "[aeiou]", "_").alias("masked"), F.rlike(name, F.lit("^[a-m]")).alias("early"), F.regexp_count(name, F.lit("[aeiou]")).alias("vowels"),
        F.substring_index(name, " ", -1).alias("tail"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("/", brand, name).alias("joined"), F.get_json_object(json, "$.size").cast("long").alias("size"), F.get_json_object(json, "$.names[1]").alias("second"),
        F.coalesce(F.nullif(c("p_size"), F.lit(7)), F.lit(-1)).alias("or_else"), F.greatest(c("p_size"), F.lit(20)).alias("at_least"), F.initcap(F.lower(brand)).alias("titled"),
    )


query(
    "c12_text_functions", "entity:l digits:s masked:s early:b vowels:l tail:s padded:s joined:s size:l second:s or_else:l at_least:l titled:s", patterns,
    r"""SELECT p_partkey AS entity, regexp_extract(p_brand, '(\d+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, regexp_matches(p_name, '^[a-m]') AS early, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels,
string_split(p_name, ' ')[-1] AS tail, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat_ws('/', p_brand, p_name) AS joined, p_size AS size, p_name AS second, coalesce(nullif(p_size, 7), -1) AS or_else, greatest(p_size, 20) AS at_least,
upper(p_brand[1]) || lower(p_brand[2:]) AS titled FROM part""",
)


def on_stream(s, d):
    events = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/event[s].parquet")
    return events.select(F.col("user_id").alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("value").alias("x"))


def drained(s, out, name):
    """What a stream has put out when its input is read to the end."""
    path = readers.scratch(s, name)
    q = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(out.schema).parquet(path)


def streamed_bars(s, d):
    """Hourly bars that the watermark has closed; their state is dropped."""
    return drained(s, stream.bars_from_ticks(on_stream(s, d), "1 hour", "10 minutes"), "stream")


CLOSED = """bar AS (SELECT series, date_trunc('hour', ts) AS ts, arg_min(x, (ts, tie)) AS open, max(x) AS high, min(x) AS low, arg_max(x, (ts, tie)) AS close, sum(x) AS volume, count(*) AS n FROM ticks GROUP BY series, date_trunc('hour', ticks.ts))"""
query(
    "t01_streamed_bars", "series:l ts:t open:d high:d low:d close:d volume:d n:l", streamed_bars,
    f"WITH {CLOSED}\nFINALLY SELECT * FROM bar WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE", ("ticks",),
)


def streamed_features(s, d):
    return drained(s, stream.running_features(on_stream(s, d).select("series", "ts", "tie", F.col("x").alias("close"))), "features")


FRESH = """g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 DAY THEN 1 ELSE 0 END AS fresh FROM ticks WINDOW w AS (PARTITION BY series ORDER BY ts, tie)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS run FROM g)"""
query("t02_streamed_features", "series:l ts:t close:d mean:d momentum:d", streamed_features,
      f"WITH {FRESH}\nFINALLY SELECT series, ts, x AS close, avg(x) OVER (w ROWS 5 PRECEDING) AS mean, x - lag(x, 5) OVER w AS momentum FROM run WINDOW w AS (PARTITION BY series, run ORDER BY ts, tie)", ("ticks",))


def streamed_trades(s, d):
    """A run for each series, whose price is ten above the tick's size; long above 60, flat below 30."""
    signals = on_stream(s, d).select(F.col("series").cast("string").alias("run"), "ts", (10 + F.abs("x")).alias("price"), F.col("x").alias("signal"))
    return drained(s, stream.trade(signals, 60.0, 30.0), "trades")


TRADED = """tick AS (SELECT CAST(series AS VARCHAR) AS run, ts, 10 + abs(x) AS p, x AS s, row_number() OVER (PARTITION BY series ORDER BY ts) AS n FROM ticks),
led AS (SELECT run, n, ts, p, CASE WHEN s >= 60 THEN 50000::DOUBLE ELSE 1000000::DOUBLE END AS cash, CASE WHEN s >= 60 THEN 950000 / p ELSE 0::DOUBLE END AS shares FROM tick WHERE n = 1
UNION ALL SELECT t.run, t.n, t.ts, t.p, CASE WHEN shares = 0 AND s >= 60 THEN cash - 0.95::DOUBLE * cash WHEN shares > 0 AND s < 30 THEN cash + shares * t.p ELSE cash END,
  CASE WHEN shares = 0 AND s >= 60 THEN 0.95::DOUBLE * cash / t.p WHEN shares > 0 AND s < 30 THEN 0 ELSE shares END FROM led JOIN tick t ON t.run = led.run AND t.n = led.n + 1)"""
query("t03_streamed_trades", "run:s ts:t cash:d shares:d nav:d", streamed_trades, f"WITH RECURSIVE {TRADED}\nFINALLY SELECT run, ts, cash, shares, cash + shares * p AS nav FROM led", ("ticks",))


def streamed_breaches(s, d):
    """The trades again, some with their cash taken away, as the check of single rows sees them."""
    taken = F.when(F.minute("ts") == 7, F.lit(-1.0)).otherwise(F.col("cash"))
    return stream.breaches(streamed_trades(s, d).withColumn("cash", taken))


query("t04_streamed_breaches", "run:s ts:t cash:d", streamed_breaches, f"WITH RECURSIVE {TRADED}\nFINALLY SELECT run, ts, -1 AS cash FROM led WHERE minute(ts) = 7", ("ticks",))

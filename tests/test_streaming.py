"""Streams over many batches, and readers over many splits."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import readers
from tidemark.streaming import bars as stream


def test_running_features_over_batches(spark, tmp_path):
    """Ties of a batch in order, one list a key over batches, and a key that was silent for too long starts anew."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(hours=h // 2), h, float(h * h % 17)) for h in range(40)]  # two at each time
    rows += [(2, t0 + dt.timedelta(hours=h), 100 + h, float(h)) for h in range(3)] + [(2, t0 + dt.timedelta(hours=90 + h), 200 + h, 5.0) for h in range(3)]
    rows += [(3, t0 + dt.timedelta(hours=60), 300, 1.0)]
    rows.sort(key=lambda r: r[1:3])
    for i in range(0, len(rows), 7):
        spark.createDataFrame(rows[i : i + 7][::-1], "series long, ts timestamp, tie long, close double").coalesce(1).write.parquet(f"{tmp_path}/in/part={i:03d}")
    source = spark.readStream.schema("series long, ts timestamp, tie long, close double, part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    out = stream.running_features(source, window=4, late="300 hours", idle=48 * 3_600_000)
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.series, r.tie): (r.mean, r.momentum) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == len(rows)
    for key in (1, 2, 3):
        last, before = [], None
        for _, ts, tie, close in sorted(r for r in rows if r[0] == key):
            last = [] if before and ts - before > dt.timedelta(hours=48) else last
            last, before = [*last, close][-4:], ts
            mean, momentum = got[key, tie]
            assert abs(mean - sum(last) / len(last)) < 1e-9 and momentum == (close - last[0] if len(last) == 4 else None)


def test_read_skipping_over_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 7), ("c", 3)):
        (tmp_path / f"{name}.txt").write_text("".join(["head line\n", "key,name\n", *(f"{i},{name}{i}\n" for i in range(n)), "the end\n"]))
    (tmp_path / "d.txt").write_text("")
    (tmp_path / "e.txt").write_text("only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("64", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted((r.name[0], r.key) for r in readers.read_skipping(spark, f"{tmp_path}/*.txt", "key int, name string", 2, 1).collect())
        assert got == sorted([("a", i) for i in range(400)] + [("b", i) for i in range(7)] + [("c", i) for i in range(3)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert readers.read_skipping(spark, f"{tmp_path}/d.txt", "key int", 1).count() == 0

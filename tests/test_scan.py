"""Scans over range-partitioned layouts: one group is many partitions, and batches are small."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scan as C


@pytest.fixture(params=[3, 10_000])
def batches(spark, request):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield request.param
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def frame(seed, n, kinds, values):
    r = np.random.default_rng(seed)
    k = np.where(r.random(n) < 0.6, "hot", r.choice(kinds, n))
    v = np.where(r.random(n) < 0.4, 3.0, r.integers(0, values, n))
    return pd.DataFrame({"k": k, "v": v, "t": r.permutation(n), "w": r.standard_normal(n)})


@pytest.mark.parametrize("seed,kinds,values,big", [(1, ["a"], 5, 4), (2, ["a", "b", "hot", "z"], 40, 4096), (3, [f"k{i}" for i in range(60)], 9, 20), (4, ["b"], 1, 8)])
def test_average_ranks(spark, batches, monkeypatch, seed, kinds, values, big):
    """A key with most rows, a value with many of them; groups of equal values over batches and partitions."""
    monkeypatch.setattr(C, "BIG", big)
    d = frame(seed, 300, kinds, values)
    got = C.average_ranks(spark.createDataFrame(d), "v", ["k"], "r").toPandas()
    assert list(got.columns) == ["k", "v", "t", "w", "r"] and len(got) == 300
    assert np.allclose(got["r"], got.groupby("k")["v"].rank())
    whole = C.average_ranks(spark.createDataFrame(d), "v", [], "r").toPandas()
    assert np.allclose(whole["r"], whole["v"].rank())


def test_numbers_and_empty(spark, batches):
    d = frame(5, 200, ["a", "b", "c"], 4)
    got = C.numbered(spark.createDataFrame(d), ["k"], ["t"]).toPandas().sort_values(["k", "t"])
    assert (got["_n"] == got.groupby("k").cumcount()).all() and len(got) == 200
    none = spark.createDataFrame(d).where("false")
    assert C.numbered(none, ["k"], ["t"]).count() == 0 == C.average_ranks(none, "v", ["k"], "r").count()
    nulls = spark.createDataFrame([(None, 2.0), (None, 1.0), ("a", 1.0), (None, 2.0)], "k string, v double")
    assert sorted((r.k is None, r.v, r.r) for r in C.average_ranks(nulls, "v", ["k"], "r").collect()) == [(False, 1.0, 1.0), (True, 1.0, 1.0), (True, 2.0, 2.5), (True, 2.0, 2.5)]


def test_one_series_is_many_tasks(spark):
    """A series of 10**6 rows: laid out over many partitions, none of which holds much more than its share."""
    laid = C.laid_out(spark.range(1_000_000).select(F.lit("s").alias("k"), F.col("id").alias("t")), ["k"], ["t"], 20)
    sizes = [r["count"] for r in laid.groupBy(C.PART).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 120_000
    got = C.scan(laid, ["k"], C.Number(), "n long").agg(F.count_if(F.col("n") != F.col("t")).alias("wrong"), F.count("n").alias("rows")).first()
    assert tuple(got) == (0, 1_000_000)

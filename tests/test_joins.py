"""Joins over time and pairs, against plain versions."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidemark.functions import scan as C
from tidemark.operators import joins as J


@pytest.mark.parametrize("batch", [3, 10_000])
def test_asof_with_a_hot_key(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    rng = random.Random(batch)
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None, f"k{rng.randrange(30)}"])
    t0 = dt.datetime(2024, 1, 1)
    left = [(key(), t0 + dt.timedelta(hours=rng.randrange(300)), i) for i in range(300)]
    right = [(key(), t0 + dt.timedelta(hours=rng.randrange(300)), rng.choice([None, rng.random()])) for _ in range(120)]
    got = J.asof(spark.createDataFrame(left, "k string, ts timestamp_ntz, id int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v double"), "v", ["k"]).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in got:
        known = [(t, v) for k, t, v in right if k == r.k and t <= r.ts and v is not None]
        assert r.v == (max(known)[1] if known else None)
    assert sorted(r.id for r in got) == list(range(300))


def test_carried_structs(spark):
    d = spark.createDataFrame([("a", i, (i, f"s{i}") if i % 3 == 1 else None) for i in range(20)] + [("b", 0, None)], "k string, t int, v struct<n: int, s: string>")
    got = {(r.k, r.t): r.o for r in C.carried(d, ["k"], ["t"], "v", "o").collect()}
    assert all(got["a", t] == (None if t < 1 else ((t - 1) // 3 * 3 + 1, f"s{(t - 1) // 3 * 3 + 1}")) for t in range(20)) and got["b", 0] is None


def test_pairs_by_tiles(spark):
    names = [f"n{i}" for i in range(60)]
    d = spark.createDataFrame([(n, i % 3) for i, n in enumerate(names)], "name string, g int")
    got = sorted(map(tuple, J.unordered_pairs(d).collect()))
    assert got == sorted((a, b) for a in names for b in names if a < b)
    inside = sorted(map(tuple, J.unordered_pairs(d, within=["g"], blocks=1).collect()))
    assert inside == sorted((i % 3, *sorted((a, b))) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and i % 3 == j % 3)


def test_values_of_pairs(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", t, rng.random()) for i in range(25) for t in range(6) if rng.random() < 0.8]
    got = J.value_pairs(spark.createDataFrame(rows, "name string, ts int, v double"), "v").toPandas()
    f = pd.DataFrame(rows, columns=["name", "ts", "v"])
    want = f.merge(f, on="ts").query("name_x < name_y")
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(zip(want["name_x"], want["name_y"], want["ts"], want["v_x"], want["v_y"]))

"""Scoring of features and signals against forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import stats as S


def long_features(df: DataFrame, features: list[str], y: str = "y", key: str = "id") -> DataFrame:
    """(feature, key, x, y): all features are then scored in one pass."""
    return df.unpivot([key, y], features, "feature", "x")


def mutual_information(df: DataFrame, x: str, y: str, parts: int = 20, keys: list[str] = ()) -> DataFrame:
    """Of quantile bins of both sides, the joint smoothed by 1e-12 and its marginals taken after that, floor 0.

    The table of a group has parts * parts cells whatever its size; only these leave the aggregation.
    """
    keys, shares = list(keys), [i / parts for i in range(1, parts)]
    whole = df.where(S.both(x, y)).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sides = whole.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(f"_{c}").alias("v")) for c in "xy"])).alias("s")).select(*keys, "s.side", "s.v")
    edges = S.quantiles(sides, "v", shares, [*keys, "side"]).groupBy(*keys).agg(*[F.max(F.when(F.col("side") == c, F.array_distinct("q"))).alias(f"_e{c}") for c in "xy"])
    d = whole.join(edges, keys) if keys else whole.crossJoin(edges)  # one row a group
    bin_of = lambda c: 1 + F.size(F.filter(f"_e{c}", lambda e: e < F.col(f"_{c}")))
    d = d.select(*keys, bin_of("x").alias("_i"), bin_of("y").alias("_j"))
    joint = d.groupBy(*keys, "_i", "_j").agg(F.count(F.lit(1)).alias("n")).checkpoint()  # parts * parts rows a group, read three times
    g = Window.partitionBy(*keys)
    axis = lambda c: joint.select(*keys, c).distinct()
    cells = axis("_i").join(axis("_j"), keys) if keys else axis("_i").join(F.broadcast(axis("_j")))
    p = cells.join(joint, [*keys, "_i", "_j"], "left").select(*keys, "_i", "_j", (F.coalesce("n", F.lit(0)) / F.sum("n").over(g) + 1e-12).alias("p"))
    m = p.select(*keys, "p", F.sum("p").over(Window.partitionBy(*keys, "_i")).alias("px"), F.sum("p").over(Window.partitionBy(*keys, "_j")).alias("py"))
    return m.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(F.col("p") * F.ln(F.col("p") / (F.col("px") * F.col("py"))))).alias("mi"))


def feature_table(df: DataFrame, features: list[str], y: str = "y", key: str = "id", parts: int = 20) -> DataFrame:
    """feature, pearson, spearman, mi, t: one row a feature."""
    d = long_features(df, features, y, key)
    a = d.groupBy("feature").agg(S.pearson("x", y).alias("pearson"), S.slope_t("x", y).alias("t"))
    return a.join(S.spearman(d, "x", y, ["feature"], out="spearman", spread=True).drop("n"), "feature").join(mutual_information(d, "x", y, parts, ["feature"]), "feature")


def composite(table: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of the min-max scaled absolute metrics, and the rank by it."""
    w = Window.partitionBy()
    scaled = [(F.abs(F.coalesce(m, F.lit(0.0))) - F.min(F.abs(F.coalesce(m, F.lit(0.0)))).over(w)) / (F.max(F.abs(F.coalesce(m, F.lit(0.0)))).over(w) - F.min(F.abs(F.coalesce(m, F.lit(0.0)))).over(w) + 1e-12) for m in metrics]
    out = table.withColumn("score", sum(scaled[1:], scaled[0]) / len(metrics))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "feature")))  # one row a feature


def ranked_ic(df: DataFrame, features: list[str], y: str = "y", key: str = "id", top: int | None = None) -> DataFrame:
    """feature, ic (Spearman), abs_ic, in order of abs_ic; the top ones where asked for."""
    d = S.spearman(long_features(df, features, y, key), "x", y, ["feature"], spread=True).select("feature", "ic", F.abs("ic").alias("abs_ic"))
    return d.orderBy(F.desc("abs_ic"), "feature").limit(top) if top else d


def accuracy(df: DataFrame, s: str, r: str) -> DataFrame:
    """Hit ratio, and directional accuracy and counts of either side."""
    hit = F.signum(s) * F.signum(r) > 0
    return df.where(S.both(s, r)).agg(F.avg(hit.cast("int")).alias("hit"), F.avg(F.when(F.col(s) > 0, (F.col(r) > 0).cast("int"))).alias("long_accuracy"), F.avg(F.when(F.col(s) < 0, (F.col(r) < 0).cast("int"))).alias("short_accuracy"), F.count_if(F.col(s) > 0).alias("n_long"), F.count_if(F.col(s) < 0).alias("n_short"))


def distribution(df: DataFrame, c: str) -> DataFrame:
    shares = (0.05, 0.25, 0.5, 0.75, 0.95)
    moments = df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"))
    return moments.select("*", *[F.lit(v).cast("double").alias(f"p{round(p * 100)}") for p, v in zip(shares, S.exact_quantiles(df, c, list(shares)))])


def decay(df: DataFrame, s: str, r: str, most: int = 10, key: str = "ticker", place: str = "bar") -> DataFrame:
    """Spearman of the signal with the return ``lag`` bars later, for each lag, over all series together."""
    late = df.select(key, place, F.col(s).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag")).withColumn("_p", F.col(place) + F.col("lag"))
    joined = late.join(df.select(key, F.col(place).alias("_p"), F.col(r).alias("r")), [key, "_p"])
    return S.spearman(joined, "s", "r", ["lag"], 10, spread=True)


def turnover(df: DataFrame, key: str = "ticker", bucket: str = "v", ts: str = "ts") -> DataFrame:
    """(ts, bucket, turnover): share of a bucket's names that were not in it on the date before."""
    dates = df.select(ts).distinct().withColumn("_before", F.lag(ts).over(Window.orderBy(ts)))  # one row a date
    now = df.select(ts, key, bucket).join(dates, ts)
    old = df.select(F.col(ts).alias("_before"), key, bucket, F.lit(1).alias("_in"))
    return now.where("_before IS NOT NULL").join(old, ["_before", key, bucket], "left").groupBy(ts, bucket).agg(F.avg(F.col("_in").isNull().cast("int")).alias("turnover"))

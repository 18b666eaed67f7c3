"""Linear and rank models. A fit touches the data once: sums and products go to the driver, a few numbers whatever the rows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import stats as S, windows as W
from tidemark.functions.scan import average_ranks


@dataclass
class Gram:
    """Moments of features and target: n, sums, and the matrix of products, of complete rows."""

    features: list[str]
    n: int
    sx: np.ndarray
    sy: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float


def gram(df: DataFrame, features: list[str], y: str = "y") -> Gram:
    columns = [*features, y]
    complete = df.na.drop(subset=columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    r = complete.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(c) for c in columns]).alias("s"), F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs]).alias("p")).first()
    p, m = len(features), np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, r.p):
        m[i, j] = m[j, i] = v or 0.0
    s = np.array([v or 0.0 for v in r.s])
    return Gram(features, r.n, s[:p], float(s[p]), m[:p, :p], m[:p, p], float(m[p, p]))


@dataclass
class Linear:
    """y = intercept + sum of coefficient times feature."""

    features: list[str]
    intercept: float = 0.0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self) -> Column:
        return sum((F.lit(float(b)) * F.coalesce(F.col(f), F.lit(0.0)) for f, b in zip(self.features, self.coefficients)), F.lit(float(self.intercept)))

    def formula(self) -> str:
        return f"y = {self.intercept:.6f}" + "".join(f" {'+' if b >= 0 else '-'} {abs(b):.6f}*{f}" for f, b in zip(self.features, self.coefficients) if b)

    def table(self, spark) -> DataFrame:
        """feature, coefficient; also the form in which a model is stored."""
        return spark.createDataFrame([("intercept", float(self.intercept))] + [(f, float(b)) for f, b in zip(self.features, self.coefficients)], "feature string, coefficient double")

    @classmethod
    def from_table(cls, df: DataFrame) -> "Linear":
        rows = [(r.feature, r.coefficient) for r in df.collect()]
        named = [(f, b) for f, b in rows if f != "intercept"]
        return cls([f for f, _ in named], dict(rows).get("intercept", 0.0), np.array([b for _, b in named]))


def save_model(model: Linear, spark, path: str) -> None:
    model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> Linear:
    return Linear.from_table(spark.read.parquet(path))


def fit_ols(g: Gram, ridge: float = 1e-8) -> Linear:
    """Ordinary least squares; the tiny ridge is on the intercept too."""
    a = np.block([[np.array([[g.n]]), g.sx[None, :]], [g.sx[:, None], g.xx]]) + ridge * np.eye(len(g.sx) + 1)
    b = np.linalg.solve(a, np.r_[g.sy, g.xy])
    return Linear(g.features, b[0], b[1:])


def _standard(g: Gram):
    mean = g.sx / g.n
    sd = np.sqrt(np.maximum(np.diag(g.xx) / g.n - mean**2, 0)) + 1e-12
    c = (g.xx - g.n * np.outer(mean, mean)) / np.outer(sd, sd)
    return mean, sd, c, (g.xy - g.n * mean * (g.sy / g.n)) / sd


def _unscaled(g: Gram, beta, mean, sd) -> Linear:
    b = beta / sd
    return Linear(g.features, g.sy / g.n - float(mean @ b), b)


def fit_ridge(g: Gram, alpha: float = 1.0) -> Linear:
    """On standardised features; the penalty is not divided by the number of rows."""
    mean, sd, c, v = _standard(g)
    return _unscaled(g, np.linalg.solve(c + alpha * np.eye(len(v)), v), mean, sd)


def fit_lasso(g: Gram, alpha: float = 0.001, most: int = 500, tolerance: float = 1e-4) -> Linear:
    """Cyclic coordinate descent on the matrix of products: the same steps as on the rows, which are read once."""
    mean, sd, c, v = _standard(g)
    beta, penalty = np.zeros(len(v)), alpha * g.n
    for _ in range(most):
        moved = 0.0
        for j in range(len(v)):
            rho = v[j] - c[j] @ beta + c[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0) / (c[j, j] + 1e-12)
            moved, beta[j] = max(moved, abs(new - beta[j])), new
        if moved < tolerance:
            break
    return _unscaled(g, beta, mean, sd)


def rolling_ols(df: DataFrame, features: list[str], y: str, window: int, keys: list[str], ts: str = "ts", ridge: float = 1e-6, betas: bool = False) -> DataFrame:
    """Each bar predicted by a fit on the ``window`` bars before it.

    The moments of a window are window sums in the JVM; the small systems are solved in batches. With ``betas`` the
    coefficients come along.
    """
    import pandas as pd

    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(-window, -1)
    columns = ["_one", *features]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    d = df.na.drop(subset=[*features, y]).withColumn("_one", F.lit(1.0))
    d = d.select(*keys, ts, F.array(*columns).alias("_x"), F.count(F.lit(1)).over(w).alias("_n"), F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])).over(w) for i, j in pairs]).alias("_xx"), F.array(*[F.sum(F.col(c) * F.col(y)).over(w) for c in columns]).alias("_xy"))
    p = len(columns)

    def solve(batches):
        for b in batches:
            b = b[b["_n"] >= window]
            if len(b):
                m = np.zeros((len(b), p, p))
                values = np.stack(b["_xx"].to_numpy())
                for k, (i, j) in enumerate(pairs):
                    m[:, i, j] = m[:, j, i] = values[:, k]
                beta = np.linalg.solve(m + ridge * np.eye(p), np.stack(b["_xy"].to_numpy())[..., None])[..., 0]
                out = b[[*keys, ts]].assign(prediction=(beta * np.stack(b["_x"].to_numpy())).sum(axis=1))
                yield out.assign(betas=list(beta[:, 1:])) if betas else out
            else:
                yield pd.DataFrame({c: [] for c in [*keys, ts, "prediction"] + ["betas"] * betas})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name in (*keys, ts)) + ", prediction double" + ", betas array<double>" * betas
    return d.mapInPandas(solve, schema)


def rank_weights(df: DataFrame, features: list[str], y: str = "y", key: str = "id", how: str = "pearson") -> dict[str, float]:
    """IC of each feature, missing as 0; one small row a feature."""
    long = df.unpivot([key, y], features, "feature", "x")
    d = long.groupBy("feature").agg(S.pearson("x", y, 5).alias("ic")) if how == "pearson" else S.spearman(long.withColumnRenamed(y, "_t"), "x", "_t", ["feature"], spread=True)
    found = {r.feature: r.ic or 0.0 for r in d.collect()}
    return {f: found.get(f, 0.0) for f in features}


def rank_scores(df: DataFrame, weights: dict[str, dict[str, float]], key: str = "id", by: list[str] = ()) -> DataFrame:
    """(by, key, one column a name): weighted sums of the features' average ranks, scaled to 0..1 within the table that is
    scored, or within each group of it; all features are ranked in one pass in long form, whatever the number of names."""
    by, features = list(by), sorted({f for w in weights.values() for f in w})
    long = df.unpivot([*by, key], features, "feature", "x").where("x IS NOT NULL")
    ranked = average_ranks(long, "x", [*by, "feature"], "_r")
    n = long.groupBy(*by, "feature").agg(F.count("x").alias("_n"))  # one row a feature and group
    of = {name: F.create_map(*[F.lit(v) for f in features for v in (f, float(w.get(f, 0.0)))]) for name, w in weights.items()}
    scaled = (F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return ranked.join(n, [*by, "feature"]).groupBy(*by, key).agg(*[F.sum(m[F.col("feature")] * scaled).alias(name) for name, m in of.items()])


def rank_score(df: DataFrame, weights: dict[str, float], key: str = "id") -> DataFrame:
    """(key, prediction) of one set of weights."""
    return rank_scores(df, {"prediction": weights}, key)


METRICS = ("ic", "rank_ic", "mse", "rmse", "mae", "r2")


def fit_metrics(df: DataFrame, y: str, p: str, keys: list[str] = ()) -> DataFrame:
    """keys, ic, rank_ic, mse, rmse, mae, r2: one row, or one a group."""
    e, keys = F.col(y) - F.col(p), list(keys)
    a = df.where(S.both(y, p)).groupBy(*keys).agg(S.pearson(y, p).alias("ic"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.var_pop(y) / F.count(y)).alias("r2"))
    ranked = S.spearman(df, y, p, keys, out="rank_ic", spread=True).drop("n")
    return a.join(ranked, keys) if keys else a.crossJoin(ranked)


def compare(train: DataFrame, test: DataFrame, features: list[str], y: str = "y", key: str = "id", alpha: float = 1.0, lasso: float = 0.001) -> DataFrame:
    """model and its metrics on train and test, best absolute rank IC on test first; with the signed ensemble of the best three.

    Both tables and all models are scored together: ranks of all features in one pass, those of all predictions in another.
    """
    g = gram(train, features, y)
    linear = {"ols": fit_ols(g), "ridge": fit_ridge(g, alpha), "lasso": fit_lasso(g, lasso)}
    weights = {"factor_score": rank_weights(train, features, y, key), "rank_alpha": rank_weights(train, features, y, key, "spearman")}
    sides = ("train", "test")
    every = train.select(key, y, *features, F.lit("train").alias("_side")).unionByName(test.select(key, y, *features, F.lit("test").alias("_side")))
    made = every.select("_side", key, y, *[m.predict().alias(n) for n, m in linear.items()]).join(rank_scores(every, weights, key, ["_side"]), ["_side", key]).checkpoint()

    def scored(d, models):
        long = d.unpivot(["_side", y], models, "_model", "_p")
        found = {(r["_model"], r["_side"]): r for r in fit_metrics(long, y, "_p", ["_side", "_model"]).collect()}  # one row a model and side
        return [(m, *[None if (m, s) not in found or found[m, s][k] is None else float(found[m, s][k]) for s in sides for k in METRICS]) for m in models]

    found = scored(made, [*linear, *weights])
    best = sorted(found, key=lambda r: -abs(r[8] or 0))[:3]
    blend = sum((F.lit(float(r[1] or 0)) * F.col(r[0]) for r in best), F.lit(0.0))
    mixed = scored(made.withColumn("ensemble", blend), ["ensemble"])[0]
    if abs(mixed[8] or 0) > 1.1 * abs(best[0][8] or 0):
        found.append(mixed)
    schema = "model string, " + ", ".join(f"{s}_{m} double" for s in sides for m in METRICS)
    out = train.sparkSession.createDataFrame(found, schema)
    return out.orderBy(F.desc(F.abs("test_rank_ic")), "model")


def ensemble(df: DataFrame, members: list[str], y: str = "y", key: str = "id", least: float = 1.1) -> tuple[DataFrame, list[tuple[str, float]]]:
    """(key, prediction) of df(key, y, members...), and the weights: the three members of greatest absolute IC, each with
    its signed share of the sum of these; only the best one where their blend's IC is not ``least`` times its own."""
    ic = df.agg(*[S.pearson(m, y).alias(m) for m in members]).first()
    best = sorted(((m, float(ic[m] or 0.0)) for m in members), key=lambda x: (-abs(x[1]), x[0]))[:3]
    total = sum(abs(v) for _, v in best) or 1.0
    weights = [(m, v / total) for m, v in best]
    blend = lambda w: sum((F.lit(v) * F.col(m) for m, v in w), F.lit(0.0))
    mixed = df.withColumn("_p", blend(weights)).agg(S.pearson("_p", y)).first()[0] or 0.0
    if abs(mixed) <= least * abs(best[0][1]):
        weights = [(best[0][0], 1.0 if best[0][1] >= 0 else -1.0)]
    return df.select(key, blend(weights).alias("prediction")), weights


def max_sharpe_weights(mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    """Long-only weights that sum to one with the greatest ratio of return to risk, exact, by active sets.

    Scaled, they solve: z >= 0, cov z - mean >= 0, and one of the two zero for each name. Names enter one by one where
    the second condition fails most; a step that would make one negative stops at zero and lets it go. Where no mean is
    positive, no mix is better than the best single name.
    """
    n = len(mean)
    inside, z = np.zeros(n, bool), np.zeros(n)
    scale = max(float(np.abs(mean).max(initial=0.0)), 1e-300)
    for _ in range(100 * n):
        short = mean - cov @ z
        short[inside] = -np.inf
        i = int(np.argmax(short))
        if short[i] <= 1e-9 * scale:
            break
        inside[i] = True
        while True:
            aim = np.zeros(n)
            aim[inside] = np.linalg.lstsq(cov[np.ix_(inside, inside)], mean[inside], rcond=None)[0]
            down = inside & (aim <= 0)
            if not down.any():
                z = aim
                break
            step = np.min(z[down] / np.maximum(z[down] - aim[down], 1e-300))
            z = z + step * (aim - z)
            inside &= z > 1e-15 * max(z.max(), 1e-300)
            z[~inside] = 0.0
    if z.sum() <= 0:
        z = np.zeros(n)
        z[int(np.argmax(mean / np.sqrt(np.maximum(np.diag(cov), 1e-300))))] = 1.0
    return z / z.sum()

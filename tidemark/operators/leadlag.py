"""Lead-lag measures between series, signatures, directed graphs and their clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import stats as S


def lagged_correlations(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, lag, rho) of pairs(a, b, place, x, y): x at t with y at t + lag, ends trimmed; lags by one equi-join."""
    from tidemark.operators.joins import lag_pairs

    return lag_pairs(pairs, most, ["a", "b"]).groupBy("a", "b", "lag").agg(S.pearson("x", "y", 3).alias("rho"))


def best_lag(rho: DataFrame) -> DataFrame:
    """C1: the lag with the greatest absolute correlation; of equal ones the smallest lag."""
    return rho.groupBy("a", "b").agg(F.max_by("lag", F.struct(F.abs("rho"), -F.col("lag"))).alias("c1"))


def signed_mass(rho: DataFrame) -> DataFrame:
    """C2: the greater of the two sides' absolute correlation sums over the number of lags a side, negative where the negative side wins; null on ties."""
    r = rho.groupBy("a", "b").agg(F.sum(F.when(F.col("lag") <= 0, F.abs("rho"))).alias("l"), F.sum(F.when(F.col("lag") >= 0, F.abs("rho"))).alias("r"), F.max("lag").alias("t"))
    return r.select("a", "b", F.when(F.col("l") > F.col("r"), -F.col("l") / F.col("t")).when(F.col("r") > F.col("l"), F.col("r") / F.col("t")).alias("c2"))


def cross_functionals(rho: DataFrame) -> DataFrame:
    """lag1: the difference of the correlations at lags 1 and -1; auc: the share of the positive side."""
    at = lambda k: F.max(F.when(F.col("lag") == k, F.col("rho")))
    up, down = F.sum(F.when(F.col("lag") > 0, F.abs("rho"))), F.sum(F.when(F.col("lag") < 0, F.abs("rho")))
    return rho.groupBy("a", "b").agg((at(1) - at(-1)).alias("lag1"), (F.signum(up - down) * F.greatest(up, down) / (up + down)).alias("auc"))


def signature(path: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Level-two signature of the piecewise-linear path (x, y) of each group: s1, s2, s11, s12, s21, s22, levy."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = path.select(*keys, (F.col("x") - F.first("x").over(w)).alias("x"), (F.col("y") - F.first("y").over(w)).alias("y"), (F.lead("x").over(w) - F.col("x")).alias("dx"), (F.lead("y").over(w) - F.col("y")).alias("dy"))
    area = lambda a, da, db: F.sum(F.col(a) * F.col(db) + F.col(da) * F.col(db) / 2)
    out = d.groupBy(*keys).agg(F.coalesce(F.sum("dx"), F.lit(0.0)).alias("s1"), F.coalesce(F.sum("dy"), F.lit(0.0)).alias("s2"), area("x", "dx", "dx").alias("s11"), area("x", "dx", "dy").alias("s12"), area("y", "dy", "dx").alias("s21"), area("y", "dy", "dy").alias("s22"))
    return out.withColumn("levy", (F.col("s12") - F.col("s21")) / 2)


def rolling_levy(path: DataFrame, k: int) -> DataFrame:
    """(a, b, ts, n, levy) of path(a, b, ts, n, x, y): the area of the last k points, where these have k consecutive places n.

    Twice the area is the sum of x[i] y[i+1] - y[i] x[i+1] over the path, closed by its chord: a running sum, so that no
    point is copied into its windows.
    """
    w = Window.partitionBy("a", "b").orderBy("n")
    cross = F.lag("x").over(w) * F.col("y") - F.lag("y").over(w) * F.col("x")
    d = path.withColumn("_c", F.coalesce(cross, F.lit(0.0))).withColumn("_n", F.lag("n", k - 1).over(w)).withColumn("_x", F.lag("x", k - 1).over(w)).withColumn("_y", F.lag("y", k - 1).over(w))
    area = (F.sum("_c").over(w.rowsBetween(-(k - 2), 0)) + F.col("_y") * F.col("x") - F.col("_x") * F.col("y")) / 2
    return d.withColumn("levy", area).where(F.col("_n") == F.col("n") - (k - 1)).select("a", "b", "ts", "n", "levy")


def mirrored(scores: DataFrame, v: str = "v") -> DataFrame:
    """Both orders of each pair, the second with the sign turned."""
    return scores.select("a", "b", v).union(scores.select("b", "a", -F.col(v)))


def row_means(scores: DataFrame, v: str = "v") -> DataFrame:
    """(name, score): the mean over the others; leaders are high."""
    return mirrored(scores, v).groupBy(F.col("a").alias("name")).agg(F.avg(v).alias("score"))


def ends(ranked: DataFrame, share: float = 0.2) -> DataFrame:
    """(name, role): leader for the top share, follower for the bottom; one row a name."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    d = ranked.withColumn("_k", F.floor(n * share)).withColumn("_u", F.row_number().over(Window.orderBy(F.desc("score"), "name"))).withColumn("_d", F.row_number().over(Window.orderBy("score", F.desc("name"))))
    return d.where((F.col("_u") <= F.col("_k")) | (F.col("_d") <= F.col("_k"))).select("name", F.when(F.col("_u") <= F.col("_k"), "leader").otherwise("follower").alias("role"))


def follower_portfolio(returns: DataFrame, roles: DataFrame, name: str = "name", ts: str = "ts") -> DataFrame:
    """(ts, pnl): followers held by the sign of the leaders' mean return of the bar before, each side's weights adding to one."""
    d = returns.join(roles, name)
    lead = d.where("role = 'leader'").groupBy(ts).agg(F.signum(F.avg("r")).alias("signal"), F.avg("r").alias("leaders"))
    follow = d.where("role = 'follower'").groupBy(ts).agg(F.avg("r").alias("followers"))
    w = Window.orderBy(ts)  # one row a date
    return lead.join(follow, ts).select(ts, (F.lag("signal").over(w) * (F.col("followers") - F.col("leaders"))).alias("pnl"))


def adjacency(scores: DataFrame, v: str = "v") -> DataFrame:
    """(src, dst, weight): the positive part of the mirrored scores."""
    return mirrored(scores, v).where(F.col(v) > 0).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col(v).alias("weight"))


#: Names whose dense matrix and edges the driver may hold.
MOST_NAMES = 2_000


def hermitian_clusters(edges: DataFrame, k: int | None = None, most: int = 6, seed: int = 0) -> DataFrame:
    """(name, cluster) of a directed graph of entities: eigenvectors of the random-walk normalised i(A - A'), then k-means; the best silhouette picks k.

    The graph of entities, not of rows, is what reaches the driver; one of more than MOST_NAMES is refused.
    """
    found = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names: cluster a part of them")
    rows, names = edges.collect(), sorted(r.name for r in found)
    at = {n: i for i, n in enumerate(names)}
    a = np.zeros((len(names), len(names)))
    for r in rows:
        a[at[r.src], at[r.dst]] += r.weight
    h = 1j * (a - a.T)
    d = np.sqrt(np.maximum(np.abs(h).sum(axis=1), 1e-12))
    values, vectors = np.linalg.eigh(h / d[:, None] / d[None, :])
    best = None
    for n in [k] if k else range(2, min(most, len(names) - 1) + 1):
        top = np.argsort(-np.abs(values), kind="stable")[: max(1, n if n % 2 == 0 else n - 1)]
        p = vectors[:, top] / d[:, None]
        p = np.real(p @ p.conj().T)
        labels = kmeans(p, n, seed)
        score = silhouette(p, labels)
        if best is None or score > best[0]:
            best = score, labels
    return edges.sparkSession.createDataFrame([(n, int(c)) for n, c in zip(names, best[1])] if best else [], "name string, cluster int")


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = [x[r.integers(len(x))]]
    while len(centres) < k:
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[r.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else r.integers(len(x))])
    c = np.array(centres)
    for _ in range(rounds):
        labels = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[labels == j].mean(axis=0) if (labels == j).any() else c[j] for j in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return labels


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        inside = d[i, same].sum() / (same.sum() - 1)
        outside = min((d[i, labels == o].mean() for o in set(labels) - {own}), default=0.0)
        out.append((outside - inside) / max(inside, outside, 1e-12))
    return float(np.mean(out)) if out else 0.0


def flow_imbalance(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(p, q, net): the weight from cluster p to q less that from q to p, p < q."""
    d = edges.join(clusters.select(F.col("name").alias("src"), F.col("cluster").alias("p")), "src").join(clusters.select(F.col("name").alias("dst"), F.col("cluster").alias("q")), "dst").where("p <> q")
    return d.groupBy(F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).agg(F.sum(F.when(F.col("p") < F.col("q"), F.col("weight")).otherwise(-F.col("weight"))).alias("net"))


def detection_rate(spark, runs: int = 50_000, points: int = 500, block: int = 500, seed: int = 1) -> DataFrame:
    """Share of simulated follower series whose lead of one step the best lag finds; a seed a block of runs."""
    import pandas as pd

    def correlations(a, b):
        a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
        return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))

    def simulate(batches):
        for b in batches:
            for i in b["id"]:
                r = np.random.default_rng([seed, int(i)])
                x = r.standard_normal((block, points + 1))
                y, x = 0.5 * x[:, :-1] + 0.5 * r.standard_normal((block, points)), x[:, 1:]
                rho = np.stack([np.abs(correlations(x[:, max(0, -k) : points - max(0, k)], y[:, max(0, k) : points - max(0, -k)])) for k in range(-2, 3)], axis=1)
                yield pd.DataFrame({"hits": [int((rho.argmax(axis=1) == 3).sum())], "runs": [block]})

    blocks = spark.range(0, -(-runs // block), 1, min(-(-runs // block), 100))
    return blocks.mapInPandas(simulate, "hits long, runs long").agg((F.sum("hits") / F.sum("runs")).alias("rate"), F.sum("runs").alias("runs"))

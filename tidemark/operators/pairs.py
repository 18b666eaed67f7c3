"""Cointegration tests, pair selection and pair trading. A pair or a run is one task; pairs are spread."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import windows as W
from tidemark.functions.scan import checkpoint_folder, numbered

# MacKinnon (2010) response surfaces of critical values for tests with a constant, at 1, 5 and 10 %,
# as b0 + b1/T + b2/T^2 + b3/T^3, for one and for two variables.
CRITICAL = {
    1: [(-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0)],
    2: [(-3.89644, -10.9519, -22.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.720, 0.0)],
}
# MacKinnon (1994) surfaces of p-values with a constant, as a polynomial in the statistic: the greatest
# statistic, the least, the switch, and the coefficients of either side.
P_VALUES = {
    1: (2.74, -18.83, -1.61, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    2: (0.92, -18.86, -2.62, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
}
# Critical values of the Johansen trace test at 95 % without trend, for 1 to 4 remaining relations.
TRACE_95 = [3.8415, 15.4943, 29.7961, 47.8545]


def p_value(stat: float, variables: int = 1) -> float:
    top, least, switch, low, high = P_VALUES[variables]
    if stat >= top:
        return 1.0
    if stat <= least:
        return 0.0
    z = sum(c * stat**i for i, c in enumerate(low if stat <= switch else high))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def critical_values(n: int, variables: int = 1) -> list[float]:
    return [b[0] + b[1] / n + b[2] / n**2 + b[3] / n**3 for b in CRITICAL[variables]]


def _least_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    cov = np.linalg.pinv(x.T @ x) * (e @ e) / max(1, len(y) - x.shape[1])
    return beta, e, np.sqrt(np.maximum(np.diag(cov), 0))


def adf(y: np.ndarray, most: int | None = None, constant: bool = True) -> tuple[float, int, int]:
    """Augmented Dickey-Fuller statistic, lags by the least AIC on a common sample, observations used."""
    y = np.asarray(y, float)
    n = len(y)
    if most is None:
        most = int(math.ceil(12 * (n / 100) ** 0.25))
    most = max(0, min(most, n // 2 - 1 - int(constant)))
    d = np.diff(y)

    def design(k, skip):
        rows = np.arange(skip, len(d))
        cols = [y[rows]] + [d[rows - j] for j in range(1, k + 1)] + ([np.ones(len(rows))] if constant else [])
        return np.stack(cols, axis=1), d[rows]

    best = None
    for k in range(most + 1):
        x, t = design(k, most)
        if len(t) <= x.shape[1]:
            break
        _, e, _ = _least_squares(x, t)
        aic = len(t) * (math.log(2 * math.pi * max(e @ e, 1e-300) / len(t)) + 1) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            best = aic, k
    k = best[1] if best else 0
    x, t = design(k, k)
    beta, _, se = _least_squares(x, t)
    return float(beta[0] / se[0]) if se[0] > 0 else float("-inf"), k, len(t)


def engle_granger(y: np.ndarray, x: np.ndarray, most: int | None = None) -> tuple[float, float]:
    """Statistic and p-value of cointegration of y with x: the residuals of y on x and a constant are tested without one."""
    _, e, _ = _least_squares(np.stack([x, np.ones(len(x))], axis=1), y)
    if (e @ e) / max(1e-300, ((y - y.mean()) ** 2).sum()) < 1e-12:
        return float("-inf"), 0.0
    stat, *_ = adf(e, most, constant=False)
    return stat, p_value(stat, 2)


#: Rows of a block of a series or pair whose moments are taken in one task.
BLOCK = 1 << 14


def lagged_moments(df: DataFrame, keys: list[str], values: list[str], ts: str = "ts", most: int | None = None, constant: bool = True, block: int | None = None) -> DataFrame:
    """One row a block of each group: n, most, and sums over its rows from which a test with any number of lags can be solved.

    ``moments`` are the cross products of [changes, values before, 1, changes one to ``most`` rows earlier], values less
    their means; ``levels`` those of [values, 1]; ``head`` the first values, in block 0. A block comes with the rows around
    it that its lags need, so no series or pair is gathered.
    """
    block = block or BLOCK
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"), *[F.avg(v).alias(f"_mean{i}") for i, v in enumerate(values)])
    free = F.floor(F.col("_size") / 2) - 1 - int(constant)
    wanted = F.ceil(12 * F.pow(F.col("_size") / 100, 0.25)) if most is None else F.lit(most)
    size = size.withColumn("_most", F.greatest(F.least(wanted, free), F.lit(0)).cast("int"))
    placed = numbered(df.select(*keys, ts, *values), keys, [ts]).join(size, keys)
    block_of = lambda n: F.greatest(F.floor(n / F.greatest(F.lit(block), 2 * F.col("_most") + 2)), F.lit(0))
    d = placed.withColumn("_block", F.explode(F.sequence(block_of(F.col("_n") - 1), F.least(block_of(F.col("_n") + F.col("_most")), block_of(F.col("_size") - 1)))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n")
        head = pdf.iloc[0]
        k, n, number = int(head["_most"]), int(head["_size"]), int(head["_block"])
        width, v = max(block, 2 * k + 2), len(values)
        y = pdf[values].to_numpy(float) - np.array([head[f"_mean{i}"] for i in range(v)])
        first = int(head["_n"])
        change = np.diff(y, axis=0)
        mine = (pdf["_n"].to_numpy() // width == number)
        level = np.hstack([y[mine], np.ones((int(mine.sum()), 1))])
        rows = np.arange(max(number * width, k), min((number + 1) * width, n - 1)) - first
        u = np.hstack([change[rows], y[rows], np.ones((len(rows), 1)), *[change[rows - j] for j in range(1, k + 1)]])
        out = {c: [head[c]] for c in keys} | {"n": [n], "most": [k], "moments": [(u.T @ u).ravel()], "levels": [(level.T @ level).ravel()], "head": [y[: k + 2].ravel() if number == 0 else np.zeros(0)]}
        return pd.DataFrame(out)

    kinds = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in keys), "n long, most int, moments array<double>, levels array<double>, head array<double>"])
    return d.groupBy(*keys, "_block").applyInPandas(one, kinds)


class Moments:
    """The sums of all blocks of a group, of v values."""

    def __init__(self, pdf: pd.DataFrame, v: int):
        self.v, self.n, self.most = v, int(pdf["n"].iloc[0]), int(pdf["most"].iloc[0])
        self.all = np.sum(np.stack(pdf["moments"].to_list()), axis=0).reshape(-1, 2 * v + 1 + v * self.most)
        self.levels = np.sum(np.stack(pdf["levels"].to_list()), axis=0).reshape(v + 1, v + 1)
        self.head = max(pdf["head"], key=len).reshape(-1, v)

    def adf(self, weights: np.ndarray, shift: float, constant: bool) -> tuple[float, int, int]:
        """adf() of the combination of the values with these weights, less a shift."""
        v, k = self.v, self.most
        t = np.zeros((3 + k, self.all.shape[1]))  # change, value before, 1, earlier changes
        t[0, :v], t[1, v : 2 * v], t[1, 2 * v], t[2, 2 * v] = weights, weights, -shift, 1
        for j in range(k):
            t[3 + j, 2 * v + 1 + j * v : 2 * v + 1 + (j + 1) * v] = weights
        m = t @ self.all @ t.T
        e = self.head @ weights - shift
        change = np.diff(e)

        def fit(m, lags):
            at = [1, *range(3, 3 + lags), *([2] if constant else [])]
            x, y = m[np.ix_(at, at)], m[at, 0]
            scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
            inverse = np.linalg.pinv(x / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
            beta = inverse @ y
            return beta[0], max(m[0, 0] - beta @ y, 0.0), inverse[0, 0], len(at)

        best, rows = None, self.n - 1 - k
        for lags in range(k + 1):
            _, left, _, p = fit(m, lags)
            if rows <= p:
                break
            aic = rows * (math.log(2 * math.pi * max(left, 1e-300) / rows) + 1) + 2 * p
            if best is None or aic < best[0]:
                best = aic, lags
        lags = best[1] if best else 0
        more = np.zeros_like(m)
        for r in range(lags, min(k, len(change))):  # rows that only fewer lags leave
            u = np.zeros(len(m))
            u[:3], u[3 : 3 + lags] = (change[r], e[r], 1), [change[r - j] for j in range(1, lags + 1)]
            more += np.outer(u, u)
        beta, left, spread, p = fit(m + more, lags)
        rows = self.n - 1 - lags
        error = math.sqrt(max(spread * left / max(1, rows - p), 0))
        return float(beta / error) if error > 0 else float("-inf"), lags, rows

    def engle_granger(self) -> tuple[float, float]:
        """Of the first value with the second."""
        s = self.levels
        slope, shift = np.linalg.lstsq(s[1:, 1:], s[1:, 0], rcond=None)[0]
        left = s[0, 0] - np.array([slope, shift]) @ s[1:, 0]
        if left / max(1e-300, s[0, 0] - s[0, 2] ** 2 / self.n) < 1e-12:
            return float("-inf"), 0.0
        stat, *_ = self.adf(np.array([1.0, -slope]), shift, False)
        return stat, p_value(stat, 2)


def johansen(x: np.ndarray, lags: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Eigenvalues, eigenvectors, trace statistics and rank at 95 % of a constant model, by reduced-rank regression."""
    x = np.asarray(x, float)
    d = np.diff(x, axis=0)
    rows = np.arange(lags, len(d))
    past = np.hstack([d[rows - j] for j in range(1, lags + 1)] + [np.ones((len(rows), 1))])
    clean = lambda m: m - past @ np.linalg.lstsq(past, m, rcond=None)[0]
    r0, r1 = clean(d[rows]), clean(x[rows])
    n = len(rows)
    s00, s11, s01 = r0.T @ r0 / n, r1.T @ r1 / n, r0.T @ r1 / n
    root = np.linalg.cholesky(np.linalg.inv(s11))
    values, vectors = np.linalg.eigh(root.T @ s01.T @ np.linalg.solve(s00, s01) @ root)
    order = np.argsort(-values)
    values = np.clip(values[order], 0, 1 - 1e-12)
    trace = np.array([-n * np.log(1 - values[i:]).sum() for i in range(len(values))])
    rank = next((i for i, t in enumerate(trace) if t <= TRACE_95[min(len(values) - i, 4) - 1]), len(values))
    return values, (root @ vectors)[:, order], trace, rank


def adf_table(df: DataFrame, key: str, c: str, ts: str = "ts", block: int | None = None) -> DataFrame:
    """key, stat, p, lags and critical values of each series, from lagged moments of its blocks."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        stat, k, n = Moments(pdf, 1).adf(np.ones(1), 0.0, True)
        return pd.DataFrame([(pdf[key].iloc[0], stat, p_value(stat), k, *critical_values(n))], columns=[key, "stat", "p", "lags", "c1", "c5", "c10"])

    blocks = lagged_moments(df, [key], [c], ts, block=block)  # one row a block
    return blocks.groupBy(key).applyInPandas(one, f"{key} string, stat double, p double, lags long, c1 double, c5 double, c10 double")


def cointegration_scan(pairs: DataFrame, most: int | None = None, block: int | None = None) -> DataFrame:
    """(a, b, stat, p) for pairs(a, b, ts, x, y), from lagged cross moments of the blocks of each pair."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["a"].iloc[0], pdf["b"].iloc[0], *Moments(pdf, 2).engle_granger())], columns=["a", "b", "stat", "p"])

    blocks = lagged_moments(pairs, ["a", "b"], ["x", "y"], most=most, constant=False, block=block)
    return blocks.groupBy("a", "b").applyInPandas(one, "a string, b string, stat double, p double")


def johansen_scan(pairs: DataFrame) -> DataFrame:
    """(a, b, eigenvalue, trace0, trace1, rank, weight) for pairs(a, b, ts, x, y): one task a pair; weight is that of b where a has 1."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values, vectors, trace, rank = johansen(pdf.sort_values("ts")[["x", "y"]].to_numpy())
        row = (pdf["a"].iloc[0], pdf["b"].iloc[0], float(values[0]), float(trace[0]), float(trace[1]), int(rank), float(vectors[1, 0] / vectors[0, 0]))
        return pd.DataFrame([row], columns=["a", "b", "eigenvalue", "trace0", "trace1", "rank", "weight"])

    kinds = "a string, b string, eigenvalue double, trace0 double, trace1 double, rank long, weight double"
    return pairs.select("a", "b", "ts", "x", "y").groupBy("a", "b").applyInPandas(one, kinds)


def pair_correlations(pairs: DataFrame) -> DataFrame:
    """(a, b, rho): rounded to two places, -2 where it is missing."""
    from tidemark.functions.stats import pearson

    return pairs.groupBy("a", "b").agg(F.coalesce(F.round(pearson("x", "y", 3), 2), F.lit(-2.0)).alias("rho"))


def select_pairs(pairs: DataFrame, least: float = 0.75, top: int = 100, steepest: float = 6.0, farthest: float = 100.0, by: tuple[str, ...] = ()) -> DataFrame:
    """a, b, weight, intercept, deviation: correlated, regressed either way, stationary at 10 %; the widest spreads first.

    ``by`` names whole-number columns, such as a period, whose values are selected from separately.
    """
    from tidemark.functions.stats import pearson

    g = pairs.groupBy(*by, "a", "b").agg(
        F.coalesce(F.round(pearson("x", "y", 3), 2), F.lit(-2.0)).alias("rho"), F.regr_slope("x", "y").alias("s1"), F.regr_intercept("x", "y").alias("i1"), F.regr_slope("y", "x").alias("s2"), F.regr_intercept("y", "x").alias("i2"),
    ).where(F.col("rho") >= least)
    flip = F.col("s2") > F.col("s1")
    weight, intercept = F.round(F.when(flip, F.col("s2")).otherwise(F.col("s1")), 2), F.round(F.when(flip, F.col("i2")).otherwise(F.col("i1")), 2)
    g = g.select(*by, "a", "b", flip.alias("flip"), weight.alias("weight"), intercept.alias("intercept")).where((F.col("weight") <= steepest) & (F.abs("intercept") <= farthest))
    names = [*by, "a", "b", "weight", "intercept", "deviation"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        x, y, head = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf.iloc[0]
        spread = y - head["intercept"] - head["weight"] * x if head["flip"] else x - head["intercept"] - head["weight"] * y
        stat, _, n = adf(spread)
        legs = [head["b"], head["a"]] if head["flip"] else [head["a"], head["b"]]
        rows = [(*(head[c] for c in by), *legs, head["weight"], head["intercept"], float(np.std(spread)))] if stat < critical_values(n)[2] else []
        return pd.DataFrame(rows, columns=names)

    kinds = ", ".join([*(f"{c} long" for c in by), "a string, b string, weight double, intercept double, deviation double"])
    found = pairs.select(*by, "a", "b", "ts", "x", "y").join(g, [*by, "a", "b"]).groupBy(*by, "a", "b").applyInPandas(one, kinds)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("deviation"), "a", "b"))
    return found.withColumn("_place", place).where(F.col("_place") <= top).drop("_place") if by else found.orderBy(F.desc("deviation"), "a", "b").limit(top)


def random_pairs(pairs: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Control group: pairs in the order of a seeded hash; the same each run, but not that of another generator."""
    return pairs.select("a", "b").distinct().orderBy(F.md5(F.concat_ws("|", "a", "b", F.lit(str(seed)))), "a", "b").limit(n)


def back_window(spread: DataFrame, bars: int, key: str = "pair") -> DataFrame:
    """Adds mean and deviation of the spread over the bars before, rounded to two places."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(-bars, -1)
    full = F.count("spread").over(w) >= bars
    return spread.withColumn("mean", F.when(full, F.round(F.avg("spread").over(w), 2))).withColumn("sd", F.when(full, F.round(F.stddev_pop("spread").over(w), 2)))


def reversion_positions(z: DataFrame, entry: float = 1.0, key: str = "pair") -> DataFrame:
    """position of df(pair, ts, z): -1 above the entry, 1 below its negative, flat on a cross of the mean, else held."""
    bar = Window.partitionBy(key).orderBy("ts")
    before = F.lag("z").over(bar)
    crosses = ~F.isnan("z") & ~F.isnan(before) & (F.signum("z") != F.signum(before))
    event = F.when(F.col("z") > entry, -1).when(F.col("z") < -entry, 1).when(crosses, 0)
    d = z.select(key, "ts", "z", event.alias("_event"))
    held = F.last("_event", ignorenulls=True).over(bar.rowsBetween(Window.unboundedPreceding, 0))
    return d.select(key, "ts", "z", F.coalesce(held, F.lit(0)).alias("position"))


def spread_returns(positions: DataFrame, spread: str = "spread", key: str = "pair") -> DataFrame:
    """(pair, ts, pnl, total, compound) of df(pair, ts, spread, position): the position of the bar before times the change
    of the spread (0 at first), its running sum, and the running product of one more than it, less one."""
    bar = Window.partitionBy(key).orderBy("ts")
    pnl = F.lag("position").over(bar) * F.coalesce(F.col(spread) - F.lag(spread).over(bar), F.lit(0.0))
    d = positions.select(key, "ts", pnl.alias("pnl"))
    so_far = W.running(bar)
    return d.select(key, "ts", "pnl", F.sum("pnl").over(so_far).alias("total"), (F.product(1 + F.col("pnl")).over(so_far) - 1).alias("compound"))


INITIAL, MAINTENANCE = 1.5, 1.25
DAY = "pair string, ts timestamp_ntz, positive int, negative int, days_open array<int>, profit double, ret double, open int, margin double"


def margin(long_value: float, short_value: float) -> float:
    """Half as much again as is sold short, less the long side; never less than a quarter over maintenance."""
    return max(INITIAL * short_value - long_value, MAINTENANCE * short_value - short_value)


def trade_pairs(df: DataFrame, delta: float = 1.0, budget: float = 10_000.0) -> DataFrame:
    """One row a pair and bar of df(pair, ts, x, y, weight, spread, mean, sd): trades closed and open, profit and margin.

    Opens short the first leg above mean + delta deviations and long below, in whole shares and not at all where a leg
    has none; closes where the spread crosses the mean; what is open at the end is closed there.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, out = pdf.sort_values("ts"), None, []
        columns = (pdf[c].to_numpy(float).tolist() for c in ("x", "y", "weight", "spread", "mean", "sd"))
        final = len(pdf) - 1
        for i, (pair, ts, x, y, weight, spread, mean, sd) in enumerate(zip(pdf["pair"], pdf["ts"], *columns)):
            row = [pair, ts, 0, 0, [], 0.0, 0.0, 0, 0.0]
            known = mean == mean and sd == sd and sd > 0
            if at is not None:
                side, a, b, x0, y0, age = at
                age += 1
                crossed = known and (spread <= mean if side < 0 else spread >= mean)
                if crossed or i == final:
                    profit, worth = side * (x - x0) * a - side * (y - y0) * b, a * x0 + b * y0
                    row[2:7] = int(profit > 0), int(profit <= 0), [age], profit, round(profit / worth, 4)
                    at = None
                else:
                    at = side, a, b, x0, y0, age
            elif known and i < final and abs(spread - mean) >= delta * sd:
                a, b = math.floor(budget / x), math.floor(budget * abs(weight) / y)
                if a > 0 and b > 0:
                    at = (-1 if spread > mean else 1), a, b, x, y, 0
            if at is not None:
                side, a, b, *_ = at
                row[7], row[8] = 1, margin(b * y, a * x) if side < 0 else margin(a * x, b * y)
            out.append(row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in DAY.split(", ")])

    return df.groupBy("pair").applyInPandas(one, DAY)


def day_rollup(trades: DataFrame, pairs: int) -> DataFrame:
    return trades.groupBy("ts").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"), F.sum("profit").alias("profit"), (F.sum("ret") / pairs).alias("ret"), F.sum("open").alias("open"), F.sum("margin").alias("margin"), F.flatten(F.collect_list("days_open")).alias("days_open"))


#: Bars of all long windows that one task sorts, about: 450 MB. The bars of one pair and window stay together.
GRID_ROWS = 1 << 18


def ratio_strategy(pairs: DataFrame, short: int, windows: list[int]) -> DataFrame:
    """(pair, long, money) of df(pair, ts, x, y) for each long window.

    The z value of a bar is the short mean of x / y less the long one, over the long sample deviation. Above 1 a
    share of x is bought for x / y shares of y, below -1 it is sold for them, which moves no money; within 0.75 all
    that is held is sold at the bar's prices. So the money is what each sale brings: between two sales only the sums
    of shares matter. Long means and deviations are differences of running sums, for all windows in one join.
    """
    bar = Window.partitionBy("pair").orderBy("ts")
    d = pairs.select("pair", "ts", "x", "y", (F.col("x") / F.col("y")).alias("ratio"), F.row_number().over(bar).cast("long").alias("n"))
    d = d.withColumn("c", F.col("ratio") - F.avg("ratio").over(Window.partitionBy("pair")))
    d = d.withColumn("s1", F.sum("c").over(W.running(bar))).withColumn("s2", F.sum(F.col("c") * F.col("c")).over(W.running(bar)))
    d = d.withColumn("near", W.rolling_mean("c", bar, max(short, 1), max(short, 1)))
    checkpoint_folder(pairs.sparkSession)
    d = d.checkpoint()
    grid = d.withColumn("long", F.explode(F.array(*[F.lit(int(k)) for k in windows])))
    wide = grid.where((F.col("long") >= 2) & (F.col("n") >= F.col("long")) & F.lit(short > 0))
    past = d.select("pair", F.col("n").alias("m"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    wide = wide.withColumn("m", F.col("n") - F.col("long")).join(past, ["pair", "m"], "left").na.fill(0.0, ["p1", "p2"])
    k, sum1, sum2 = F.col("long"), F.col("s1") - F.col("p1"), F.col("s2") - F.col("p2")
    spread = (sum2 - sum1 * sum1 / k) / (k - 1)
    z = wide.withColumn("z", F.when(spread > 1e-18, (F.col("near") - sum1 / k) / F.sqrt(spread)))
    side = F.when(F.col("z") > 1, 1.0).when(F.col("z") < -1, -1.0).otherwise(0.0)
    sale = F.coalesce(F.abs("z") < 0.75, F.lit(False))
    earlier = Window.partitionBy("pair", "long").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    z = z.select("pair", "long", "ts", "x", "y", "ratio", side.alias("side"), sale.alias("sale"))
    z = z.repartition(d.count() * len(windows) // GRID_ROWS + 1, "pair", "long")  # else all windows of a pair are sorted in its task
    z = z.withColumn("block", F.coalesce(F.sum(F.col("sale").cast("int")).over(earlier), F.lit(0)))
    price = lambda c: F.max(F.when(F.col("sale"), F.col(c)))
    sold = z.groupBy("pair", "long", "block").agg((F.sum("side") * price("x") - F.sum(F.col("side") * F.col("ratio")) * price("y")).alias("money"))
    every = d.select("pair").distinct().withColumn("long", F.explode(F.array(*[F.lit(int(k)) for k in windows])))
    return every.join(sold.groupBy("pair", "long").agg(F.sum("money").alias("money")), ["pair", "long"], "left").na.fill(0.0, ["money"])


def walk_forward(pairs: DataFrame, inside: int = 126, step: int = 31, back: int = 21, **selection) -> DataFrame:
    """Trades with their period: pairs are selected on each period's ``inside`` bars and traded on the next ``step``,
    with ``back`` bars before for the mean.

    A bar goes to the few periods that it belongs to, and all periods are selected from and traded in one plan.
    """
    d = pairs.withColumn("bar", F.row_number().over(Window.partitionBy("a", "b").orderBy("ts")).cast("long"))
    last = d.agg(F.max("bar")).first()[0] or 0
    periods = max(0, (last - inside - step) // step + 1)
    # Period p starts at bar p * step + 1 and takes in inside + step bars.
    first = F.greatest(F.lit(0), F.ceil((F.col("bar") - inside - step) / step)).cast("long")
    latest = F.least(F.lit(periods - 1), F.floor((F.col("bar") - 1) / step)).cast("long")
    d = d.where(first <= latest).withColumn("period", F.explode(F.sequence(first, latest))).withColumn("at", F.col("bar") - F.col("period") * step)
    chosen = select_pairs(d.where(F.col("at") <= inside), by=("period",), **selection)
    test = d.where(F.col("at") > inside - back)
    turned = test.select("period", F.col("b").alias("a"), F.col("a").alias("b"), "ts", "at", F.col("y").alias("x"), F.col("x").alias("y"))
    both = test.select(*turned.columns).unionByName(turned).join(chosen, ["period", "a", "b"])
    spread = F.col("x") - F.col("intercept") - F.col("weight") * F.col("y")
    s = both.select(F.concat_ws("|", "period", F.concat_ws(":", "a", "b")).alias("pair"), "ts", "at", "x", "y", "weight", spread.alias("spread"))
    traded = trade_pairs(back_window(s, back).where(F.col("at") > inside))
    return traded.withColumn("period", F.split("pair", r"\|")[0].cast("int")).withColumn("pair", F.split("pair", r"\|")[1])

"""SQL of unit-root and cointegration tests: regressions with any number of lags by elimination on their moments."""

from __future__ import annotations

from tidemark.operators.pairs import CRITICAL, P_VALUES


def eliminated(name: str, source: str) -> str:
    """A recursive table name(id, lags, p, a) that reduces the matrices of source(id, lags, a) to the unit matrix, column by column."""
    row = "list_transform(line, lambda z, c: z - line[p] / a[p][p] * a[p][c])"
    return f"""{name} AS (SELECT id, lags, 1 AS p, a FROM {source}
UNION ALL SELECT id, lags, p + 1, list_transform(a, lambda line, i: CASE WHEN i = p THEN list_transform(line, lambda z: z / a[p][p]) ELSE {row} END) FROM {name} WHERE p <= len(a))"""


def matrices(name: str, moments: str, lags: str) -> str:
    """name(id, lags, a): the moments of the regressors (1: value before, 2: constant, 3 on: lags), those with the target (0), and the first unit vector."""
    return f"""{name} AS MATERIALIZED (SELECT id, lags, list(line ORDER BY i) AS a FROM (
SELECT m.id, l.lags, m.i, list_concat(list(x ORDER BY j) FILTER (WHERE j >= 1), list(x) FILTER (WHERE j = 0), [CASE WHEN m.i = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END]) AS line
FROM {moments} m JOIN {lags} l ON l.id = m.id WHERE i >= 1 AND i <= 2 + l.lags AND j <= 2 + l.lags GROUP BY m.id, l.lags, m.i) GROUP BY id, lags)"""


def fits(name: str, solved: str, moments: str) -> str:
    """name(id, lags, beta, spread, rss, p): of the solved regressions."""
    return f"""{name} AS MATERIALIZED (SELECT s.id, s.lags, any_value(a[1][len(a) + 1]) AS beta, any_value(a[1][len(a) + 2]) AS spread, any_value(len(a)) AS p,
max(m.x) FILTER (WHERE m.i = 0) - sum(m.x * a[o][len(a) + 1]) FILTER (WHERE m.i > 0) AS rss
FROM (SELECT *, unnest(range(1, len(a) + 1)) AS o FROM {solved} WHERE p = len(a) + 1) s JOIN (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY i) - 1 AS k FROM {moments} WHERE j = 0) m ON m.id = s.id AND (m.k = o OR (m.i = 0 AND o = 1)) GROUP BY s.id, s.lags)"""


def normal(z: str) -> str:
    """The normal distribution function, by Simpson's rule."""
    steps = 400
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(0.5 + list_sum(list_transform(range({steps + 1}), lambda i: {weight} * exp(-pow(({z}) * i / {steps}, 2) / 2))) * ({z}) / {3 * steps} / sqrt(2 * pi()))"


def p_sql(stat: str, variables: int) -> str:
    top, least, switch, low, high = P_VALUES[variables]
    poly = lambda c: " + ".join(f"{v!r}::DOUBLE * pow({stat}, {i})" for i, v in enumerate(c))
    z = f"greatest(-30, least(30, CASE WHEN {stat} <= {switch} THEN {poly(low)} ELSE {poly(high)} END))"
    return f"CASE WHEN {stat} >= {top} THEN 1 WHEN {stat} <= {least} THEN 0 ELSE {normal(z)} END"


def critical_sql(n: str, k: int) -> str:
    b = CRITICAL[1][k]
    return " + ".join(f"{v!r}::DOUBLE / pow({n}, {i})" for i, v in enumerate(b))


def adf_sql(series: str, constant: bool, most: str | None = None) -> str:
    """Tables after ``series``, which is "y AS (SELECT id, r, v ...)" with places r from 0; the last is adf(id, stat, lags, n)."""
    most = most or "CAST(ceil(12 * pow(count(*) / 100.0::DOUBLE, 0.25)) AS BIGINT)"
    moments = "SELECT a.id, a.j AS i, b.j AS j, sum(a.x * b.x) AS x FROM f a JOIN f b ON a.id = b.id AND a.r = b.r JOIN {skip} s ON s.id = a.id WHERE a.r >= s.lags GROUP BY 1, 2, 3"
    level = "v - mean" if constant else "v"
    return ", ".join([
        series,
        f"size AS (SELECT id, count(*) AS n, avg(v) AS mean, greatest(least({most}, count(*) // 2 - {1 + int(constant)}), 0) AS lags FROM y GROUP BY id)",
        f"u AS MATERIALIZED (SELECT y.id, r, {level} AS level, lead(v) OVER (PARTITION BY y.id ORDER BY r) - v AS d, lags FROM y JOIN size USING (id))",
        "f AS MATERIALIZED (SELECT id, r, 0 AS j, d AS x FROM u WHERE d IS NOT NULL UNION ALL SELECT id, r, 1, level FROM u WHERE d IS NOT NULL"
        + (" UNION ALL SELECT id, r, 2, 1.0::DOUBLE FROM u WHERE d IS NOT NULL" if constant else "")
        + " UNION ALL SELECT a.id, a.r, 2 + l, b.d FROM (SELECT *, unnest(range(1, lags + 1)) AS l FROM u WHERE d IS NOT NULL) a JOIN u b ON b.id = a.id AND b.r = a.r - l)",
        f"m1 AS MATERIALIZED ({moments.format(skip='size')})",
        "tries AS (SELECT id, unnest(range(lags + 1)) AS lags FROM size)",
        matrices("a1", "m1", "tries"), eliminated("e1", "a1"), fits("r1", "e1", "m1"),
        "aic AS (SELECT r1.id, r1.lags, (n - 1 - size.lags) AS rows, rows * (ln(2 * pi() * greatest(rss, 1e-300) / rows) + 1) + 2 * p AS aic FROM r1 JOIN size USING (id) WHERE n - 1 - size.lags > p)",
        "best AS MATERIALIZED (SELECT size.id, coalesce(arg_min(aic.lags, (aic, aic.lags)), 0) AS lags FROM size LEFT JOIN aic USING (id) GROUP BY 1)",
        f"m2 AS MATERIALIZED ({moments.format(skip='best')})",
        matrices("a2", "m2", "best"), eliminated("e2", "a2"), fits("r2", "e2", "m2"),
        "adf AS (SELECT r2.id, beta / sqrt(spread * rss / (n - 1 - r2.lags - p)) AS stat, r2.lags, n - 1 - r2.lags AS n FROM r2 JOIN size USING (id))",
    ])


def unit_root_sql() -> str:
    series = "y AS (SELECT name AS id, row_number() OVER (PARTITION BY name ORDER BY ts) - 1 AS r, v FROM nation_months)"
    out = ", ".join(f"{critical_sql('n', k)} AS c{c}" for k, c in enumerate((1, 5, 10)))
    return f"WITH RECURSIVE {adf_sql(series, True)}\nFINALLY SELECT id AS name, stat, {p_sql('stat', 1)} AS p, lags, {out} FROM adf"


def cointegration_sql(pairs: str, most: int | None = None, where: str = "true") -> str:
    """Over pairs p(a, b, ts, x, y)."""
    series = f"{pairs}, line AS (SELECT a, b, regr_slope(x, y) AS s, regr_intercept(x, y) AS i FROM p GROUP BY 1, 2), y AS MATERIALIZED (SELECT a || '|' || b AS id, row_number() OVER (PARTITION BY a, b ORDER BY ts) - 1 AS r, x - s * y - i AS v FROM p JOIN line USING (a, b))"
    return f"WITH RECURSIVE {adf_sql(series, False, None if most is None else str(most))}, o AS (SELECT split_part(id, '|', 1) AS a, split_part(id, '|', 2) AS b, stat, {p_sql('stat', 2)} AS p FROM adf)\nFINALLY SELECT * FROM o WHERE {where}"

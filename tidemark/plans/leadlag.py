"""Lead-lag queries, on monthly totals by nation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import windows as W
from tidemark.operators import joins as J, leadlag as G
from tidemark.plans.registry import query
from tidemark.plans.views import nation_months

N = ("nation_months",)


def name():
    return Window.partitionBy("name").orderBy("ts")




def returns(s, d):
    """name, ts, r: monthly changes."""
    return nation_months(s, d).select("name", "ts", W.pct_change("v", name()).alias("r")).na.drop()


RET = "r AS (SELECT * FROM (SELECT name, ts, v / lag(v) OVER (PARTITION BY name ORDER BY ts) - 1 AS r FROM nation_months) WHERE r IS NOT NULL)"
PAIRS = f"{RET}, p AS (SELECT a.name AS a, b.name AS b, a.ts, a.r AS x, b.r AS y, row_number() OVER (PARTITION BY a.name, b.name ORDER BY a.ts) AS place FROM r a JOIN r b ON a.ts = b.ts AND a.name < b.name)"


def pairs(s, d):
    r = returns(s, d)
    p = J.value_pairs(r, "r")
    return p.withColumn("place", F.row_number().over(Window.partitionBy("a", "b").orderBy("ts")))


RHO = f"{PAIRS}, rho AS (SELECT p.a, p.b, lag, CASE WHEN count(*) >= 3 THEN corr(p.x, q.y) END AS rho FROM p JOIN (SELECT unnest(range(-3, 4)) AS lag) ON true JOIN p q ON p.a = q.a AND p.b = q.b AND q.place = p.place + lag GROUP BY 1, 2, 3)"
rho = lambda s, d: G.lagged_correlations(pairs(s, d), 3)
query("g01_lagged_correlation", "a:s b:s lag:l rho:d", rho, f"WITH {RHO}\nFINALLY SELECT * FROM rho", N)
query("g02_best_lag", "a:s b:s c1:l", lambda s, d: G.best_lag(rho(s, d)), f"WITH {RHO}\nFINALLY SELECT a, b, lag AS c1 FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY abs(rho) DESC, lag) AS k FROM rho) WHERE k = 1", N)
SIDES = f"{RHO}, z AS (SELECT a, b, sum(CASE WHEN lag <= 0 THEN abs(rho) END) AS l, sum(CASE WHEN lag >= 0 THEN abs(rho) END) AS r, sum(CASE WHEN lag > 0 THEN abs(rho) END) AS up, sum(CASE WHEN lag < 0 THEN abs(rho) END) AS down, max(CASE WHEN lag = 1 THEN rho END) - max(CASE WHEN lag = -1 THEN rho END) AS lag1 FROM rho GROUP BY 1, 2)"
query("g03_signed_mass", "a:s b:s c2:d", lambda s, d: G.signed_mass(rho(s, d)), f"WITH {SIDES}\nFINALLY SELECT a, b, CASE WHEN l > r THEN -l / 3 WHEN r > l THEN r / 3 END AS c2 FROM z", N)
query("g04_cross_functionals", "a:s b:s lag1:d auc:d", lambda s, d: G.cross_functionals(rho(s, d)), f"WITH {SIDES}\nFINALLY SELECT a, b, lag1, sign(up - down) * greatest(up, down) / (up + down) AS auc FROM z", N)
SIG = f"{PAIRS}, i AS (SELECT a, b, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM p WINDOW w AS (PARTITION BY a, b ORDER BY ts)), g AS (SELECT a, b, sum(dx) AS s1, sum(dy) AS s2, sum(x * dx + dx * dx / 2) AS s11, sum(x * dy + dx * dy / 2) AS s12, sum(y * dx + dy * dx / 2) AS s21, sum(y * dy + dy * dy / 2) AS s22 FROM i GROUP BY 1, 2)"
query("g05_signature", "a:s b:s s1:d s2:d s11:d s12:d s21:d s22:d", lambda s, d: G.signature(pairs(s, d), ["a", "b"]), f"WITH {SIG}\nFINALLY SELECT * FROM g", N)
query("g06_levy_area", "a:s b:s levy:d", lambda s, d: G.signature(pairs(s, d), ["a", "b"]), f"WITH {SIG}\nFINALLY SELECT a, b, (s12 - s21) / 2 AS levy FROM g", N)
levy = lambda s, d: G.signature(pairs(s, d), ["a", "b"]).select("a", "b", F.col("levy").alias("v"))
LEVY = f"{SIG}, v AS (SELECT a, b, (s12 - s21) / 2 AS v FROM g), m AS (SELECT a, b, v FROM v UNION ALL SELECT b, a, -v FROM v)"
query("g07_levy_matrix", "a:s b:s v:d", lambda s, d: G.mirrored(levy(s, d)), f"WITH {LEVY}\nFINALLY SELECT * FROM m", N)
MEANS = f"{LEVY}, k AS (SELECT a AS name, avg(v) AS score FROM m GROUP BY a)"
query("g08_row_means", "name:s score:d", lambda s, d: G.row_means(levy(s, d)), f"WITH {MEANS}\nFINALLY SELECT * FROM k", N)
ROLES = f"{MEANS}, o AS (SELECT name, row_number() OVER (ORDER BY score DESC, name) AS u, row_number() OVER (ORDER BY score, name DESC) AS d, count(*) OVER () AS n FROM k), roles AS (SELECT name, CASE WHEN u <= floor(n * 0.2) THEN 'leader' ELSE 'follower' END AS role FROM o WHERE u <= floor(n * 0.2) OR d <= floor(n * 0.2))"
roles = lambda s, d: G.ends(G.row_means(levy(s, d)))
query("g09_leaders_and_followers", "name:s role:s", roles, f"WITH {ROLES}\nFINALLY SELECT * FROM roles", N)
PORT = f"{ROLES}, lead AS (SELECT ts, sign(avg(r)) AS signal, avg(r) AS leaders FROM r JOIN roles USING (name) WHERE role = 'leader' GROUP BY ts), foll AS (SELECT ts, avg(r) AS followers FROM r JOIN roles USING (name) WHERE role = 'follower' GROUP BY ts), port AS (SELECT ts, lag(signal) OVER (ORDER BY ts) * (followers - leaders) AS pnl FROM lead JOIN foll USING (ts))"
query("g10_leader_signal", "ts:t signal:d", lambda s, d: returns(s, d).join(roles(s, d).where("role = 'leader'"), "name").groupBy("ts").agg(F.signum(F.avg("r")).alias("signal")), f"WITH {PORT}\nFINALLY SELECT ts, signal FROM lead", N)
query("g11_follower_portfolio", "ts:t pnl:d", lambda s, d: G.follower_portfolio(returns(s, d), roles(s, d)), f"WITH {PORT}\nFINALLY SELECT * FROM port", N)


def walk_forward(s, d, k=12):
    """Mean Lévy area of each name over its trailing months, at each date."""
    r = returns(s, d)
    dates = r.select("ts").distinct().withColumn("n", F.row_number().over(Window.orderBy("ts")))  # one row a date
    area = G.rolling_levy(pairs(s, d).join(dates, "ts").select("a", "b", "ts", "n", "x", "y"), k)
    both = area.select("ts", "a", F.col("levy").alias("v")).union(area.select("ts", "b", -F.col("levy")))
    return both.groupBy("ts", F.col("a").alias("name")).agg(F.avg("v").alias("score"))


query("g12_walk_forward", "ts:t name:s score:d", walk_forward, f"WITH {PAIRS}, dates AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n FROM (SELECT DISTINCT ts FROM r)), q AS (SELECT a, b, n AS at, x, y FROM p JOIN dates USING (ts)), e AS (SELECT a, b, x, y, at, at + k AS n FROM q, (SELECT unnest(range(0, 12)) AS k)), i AS (SELECT a, b, n, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM e WINDOW w AS (PARTITION BY a, b, n ORDER BY at)), g AS (SELECT a, b, n, (sum(x * dy + dx * dy / 2) - sum(y * dx + dy * dx / 2)) / 2 AS v FROM i GROUP BY 1, 2, 3 HAVING count(*) = 12), m AS (SELECT n, a AS name, v FROM g UNION ALL SELECT n, b, -v FROM g)\nFINALLY SELECT ts, name, avg(v) AS score FROM m JOIN dates USING (n) GROUP BY 1, 2".replace(" AS at,", " AS pl,").replace("y, at, at + k AS n", "y, pl, pl + k AS n").replace("ORDER BY at)", "ORDER BY pl)"), N)
query("g13_complete_assets", "ts:t n:l", lambda s, d: returns(s, d).groupBy("ts").agg(F.count("r").alias("n")).where("n >= 10"), f"WITH {RET}\nFINALLY SELECT ts, count(r) AS n FROM r GROUP BY ts HAVING count(r) >= 10", N)
query("g14_adjacency", "src:s dst:s weight:d", lambda s, d: G.adjacency(levy(s, d)), f"WITH {LEVY}\nFINALLY SELECT a AS src, b AS dst, v AS weight FROM m WHERE v > 0", N)
query("g15_hermitian_clusters", "name:s cluster:l", lambda s, d: G.hermitian_clusters(G.adjacency(levy(s, d)), 3))
query("g16_flow_imbalance", "lo:l hi:l net:d", lambda s, d: G.flow_imbalance(G.adjacency(levy(s, d)), G.hermitian_clusters(G.adjacency(levy(s, d)), 3)))


def cluster_portfolios(s, d):
    """(cluster, ts, pnl): the follower portfolio within each cluster, and pooled as cluster -1."""
    c = G.hermitian_clusters(G.adjacency(levy(s, d)), 2)
    v, out = levy(s, d), None
    for k in (0, 1):
        mine = c.where(F.col("cluster") == k)
        inside = v.join(mine.select(F.col("name").alias("a")), "a").join(mine.select(F.col("name").alias("b")), "b").select("a", "b", "v")
        p = G.follower_portfolio(returns(s, d), G.ends(G.row_means(inside))).withColumn("cluster", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out.unionByName(out.groupBy("ts").agg(F.avg("pnl").alias("pnl")).withColumn("cluster", F.lit(-1)))


query("g17_cluster_portfolios", "cluster:l ts:t pnl:d", cluster_portfolios)
query("g19_detection_rate", "rate:d runs:l", lambda s, d: G.detection_rate(s))  # the rate of the fixed seeds

import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.conftest import prose
from tidemark.llm import quality as Q


def junk(rng, n):
    kind = rng.randrange(3)
    words = prose(rng, n).split()
    if kind == 0:
        return " ".join(w + rng.choice(["###", "&&", "$$$"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w for w in words[: n // 6 + 1] for _ in range(6))


def test_features_against_loops():
    def slow(t):
        out = [0.0] * Q.FEATURES
        if not t:
            return out
        kind = [4, *(int(Q.CLASS[b]) for b in t), 4]
        for a, b in zip(kind, kind[1:]):
            out[a * Q.KINDS + b] += 1 / (len(t) + 1)
        out = [x**0.5 for x in out]
        w = t.split()
        if w:
            n = len(w)
            again = [sum(w[i] == w[i + k] for i in range(n - k)) / n for k in (1, 2, 3)]
            twice = sum(c - 1 for c in Counter(zip(w, w[1:])).values()) / n
            lengths = [len(x) for x in w]
            out[Q.KINDS**2 :] = [*again, twice, sum(x > 24 for x in lengths) / n, min(4, np.log1p(np.mean(lengths))), np.log1p(n) / 12]
        return out

    texts = [b"", b" ", b"a", b"one two two two", "É (x) | 12.5%\n\nÉ (x)".encode(), b"ab " * 40, b"\x00" + b"w" * 5000]
    assert np.allclose(Q.features(texts), [slow(t) for t in texts], atol=1e-6)


def test_risk_slopes():
    """A step of the non-negative risk goes along its numerical derivative where the bad part is positive, and lifts it where it is not."""
    r = np.random.default_rng(0)
    p, u, prior = r.normal(1, 1, (40, 3)), r.normal(0, 1, (60, 3)), 0.6
    caught = []

    class Spy(Q.Network):
        def step(self, z, h, slope, decay=0):
            caught.append((self.forward(z)[1], slope))

    net = Spy(np.concatenate([p, u]))
    Q.nonnegative(net, p, u, prior, epochs=1)
    f, slope = caught[0]
    k = 40

    def risk(f):
        bad = np.logaddexp(0, f[k:]).mean() - prior * np.logaddexp(0, f[:k]).mean()
        return prior * np.logaddexp(0, -f[:k]).mean() + bad if bad >= 0 else -bad

    for i in (0, 7, k, k + 9):
        e = np.zeros(len(f))
        e[i] = 1e-5
        assert abs((risk(f + e) - risk(f - e)) / 2e-5 - slope[i]) < 1e-7
    net.p[3][0] = -9  # all decisions low: the bad part goes below zero for a high prior
    net.p[2] = np.linspace(0, 3, Q.HIDDEN)
    Q.nonnegative(net, p + 9, u, 0.98, epochs=1)
    f, slope = caught[-1]
    assert (slope[:k] >= 0).all() != (slope[:k] < 0).all()


def test_prior():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.85):
        good, bad = r.normal(3, 1, 4000), r.normal(-3, 1, 6000)
        mixed = np.where(r.random(6000) < share, r.normal(3, 1, 6000), bad)
        assert abs(Q.estimate_prior(good, mixed) - share) < 0.05
    assert Q.estimate_prior(np.zeros(0), np.ones(3)) == 0.5


def table(spark, rng, n, path):
    rows, quality = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        rows.append((i, (junk if bad else prose)(rng, rng.randrange(20, 120))))
        if rng.random() < 0.5:
            quality.append((i, int(not bad), 0))
    more = [(None, "x y"), (None, None), (3, ""), (3, rows[3][1]), (n, prose(rng, 60_000)), (n + 1, junk(rng, 40_000)), (n + 2, "é")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, held_out int, good int, x int"
    spark.createDataFrame([(i, t, "en", None, 1, 2, "s", 3, 4, 5) for i, t in rows + more], schema).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([*quality, (None, 1, 0), (5, None, None), *quality[:4]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows + more, quality


def test_held_out(spark, tmp_path):
    rows, quality = table(spark, random.Random(4), 1500, tmp_path)
    got = Q.op13_quality(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    score = {r.doc_id: r.predicted for r in got}
    test = [(i, y) for i, y, _ in quality if held(i) and i != 3]
    assert sum(score[i] == y for i, y in test) >= 0.97 * len(test) and score[1500] == 1 and score[1501] == 0


def test_only_positives_of_the_training_part_are_learned(spark, tmp_path):
    """Labels of held-out rows, and labels 0, change nothing."""
    rng = random.Random(6)
    table(spark, rng, 300, tmp_path)
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    a = Q.fit(docs, labels)
    b = Q.fit(docs.repartition(2), labels.where("quality = 1 AND pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) != 0").repartition(3))
    assert a.prior == b.prior and all((x == y).all() for x, y in zip(a.net.p, b.net.p))


def test_nothing_to_learn(spark, corpus_df, empty_df, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in Q.quality(corpus_df, none).collect()} == {0.5}
    assert Q.quality(empty_df, none).count() == 0
    assert Q.quality(corpus_df, spark.createDataFrame([(0, 1), (11, 1)], "doc_id long, quality int")).count() == len(corpus)

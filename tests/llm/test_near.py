import random

import numpy as np
import pyarrow as pa

from tidemark.llm import stages as C
from tests.llm.conftest import prose
from tidemark.llm import near as N


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """The ids that stay: the smallest of each group linked by a similarity of 0.8."""
    s, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in s:
        for j in s:
            if i < j and (s[i] == s[j] or 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {find(i) for i in s}


def edited(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def planted():
    rng = random.Random(8)
    bases = [prose(rng, 200) for _ in range(24)]
    passage = prose(rng, 120)
    texts = [*bases, *(edited(rng, b, k) for b in bases for k in (1, 2, 4, 5, 8)), *(passage + " " + prose(rng, n) for n in range(4, 60, 4))]
    texts += [None, "", "one two", "ONE two", "one two three four five", "one two three four", *(" ".join(f"w{j}" for j in range(n)) for n in range(5, 16))]
    return list(enumerate(texts))


def test_planted_near_copies(spark, tmp_path):
    """Copies with 1 to 8 of 200 words changed: every pair of 0.8 or more is found, no other."""
    rows = planted()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.doc_id for r in C.near_duplicates(spark, docs, "").collect())
    assert got == sorted(brute(rows)) and not any(24 <= i < 24 * 6 and (i - 24) % 5 < 3 for i in got)


def test_filters_lose_no_pair():
    rng = random.Random(9)
    frequent = np.sort(N.shingle_sets([prose(rng, 300).encode()])[0])
    for _ in range(300):
        base = prose(rng, rng.randrange(5, 400))
        a, b = N.shingle_sets([base.encode(), edited(rng, base, rng.randrange(1, 2 + len(base.split()) // 40)).encode()])
        if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
            assert np.intersect1d(N.prefix(a, frequent), N.prefix(b, frequent)).size
            assert N._close(len(a), N.fingerprint(a), len(b), N.fingerprint(b))


def test_long_words(spark, tmp_path):
    """Words that a sum modulo 2**64 cannot tell apart, alone and behind others."""
    def thue_morse(n):
        x = "a"
        while len(x) < n:
            x += x.translate({97: 98, 98: 97})
        return x

    one = thue_morse(2048)
    other, short = one.translate({97: 98, 98: 97}), thue_morse(1024)
    rows = list(enumerate([one, other, f"p q r s t u v {short}", f"p q r s t u v {short.translate({97: 98, 98: 97})}", one, "x " * 40_000 + one]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.doc_id for r in C.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), "").collect())
    assert got == sorted(brute(rows)) == [0, 1, 2, 3, 5]


def test_blocks_of_the_fingerprint(spark, tmp_path, monkeypatch):
    """Fingerprints that differ in fewer bits than there are blocks meet, and near copies are found by their blocks alone."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, (500, 2), dtype=np.uint64)
    for k in range(N.BLOCKS):
        flipped = prints.copy()
        for x in flipped:
            for bit in rng.choice(128, k, replace=False):
                x[bit // 64] ^= np.uint64(1 << int(bit) % 64)
        assert (N.blocks(prints) == N.blocks(flipped)).any(axis=1).all()
    assert len(np.unique(N.blocks(prints[:100]))) == 100 * N.BLOCKS
    rng = random.Random(11)
    bases = [prose(rng, 2000) for _ in range(30)]
    rows = list(enumerate([*bases, *(edited(rng, b, 1) for b in bases)]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = N.prefix
    monkeypatch.setattr(N, "prefix", lambda shingles, frequent: own(shingles, frequent)[:0])
    tokens = N._tokens(spark.sparkContext.broadcast(b""))
    batches = list(tokens(spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("text", "doc_id").toArrow().to_batches()))
    table = pa.Table.from_batches(batches).sort_by("token")
    pairs = {(min(u, v), max(u, v)) for b in N._links(iter(table.to_batches())) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert pairs == {(i, i + 30) for i in range(30)}

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import vector_codes as V


@given(st.integers(1, 40), st.integers(1, 60), st.integers(1, 5), st.sampled_from([1, 3, 100, V.BOUND]), st.integers(0, 9999))
@settings(max_examples=200, deadline=None)
def test_search_equals_a_full_scan(k, n, width, spread, seed):
    r = np.random.default_rng(seed)
    book, x = r.integers(-spread, spread + 1, (k, width)), r.integers(-spread, spread + 1, (n, width))
    index, error, _ = V.Codebook(book).nearest(x, r.integers(0, k, n))
    full = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (error == full.min(axis=1)).all()


def test_radius_saves_distances():
    r = np.random.default_rng(3)
    centres = r.integers(-9000, 9000, (256, 8))
    x = centres[r.integers(0, 256, 4000)] + r.integers(-50, 50, (4000, 8))
    index, _, full = V.Codebook(centres).nearest(x, np.zeros(4000, np.int64))
    again, _, scanned = V.Codebook(centres).nearest(x, index)
    assert (again == index).all() and scanned < full / 20


def brute(rows, parts, entries, rounds):
    kept = [(i, l, [max(-V.BOUND, min(V.BOUND, math.floor(1024 * float(np.float32(x))))) for x in v]) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(kept[0][2])
    edges = [d * i // parts for i in range(parts + 1)]
    fit = [r for r in kept if len(r[2]) == d]
    books = [[r[2][a:b] for r in kept[:entries] if len(r[2]) == d] for a, b in zip(edges, edges[1:])]
    dist = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c))
    for k in range(rounds + 1):
        codes = [[min((dist(r[2][a:b], c), e) for e, c in enumerate(books[p])) for p, (a, b) in enumerate(zip(edges, edges[1:]))] for r in fit]
        if k == rounds:
            break
        for p, (a, b) in enumerate(zip(edges, edges[1:])):
            groups = defaultdict(list)
            for r, c in zip(fit, codes):
                groups[c[p][1]].append(r[2][a:b])
            for e, g in groups.items():
                books[p][e] = [sum(x) // len(g) for x in zip(*g)]
    out = [(r[0], r[1], bytes(e for _, e in c), sum(x for x, _ in c)) for r, c in zip(fit, codes)]
    return out + [(r[0], r[1], None, None) for r in kept if len(r[2]) != d], hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int, error string, entry int"


@pytest.mark.parametrize("d,parts,entries", [(8, 4, 5), (7, 4, 256), (4, 2, 3)])
def test_against_brute_force(spark, d, parts, entries):
    rng = random.Random(d)
    rows = [(i, [rng.choice([-0.5, 0.25, 3.0]) + rng.randrange(4) / 64 for _ in range(d)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [rows[3]] * 2 + [(3, [9.0] * d, 1), (None, [1.0] * d, None), (None, [2.0] * d, 2), (70, None, 1), (71, [1.0] * (d - 1) + [None], 1)]
    rows += [(72, [float("nan")] * d, 1), (73, [float("-inf")] * d, 1), (74, [1.0] * (d + 1), 1), (75, [], 2), (76, [1e30] * d, 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(3)
    codes, books = V.vector_codes(df, parts=parts, entries=entries)
    want, sha = brute(rows, parts, entries, 4)
    assert Counter((r.vec_id, r.label, None if r.code is None else bytes(r.code), r.error) for r in codes.collect()) == Counter(want)
    assert V.digest(books) == sha


def test_query(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 3 or None) for i in range(400)]
    spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = V.op12_vector_codes(spark, str(tmp_path)).collect()
    want, sha = brute(rows, 4, 256, 4)
    total = Counter()
    for _, label, _, e in want:
        total[label] += e
    assert Counter(map(tuple, got)) == Counter((i, c.hex(), e, total[l], sha) for i, l, c, e in want)


def test_empty(spark, tmp_path):
    spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = V.op12_vector_codes(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]

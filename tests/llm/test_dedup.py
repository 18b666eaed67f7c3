import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from tidemark.llm import exact_dedup as E, simhash as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@given(st.lists(st.integers(0, 2**44 - 1), max_size=300, unique=True))
@settings(max_examples=60, deadline=None)
def test_golomb_round_trip(values):
    v = np.array(sorted(values), np.uint64)
    assert (E.golomb_decode(E.golomb_encode(v, 44)) == v).all()


def test_exact_matches_brute_force(corpus_df, corpus):
    got = E.exact_dedup(corpus_df).collect()
    groups = defaultdict(list)
    for i, t in corpus:
        groups[(t or "").translate(LOWER)].append(i)
    want = Counter((i, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_null_ids_and_empty(spark, empty_df):
    df = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = E.exact_dedup(df).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got)[-1] == (3, 3, 3, True)
    assert sum(r.kept for r in got) == 2
    assert E.exact_dedup(empty_df).count() == 0


def brute_print(text):
    words = (text or "").translate(LOWER).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """pairs: (doc_id, fingerprint); the smallest id reachable."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f): least[find(f)] for i, f in pairs}


def test_simhash_matches_brute_force(corpus_df, corpus, empty_df):
    pairs = [(i, brute_print(t)) for i, t in corpus]
    want = brute_components(pairs)
    got = S.simhash_groups(corpus_df).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", want[i, f]) for i, f in pairs)
    assert S.simhash_groups(empty_df).count() == 0


def test_links_of_hot_buckets(spark, monkeypatch):
    """Chains and balls of fingerprints, with tiles far smaller than the buckets."""
    monkeypatch.setattr(S, "CHUNK", 7)
    rng = random.Random(3)
    prints = {0, 1, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
            prints.add(x)
    pairs = list(enumerate(sorted(prints)))
    stage = S.Stage(spark, "test")
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in pairs], "fp long")
    links = S.near_links(nodes, stage)
    roots = {r.node: r.root for r in S.components(links, stage).collect()}
    want = brute_components(pairs)
    by_want, by_got = defaultdict(set), defaultdict(set)
    for i, f in pairs:
        s = f - (1 << 64) if f >> 63 else f
        by_want[want[i, f]].add(s)
        by_got[roots.get(s, s)].add(s)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))

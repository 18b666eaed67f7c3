import math
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import prose
from tidemark.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@given(st.lists(st.text(st.sampled_from("aZ0 ,_é\x00\x7f{[`@ß語"), max_size=12), max_size=6))
@settings(max_examples=300, deadline=None)
def test_words(texts):
    found, n = R.words([t.encode() for t in texts])
    assert [w.decode() for w in found.to_pylist()] == [w for t in texts for w in terms(t)]
    assert n.tolist() == [len(terms(t)) for t in texts]


@given(st.lists(st.lists(st.integers(1, 60), min_size=1, max_size=14), min_size=1, max_size=7), st.integers(1, 6), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_blocks_are_the_best_ones(lists, longest, price):
    def least(x):
        cost = [0]
        for i in range(1, len(x) + 1):
            cost.append(min(cost[j] + price + sum(max(x[j:i]) - v for v in x[j:i]) for j in range(max(0, i - longest), i)))
        return cost[-1]

    flat = np.array([v for x in lists for v in x])
    ends = R.cut_blocks(flat, np.array([len(x) for x in lists]), longest, price).tolist()
    total, at = 0, 0
    for e in ends:
        part = flat[at:e]
        total += price + int((part.max() - part).sum())
        assert 0 < len(part) <= longest
        at = e
    edges = set(np.cumsum([len(x) for x in lists]).tolist())
    assert at == len(flat) and edges <= set(ends) and total == sum(map(least, lists))


def brute(docs, items, top=10):
    words = [(i, Counter(terms(t))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    big, long = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        wanted = [t for t in set(terms(text)) if t in df]
        scored = []
        for i, c in words:
            m = 10 + 90 * sum(c.values()) * big // long
            s = sum(math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return Counter(out)


def test_against_brute_force(spark, corpus, corpus_df, empty_df, monkeypatch):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(1, 30))) for i in range(60)] + [(3, "loop"), (3, "one"), (None, "one two"), (61, None), (62, ""), (63, "nowhere"), (64, corpus[0][1])]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in items], "item_id long, text string, query string, rank int, score int")
    docs = [*corpus, (None, "one two"), (None, "two one")]
    df = corpus_df.select("doc_id", "text").unionByName(spark.createDataFrame(docs[-2:], "doc_id long, text string"))
    want = brute(docs, items)
    got = R.ranked_search(df, frame)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and Counter(map(tuple, got.collect())) == want
    # shards of a few documents, and queries block by block
    monkeypatch.setattr(R, "QUERIES", 25)
    assert Counter(map(tuple, R.ranked_search(df, frame).collect())) == want
    assert R.ranked_search(empty_df, frame).count() == 0 == R.ranked_search(df, frame.limit(0)).count()


def test_one_shard_at_a_time(spark, corpus_df, monkeypatch):
    """A task of many shards holds one of them: where they are written, where files are read, and in Python."""
    monkeypatch.setattr(R, "SHARD", 500)
    docs, sizes = corpus_df.coalesce(1), []
    files = list(Path(R.build(docs).table._tidemark_path.removeprefix("file:")).glob("*.parquet"))
    for f in map(pq.ParquetFile, files):
        sizes += [f.metadata.row_group(k).num_rows for k in range(f.num_row_groups)]
    assert len(files) == 1 and len(sizes) > 20 and set(sizes) == {1}

    def sizes_of_batches(column):
        def run(batches):
            for k, b in enumerate(batches):
                yield pa.RecordBatch.from_pydict({n: pa.array([v], pa.int64()) for n, v in zip(column, (0, b.num_rows, k + 1))})

        return run

    monkeypatch.setattr(R, "_frequencies", lambda vocabulary: sizes_of_batches(("term", "df")))
    monkeypatch.setattr(R, "_searcher", lambda plan, top: sizes_of_batches(("query", "doc_id", "score")))
    found = R.ranked_search(docs, spark.createDataFrame([(1, "alpha1")], "item_id long, text string")).collect()
    assert [r.doc_id for r in found] == [1] * R.TOP


def test_shards_skip_and_find_all():
    """Shard by shard with one threshold, as in a task: the best of all, and far fewer documents scored than there are."""
    rng = random.Random(3)
    some, often = [f"w{i}" for i in range(3000)], [1 / (i + 3) for i in range(3000)]
    docs = [(i, " ".join(rng.choices(some, often, k=rng.randrange(20, 120)))) for i in range(4000)]
    items = [(q, " ".join(rng.sample(docs[rng.randrange(4000)][1].split(), 12))) for q in range(25)]
    want = brute(docs, items)
    count = Counter(t for _, d in docs for t in set(terms(d)))
    length = sum(len(terms(d)) for _, d in docs)
    shards = []
    for a in range(0, 4000, 800):
        part = docs[a : a + 800]
        rows = R.shard_row(0, [i for i, _ in part], [t.encode() for _, t in part], 4000, length)
        shards.append(R.Shard({n: rows.column(k)[0] for k, n in enumerate(rows.schema.names)}))
    got, scored = Counter(), 0
    for q, text in items:
        best, known = [], [t for t in R.query_terms(text) if count[t.decode()]]
        w = np.array([R.weight(4000, count[t.decode()]) for t in known], np.int64)
        for s in shards:
            at = s.places(R.pa.array(known, R.pa.binary()))
            scored += s.search(at[at >= 0], w[at >= 0], best)
        got.update((q, k + 1, i, x) for k, (x, _, i) in enumerate(best))
    assert got == want and scored < 25 * 4000 / 5


def test_query(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, prose(rng, 40)) for i in range(300)] + [(300, prose(rng, 50_000)), (301, None)]
    items = [(i, prose(rng, 9)) for i in range(20)]
    spark.createDataFrame([(*d, "l", 3, "s") for d in docs], "doc_id long, text string, item_id string, rank int, score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert Counter(map(tuple, R.op11_ranked_search(spark, str(tmp_path)).collect())) == brute(docs, items)

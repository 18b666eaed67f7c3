import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as P


@given(st.lists(st.sampled_from(["word", "Don't", " ", "  ", "\n", "\t", "é", "x1", "!?", " ", " ", "<|endoftext|>", "12", "\x1c", "日本", "ʰa", "ǅ", "word,", "don.", "x!", "é|", "ª,", "a\u0301", "x'!'", "Y's", "\u2003", "\xa0", "a_b_"]), max_size=14))
@settings(max_examples=300, deadline=None)
def test_ids_by_parts_equal_whole(parts):
    text = "".join(parts)
    e = P.encoder(P.tokenizer_path(), P.tokenizer_path("byte_bpe_50k.tiktoken"))
    more = [text, "a b", "", text + " end", " " + text]
    for got in (e.ids(more), e.ids_of([x.encode() for x in more])):
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in more]


@given(st.lists(st.text(st.characters(categories=["Lu", "Ll", "Lt", "Lm", "Lo"]), min_size=1, max_size=6), max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_letters(words):
    """The fast path for letters uses a second library, whose table of letters must not matter."""
    text = " ".join(words)
    e = P.encoder(P.tokenizer_path(), P.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert [np.frombuffer(g, "<u4").tolist() for g in e.ids_of([text.encode()])] == [e.tokenizer.encode(text, add_special_tokens=False).ids]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 400), min_size=1, max_size=20))
@settings(max_examples=40, deadline=None)
def test_plan_places_every_rank_once(histogram):
    rows, n = P.plan(histogram, 64)
    seen, used = {}, np.zeros((n, 64), bool)
    for length, total in histogram.items():
        mine = rows[rows[:, 0] == length]
        for rank in range(total):
            r = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            i = rank - r[1]
            s, o = r[3] + i // r[2], r[4] + i % r[2] * length
            assert not used[s, o : o + length].any() and o + length <= 64
            used[s, o : o + length] = True


def sequences(counts, rows, n, capacity):
    """Fails unless each rank of each length has its own place; returns the number of used sequences."""
    used = np.zeros((n, capacity), bool)
    for length, count in counts.items():
        mine = rows[rows[:, 0] == length]
        for rank in range(count):
            r = mine[np.searchsorted(mine[:, 1], rank, "right") - 1]
            i = rank - r[1]
            s, o = r[3] + i // r[2], r[4] + i % r[2] * length
            assert not used[s, o : o + length].any() and o + length <= capacity
            used[s, o : o + length] = True
    return int(used.any(axis=1).sum())


def bound(histogram, capacity):
    counts = np.zeros(capacity, np.int64)
    for k, v in histogram.items():
        counts[k - 1] = v
    return P.solve(counts, capacity)


def test_linear_program_is_close_to_the_bound():
    rng = np.random.default_rng(1)
    for n in (3_000, 40_000, 120_000):
        histogram = {int(k): int(v) for k, v in zip(*np.unique(np.clip(rng.lognormal(5.6, 0.8, n).astype(int), 1, 1024), return_counts=True))}
        _, found = P.plan(histogram)
        least = max(bound(histogram, 1024)[1], sum(a * b for a, b in histogram.items()) / 1024)
        assert least <= found <= 1.002 * least + 3


@given(st.dictionaries(st.integers(1, 48), st.integers(1, 2_000), min_size=1, max_size=12))
@settings(max_examples=25, deadline=None)
def test_program_places_every_piece(histogram):
    """Many pieces of few lengths: nearly all go by the program's configurations, not by best fit."""
    used, least = bound(histogram, 48)
    for length, count in histogram.items():
        assert abs(sum(n * c.count(length) for c, n in used.items()) - count) < 1e-3 * count + 1e-6
    assert all(sum(c) <= 48 for c in used) and least <= sum(used.values()) + 1e-6
    rows, n = P.plan(histogram, 48)
    assert sequences(histogram, rows, n, 48) == n >= least - 1e-6


def test_pack(corpus_df, corpus, empty_df):
    t = Tokenizer.from_file(P.tokenizer_path())
    got = P.pack(corpus_df).collect()
    want = {}
    for i, text in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[i] = ids
    for r in got:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(ids) == r.ids_crc32 and r.length <= 1024
    assert sorted((r.doc_id, r.row, r.piece, r.start, r.length) for r in got) == sorted((i, row, k, *p) for i, row in {(r.doc_id, r.row) for r in got} for k, p in enumerate(P.cut(len(want[i]))))
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    assert len(got) >= len(corpus) and P.pack(empty_df).count() == 0


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Each row of the result of a Python step that only counts is the size of a batch; the session keeps its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(*_):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pylist([{"doc_id": 0, "row": 0, "piece": 0, "start": 0, "length": b.num_rows, "ids_crc32": 0, "task": 0, "rank": 0}], P.ARROW_PIECES)

        return run

    monkeypatch.setattr(P, "_pieces", sizes)
    monkeypatch.setattr(P, "TEXTS", 7)
    docs = spark.createDataFrame([(i, "a") for i in range(100)], "doc_id long, text string").coalesce(1)
    got = [r.length for r in P.pack(docs).collect()]
    assert max(got) == 7 and sum(got) == 100 and spark.conf.get(key) == before

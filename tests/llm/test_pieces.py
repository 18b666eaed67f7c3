import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings, strategies as st

from tidemark.llm import pieces as P

PATH = P.model_path()
TEXTS = ["Hello  world\n a", "  x ", "a\tb", "日本語 ok", "▁a", "\x00 b", " " * 40 + "end", "a" * 300, "ab" * 200 + " c", "Donaudampfschifffahrtsgesellschaft!!", "été où ça", "x" * 47 + "y" * 3]


@given(st.one_of(st.text(max_size=20), st.lists(st.sampled_from("the ing er st tion an Ab un be 1 , . ▁ é".split()), max_size=9).map("".join)))
@settings(max_examples=400, deadline=None)
def test_fold_equals_library(text):
    m, sp = P.model(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    parts, which, sizes = P.cut(m, ["x", text, ""])
    assert sizes[0] == 1 and sizes[2] == 0
    if "\x00" not in text:
        assert [i for k in which[1:] for i in m.ids(parts[k])] == sp.encode(text)


def test_neighbours_equal_merging():
    m, rng = P.model(PATH), random.Random(6)
    some = [m.id[p] for p in rng.sample(sorted(m.stable), 1500)] + [m.id[p] for p in m.stable if len(p) < 3 and p.isascii()]
    a, b = np.array(rng.choices(some, k=20_000)), np.array(rng.choices(some, k=20_000))
    want = [m.merge(m.pieces[x] + m.pieces[y])[0] == [m.pieces[x], m.pieces[y]] for x, y in zip(a, b)]
    assert m.neighbours(a, b).tolist() == want and 0 < sum(want) < len(want)


def test_encode_and_decode(spark, corpus, empty_df):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    more = [" ".join("".join(rng.choices("th er an on in re tion ing é ß".split(), k=rng.randrange(1, 6))) for _ in range(60)) for _ in range(30)]
    rows = list(enumerate([*TEXTS, *more])) + [(i + 1000, t) for i, t in corpus]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'p' as part", "1 as chunk", "2 as n").repartition(3)
    encoded = P.encode(df)
    got = sorted((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == sorted((i, tuple(sp.encode(t or ""))) for i, t in rows)
    back = {r.doc_id: r.text for r in P.decode(encoded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert P.encode(empty_df).count() == 0
    digests = P.encode(df, then=(P._digest(PATH), P.DIGEST)).collect()
    summed = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    hashed = lambda t: hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()
    assert sorted(map(tuple, digests)) == sorted((i, len(e), summed(e), hashed(t)) for i, t in rows for e in [sp.encode(t or "")])


def test_ids_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(P, "MOST_IDS", 3)
    rows = [[1, 2], None, [], [3], [4, 5, 6, 7, 8], [], [9]]
    got = list(P.id_runs(pa.array([[0], *rows], pa.list_(pa.int32())).slice(1)))
    assert [x if x is None else x.tolist() for *_, run in got for x in run] == rows
    assert [(a, b) for a, b, _ in got] == [(0, 4), (4, 5), (5, 7)]


def test_tasks_follow_the_parts(spark, monkeypatch):
    """Not their bytes, of which they have few; and nothing that is over stays in the shared folder."""
    monkeypatch.setattr(P, "TASK_PARTS", 2)
    rows = [(i, f"word{i} other{7 * i}") for i in range(100)]
    tasks, dropped, lattice, drop = [], [], P.lattice, P.Stage.drop
    monkeypatch.setattr(P, "lattice", lambda parts, path: tasks.append((parts.count(), parts.rdd.getNumPartitions())) or lattice(parts, path))
    monkeypatch.setattr(P.Stage, "drop", lambda self, *tables: dropped.extend(t._tidemark_path.rpartition("_")[2] for t in tables) or drop(self, *tables))
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = P.encode(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == [(i, sp.encode(t)) for i, t in rows]
    (n, number), = tasks
    assert number == n // 2 + 1 > 4 and dropped == ["parts", "ids"]


def test_digests_slice_by_slice(spark, monkeypatch):
    """One slice of the documents is shuffled at a time and goes before the next; the messages go before all of them."""
    monkeypatch.setattr(P, "CHUNK_PARTS", 8)
    monkeypatch.setattr(P, "TOGETHER", 64)
    monkeypatch.setattr(P, "SLICES", 3)
    gone, drop_part = [], P.Stage.drop_part
    monkeypatch.setattr(P.Stage, "drop_part", lambda self, t, by, k: gone.append((t._tidemark_path.rpartition("_")[2], k)) or drop_part(self, t, by, k))
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i % 90 or None, f"word{i} other{7 * i} " * 3 if i % 11 else None) for i in range(120)]
    schema = "doc_id long, n long"
    count = lambda t: pa.table({"doc_id": t.column("doc_id"), "n": pa.array([len(x) for x in t.column("ids").to_pylist()], pa.int64())})
    got = P.encode(spark.createDataFrame(rows, "doc_id long, text string"), then=(count, schema)).collect()
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(sp.encode(t or ""))) for i, t in rows), key=key)
    assert gone == [("cut", P.MESSAGES), *((t, k) for k in range(3) for t in ("cut", "answers"))]

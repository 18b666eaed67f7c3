import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.llm.conftest import prose
from tests.llm.test_dedup import LOWER
from tests.llm.test_near import brute as near_groups
from tests.llm.test_substring import brute as substring
from tidemark.llm import packing as P, stages as S, toxicity as T

SCHEMA = "doc_id long, text string, lang string, n_chars long, row long, _tidemark_file int, spans string, first string, m long"


def written(spark, rows, path, schema=SCHEMA, files=3):
    spark.createDataFrame([(i, t, "en", len(t or ""), 7, 1, "s", "f", 3) for i, t in rows] if schema == SCHEMA else rows, schema).repartition(files).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def keys(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def kept_exactly(rows):
    best = {}
    for i, t in rows:
        k = (t or "").translate(LOWER)
        best[k] = max(best.get(k, -1), -1 if i is None else i)
    return Counter(best.values())


def test_stages_against_brute_force(spark, corpus, tmp_path):
    rows = sorted(dict(corpus).items())
    docs = written(spark, rows, tmp_path)
    exact = S.exact_copies(spark, docs, "")
    assert Counter(r.doc_id for r in exact.collect()) == kept_exactly(rows) and exact.columns == docs.columns
    near = S.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in near.collect()) == sorted(near_groups(rows)) and near.columns == docs.columns
    cut = S.repeated_passages(spark, docs, "")
    assert cut.schema == docs.schema
    cut, texts = {r.doc_id: r for r in cut.collect()}, dict(rows)
    for i, n, gone, _ in substring([(i, i, t) for i, t in rows]):
        assert cut[i].text == texts[i] if not gone else len(cut[i].text.split()) == n - gone and cut[i].n_chars == len(cut[i].text)
    assert set(cut) == set(texts)


def test_null_and_repeated_ids_are_documents_of_their_own(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, prose(rng, 40)), (None, prose(rng, 40)), (7, prose(rng, 40)), (7, prose(rng, 40)), (7, None), (None, "")]
    docs = written(spark, rows, tmp_path)
    words = Counter((i, t) for i, t in rows if t)
    assert keys(S.near_duplicates(spark, docs, "")) == words + Counter({(None, ""): 1})  # null before any other id
    assert keys(S.exact_copies(spark, docs, "")) == words + Counter({(7, None): 1})
    assert keys(S.repeated_passages(spark, docs, "")) == Counter(rows)
    twice = written(spark, rows[:4] * 2, f"{tmp_path}/twice")
    assert keys(S.near_duplicates(spark, twice, "")) == words == keys(S.exact_copies(spark, twice, ""))


def test_toxicity_rows(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join([*prose(rng, 30).split(), *["grobnik"] * (i % 6 == 0)])) for i in range(400)] + [(None, "grobnik"), (None, None), (401, ""), (401, "a grobxnik b"), (5, prose(rng, 9))]
    frame = written(spark, docs, tmp_path)
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scored = Counter(r.doc_id for r in T.toxicity(frame, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.predicted == 0)
    left = S.toxicity(spark, frame, str(tmp_path))
    assert left.schema == frame.schema and Counter(r.doc_id for r in left.collect()) == scored
    assert keys(left) == Counter((i, t) for i, t in docs if "grob" not in (t or ""))


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES])
def test_empty_table(spark, tmp_path, stage):
    docs = written(spark, [], tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() == 0 and (stage is S.packing or out.columns == docs.columns)


def test_run_against_brute_force(spark, corpus, tmp_path):
    """Without labels nothing is toxic; the other stages one after the other, then the ids of every piece."""
    rows = list(dict(corpus).items())
    written(spark, [(i, t, "x") for i, t in rows], tmp_path, "doc_id long, text string, note string")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    exact = kept_exactly(rows)
    left = [(i, t) for i, t in rows if i in exact]
    near = near_groups(left)
    left = sorted((i, t) for i, t in left if i in near)
    gone = {i: n for i, _, n, _ in substring([(i, i, t) for i, t in left])}
    out, got = C.run(spark, str(tmp_path)).collect(), {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {i for i, _ in left} and max(r.offset + r.length for r in out) <= P.CAPACITY
    t = Tokenizer.from_file(P.tokenizer_path())
    for i, text in left:
        if not gone[i]:
            ids = [*t.encode(text or "", add_special_tokens=False).ids, P.END]
            assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(got[i], key=lambda r: r.piece)] == [(k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for k, (s, n) in enumerate(P.cut(len(ids)))]
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= P.CAPACITY



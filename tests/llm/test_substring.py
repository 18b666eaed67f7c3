import hashlib
from collections import Counter

from tidemark.llm import substring_dedup as D


def brute(rows, w=20):
    """rows: (order key, id, text)."""
    seen, out = set(), []
    for _, i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = set()
        for s in range(len(words) - w + 1):
            g = tuple(words[s : s + w])
            if g in seen:
                gone.update(range(s, s + w))
            seen.add(g)
        kept = b" ".join(x for j, x in enumerate(words) if j not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def result(df, **more):
    return Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in D.substring_dedup(df, **more).collect())


def test_matches_brute_force(corpus_df, corpus):
    assert result(corpus_df) == Counter(brute([((i, n), i, t) for n, (i, t) in enumerate(corpus)]))


def test_null_ids_ties_and_empty(spark, empty_df):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(2, text), (None, text), (1, "x " + text), (1, text[:-3])], "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.n_words): r.n_removed for r in D.substring_dedup(df).collect()}
    assert got == {(None, 30): 0, (2, 30): 30, (1, 31): 30, (1, 29): 29}
    assert D.substring_dedup(empty_df).count() == 0


def test_periodic_text(spark):
    rows = [(1, "a " * 25), (2, "a b " * 30 + "c " * 5), (3, "b a " * 12), (4, "a " * 21 + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == Counter(brute([(i, i, t) for i, t in rows]))


def test_words_that_collide_modulo_2_64(spark):
    """Thue-Morse words of both signs have equal sums for any odd base; the rest of the texts does repeat."""
    for bits in (10, 11, 12):
        one = "".join("ab"[i.bit_count() & 1] for i in range(1 << bits))
        texts = [" ".join([*(f"p{i}" for i in range(15)), w, *(f"q{i}" for i in range(14))]) for w in (one, one.translate(str.maketrans("ab", "ba")))]
        rows = list(enumerate(texts)) + [(2, " ".join(f"q{i}" for i in range(14)) + " end " * 9), (3, texts[1] + " tail " + texts[0])]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(df) == Counter(brute([(i, i, t) for i, t in rows]))


def test_joins_instead_of_bitmaps(corpus_df, corpus, monkeypatch):
    monkeypatch.setattr("tidemark.llm.common.MOST_ONES", -1)
    monkeypatch.setattr("tidemark.llm.common.MOST_ROWS", -1)
    assert result(corpus_df) == Counter(brute([((i, n), i, t) for n, (i, t) in enumerate(corpus)]))


def test_rows_keep_their_numbers_in_other_splits(spark, corpus, tmp_path):
    """Files read again in other splits, as after the loss of an executor."""
    from tidemark.llm.common import Stage, numbered

    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).write.parquet(path)
    docs, key, before = spark.read.parquet(path), "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    stage = Stage(spark, "test")
    try:
        seen = []
        for size in ("128m", "1k"):
            spark.conf.set(key, size)
            seen.append(Counter((r.row, r.doc_id, r.text) for r in numbered(spark.read.parquet(path), stage, "doc_id", "text", scan=True).collect()))
        assert seen[0] == seen[1] and len({r for r, *_ in seen[0]}) == len(corpus)
    finally:
        spark.conf.set(key, before)
    assert result(docs, scan=True) == Counter(brute([((i, n), i, t) for n, (i, t) in enumerate(corpus)]))

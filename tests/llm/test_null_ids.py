"""Null ids, repeated rows, a very long text and columns of clashing names, for the operators that only map documents."""

from collections import Counter

import pytest

from tidemark.llm import flac, packing, pieces, simhash, token_counts

ROWS = [(None, "one two three"), (None, "one two three"), (None, None), (4, "one two three"), (4, "one two three"), (5, ""), (6, "long text " * 30_000)]
OPERATORS = {
    "simhash": (simhash.simhash_groups, lambda r: r.fingerprint),
    "packing": (packing.pack, lambda r: (r.piece, r.start, r.length, r.ids_crc32)),
    "pieces": (pieces.encode, lambda r: tuple(r.ids)),
    "token_counts": (token_counts.token_counts, lambda r: (r.n_words, r.n_tokens)),
    "media": (flac.media_column, lambda r: (r.n_bytes, bytes(r.media))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_its_result(spark, name):
    run, value = OPERATORS[name]
    df = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as row", "2 as piece", "'x' as ids", "3 as media", "4 as fingerprint", "5 as chunk", "6 as n_bytes").repartition(2)
    got = run(df).collect()
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.row), []).append(value(r))
    assert Counter(i for i, _ in by) == Counter(i for i, _ in ROWS)
    texts = Counter(tuple(sorted(v)) for (i, _), v in by.items())
    assert sorted(texts.values()) == [1, 2, 4]  # the long text, null and empty, the four equal ones
    if name == "simhash":
        groups = {(r.doc_id, r.component_id) for r in got}
        assert groups == {(None, 4), (4, 4), (None, 5), (5, 5), (6, 6)}

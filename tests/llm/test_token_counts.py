from collections import Counter

import public_tokenizers
from hypothesis import given, settings, strategies as st

from tidemark.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(vocabulary, word):
    n, at = 0, 0
    while at < len(word):
        at = next(e for e in range(len(word), at, -1) if word[at:e] in vocabulary)
        n += 1
    return n


@given(st.sets(st.text("abc", min_size=2, max_size=7), max_size=25), st.text("abcd", max_size=40))
@settings(max_examples=300, deadline=None)
def test_small_vocabularies(pieces, word):
    vocabulary = {bytes([b]) for b in range(256)} | {p.encode() for p in pieces}
    assert T.Automaton(vocabulary).count(word.encode()) == greedy(vocabulary, word.encode())


def test_counts(corpus_df, corpus, empty_df):
    vocabulary = set(T.read_ranks(PATH))
    got = Counter((r.doc_id, r.n_words, r.n_tokens) for r in T.token_counts(corpus_df).collect())
    assert got == Counter((i, len(w), sum(greedy(vocabulary, b" " + x) for x in w)) for i, t in corpus for w in [(t or "").encode().split()])
    assert T.token_counts(empty_df).count() == 0

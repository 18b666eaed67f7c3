"""Greedy longest-match token counts by a linear automaton.

The vocabulary's trie gets a failure link for each node: where the walk goes on when no child fits, and how many
pieces that step pops off the front. The counts of popped pieces are precomputed, so a word's number of pieces comes
from one walk over its bytes, without backing up and without building the pieces.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import batch, keyed, utf8_groups

#: Texts are taken together up to so many bytes; words are remembered up to so many.
TOGETHER, _CACHE = 4 << 20, 500_000


class Automaton:
    """Counts of pieces by longest match from the left; the vocabulary must have every single byte."""

    def __init__(self, pieces):
        child, final, parent, byte = {}, [False], [0], [0]
        for piece in pieces:
            node = 0
            for b in piece:
                key = node << 8 | b
                node = child.get(key)
                if node is None:
                    node = child[key] = len(final)
                    final.append(False)
                    parent.append(key >> 8)
                    byte.append(b)
            final[node] = True
        if not all(final[child[b]] for b in range(256) if b in child) or any(b not in child for b in range(256)):
            raise ValueError("a byte has no piece of its own")
        depth = [0] * len(final)
        for v in range(1, len(final)):
            depth[v] = depth[parent[v]] + 1
        fail, pops = [0] * len(final), [0] * len(final)
        for v in sorted(range(1, len(final)), key=depth.__getitem__):
            if final[v]:
                pops[v] = 1  # the node itself is a piece; go on at the root
                continue
            z, popped = fail[parent[v]], pops[parent[v]]
            while (z << 8 | byte[v]) not in child:
                popped += pops[z]
                z = fail[z]
            fail[v], pops[v] = child[z << 8 | byte[v]], popped
        self.child, self.fail, self.pops = child, fail, pops

    def count(self, word: bytes) -> int:
        child, fail, pops, node, n = self.child, self.fail, self.pops, 0, 0
        for b in word:
            while (to := child.get(node << 8 | b)) is None:
                n += pops[node]
                node = fail[node]
            node = to
        while node:
            n += pops[node]
            node = fail[node]
        return n


def read_ranks(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return Automaton(read_ranks(path))


OUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def _counts(path: str):
    def run(batches):
        a, known = automaton(path), {}
        for b in batches:
            words, tokens = [], []
            for *_, texts in utf8_groups(b.column(1), TOGETHER):
                for t in texts:
                    w = t.split()
                    if len(known) > _CACHE:
                        known.clear()
                    for x in set(w).difference(known):
                        known[x] = a.count(b" " + x)
                    words.append(len(w))
                    tokens.append(sum(map(known.__getitem__, w)))
            yield batch(OUT, b.column(0), b.column(2), words, tokens)

    return run


def token_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, row, n_words, n_tokens.

    Words are runs of bytes other than ASCII white space; each is taken with one space in front and split by longest
    match over the vocabulary at ``path`` (a rank file). Null counts as empty: no words, no tokens. Texts of any length
    count whole; null ids are kept; repeated rows get equal values; an empty table gives an empty result; columns other than the two named are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_counts(path), "doc_id long, row long, n_words long, n_tokens long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")

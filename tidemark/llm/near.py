"""Near duplicates by SimHash fingerprints of five-word shingles, verified on the sets: a Jaccard similarity of 0.8 or more.

A fingerprint has 128 bits in BLOCKS blocks. Documents meet in equal blocks, which two fingerprints that differ in fewer
bits than there are blocks cannot all lack; what is close in size and Hamming distance is linked. A pair at 0.8 differs
in 19 bits, though, and blocks that miss none of those would be about 185 a document. Such pairs are completed by an exact
prefix filter: of sets that reach the similarity, each has at least four fifths of its shingles in common with the
other, so they share one among the first fifth, and one more, of each in any common order. The order is by hash, with
shingles that are frequent in a sample last, which keeps buckets small; the sample changes the cost, not the result.
Buckets of both kinds are checked alike (a pair at 0.8 differs in more than MOST_BITS bits once in 10**6; unlike sets
differ in 64). Components of these candidates are gathered and their shingle sets compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ASCII_LOWER, Stage, mix64, numbered, tidied, utf8_groups
from tidemark.llm.components import components
from tidemark.llm.hashing import word_hash

SHINGLE = 5
#: Similarity as a fraction: intersection * OF >= union * SHARE.
SHARE, OF = 4, 5
#: Differing bits of 128 up to which sets are compared; sets of fewer than SMALL shingles are compared anyway.
MOST_BITS, SMALL = 40, 20
#: Blocks of a fingerprint, of 21 or 22 bits.
BLOCKS = 6
#: Shingles in at least OFTEN of about SAMPLE documents are frequent; at most MOST_FREQUENT are kept.
SAMPLE, OFTEN, MOST_FREQUENT = 10_000, 3, 1 << 20
TOGETHER = 1 << 20

_WORD = np.random.default_rng(55).integers(1 << 62, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_EMPTY = np.zeros(0, np.uint64)
_EDGES = [128 * i // BLOCKS for i in range(BLOCKS + 1)]
#: The bits of each block, in both words of a fingerprint, and what tells the blocks apart.
_BLOCK = np.array([[((1 << j) - (1 << i)) >> 64 * k & (1 << 64) - 1 for k in range(2)] for i, j in zip(_EDGES, _EDGES[1:])], np.uint64)
_SALT = mix64(np.arange(1, BLOCKS + 1, dtype=np.uint64))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text, hashed and sorted; words are split at ASCII white space, A-Z lower-cased.

    A text of fewer than five words is one shingle, one without words has none.
    """
    data = np.frombuffer(b" " + b" ".join(t.translate(ASCII_LOWER) for t in texts) + b" ", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    first = np.searchsorted(start, np.cumsum([1] + [len(t) + 1 for t in texts]))
    word = word_hash(data, start, end)
    grams = np.zeros(max(0, len(word) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        grams += word[j : j + len(grams)] * _WORD[j]
    grams, out = mix64(grams), []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix64((word[a:b] * _WORD[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(_EMPTY)
    return out


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of a set, two words of 64 bits."""
    out = np.zeros(2, np.uint64)
    for k, h in enumerate((shingles, mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)))):
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def blocks(prints: np.ndarray) -> np.ndarray:
    """A token for each block of fingerprints (sets, 2); equal blocks have equal ones."""
    own = prints[:, None, :] & _BLOCK
    return mix64(mix64(own[..., 0] + _SALT) + own[..., 1])


def prefix(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one; frequent is sorted."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.uint64)  # sets without shingles are equal
    if len(frequent):
        last = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
        shingles = np.concatenate([shingles[~last], shingles[last]])
    return shingles[: n + 1 + (-n * SHARE // OF)]


@tidied
def _shingles(batches):
    for b in batches:
        for *_, texts in utf8_groups(b.column(0), TOGETHER):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingle_sets(texts)).view(np.int64))], names=["h"])


def frequent_shingles(docs: DataFrame, text: str) -> bytes:
    """Sorted hashes, MOST_FREQUENT at most."""
    n = docs.count()
    some = docs.select(F.col(text).alias("text")).sample(min(1.0, SAMPLE / max(1, n)), 1)
    counts = some.mapInArrow(_shingles, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow().column("h").to_numpy().view(np.uint64)).tobytes()


def _tokens(frequent):
    """(token, row, n, a, b): where documents meet, in blocks of the fingerprint and in shingles of the prefix."""

    @tidied
    def run(batches):
        often = np.frombuffer(frequent.value, np.uint64)
        for b in batches:
            rows = b.column(1).to_numpy()
            for i, j, texts in utf8_groups(b.column(0), TOGETHER):
                sets = shingle_sets(texts)
                prints = np.stack([fingerprint(s) for s in sets])
                tokens = [np.concatenate([own, prefix(s, often)]) for s, own in zip(sets, blocks(prints))]
                k, prints = np.array([len(t) for t in tokens]), prints.view(np.int64)
                columns = np.concatenate(tokens).view(np.int64), np.repeat(rows[i:j], k), np.repeat(np.array([len(s) for s in sets]), k), np.repeat(prints[:, 0], k), np.repeat(prints[:, 1], k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "row", "n", "a", "b"])

    return run


def _runs(batches):
    """The rows again, as tables in which each value of the first column, by which they come sorted, is whole."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[-1].column(0)[0].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, b.slice(0, cut)] if cut else held).combine_chunks()
            held = []
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)]).combine_chunks()
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _close(n, prints, m, others) -> np.ndarray:
    """Whether the sets may be similar, by their sizes and fingerprints."""
    least = np.minimum(n, m)
    return (least * OF >= np.maximum(n, m) * SHARE) & ((least < SMALL) | (np.bitwise_count(prints ^ others).sum(axis=-1) <= MOST_BITS))


@tidied
def _links(batches):
    """Links that join the close members of each bucket: each member is compared once with those not yet reached."""
    for t in _runs(batches):
        token, row, n = (t.column(i).to_numpy() for i in range(3))
        prints = np.stack([t.column(i).to_numpy().view(np.uint64) for i in (3, 4)], axis=1)
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(start, append=len(token))
        p = start[size == 2]
        p = p[_close(n[p], prints[p], n[p + 1], prints[p + 1])]
        u, v = [row[p]], [row[p + 1]]
        for s, k in zip(start[size > 2], size[size > 2]):
            rest = np.arange(s, s + k)
            while len(rest) > 1:
                frontier, rest = [rest[0]], rest[1:]
                while frontier and len(rest):
                    x = frontier.pop()
                    near = _close(n[x], prints[x], n[rest], prints[rest])
                    if near.any():
                        found = rest[near]
                        u.append(row[found])
                        v.append(np.full(len(found), row[x]))
                        frontier += found.tolist()
                        rest = rest[~near]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def similar(sets: list[np.ndarray]) -> list[list[int]]:
    """The components of sets that are linked by the similarity; equal sets are similar, also without shingles."""
    whole: dict[bytes, list[int]] = {}
    for i, s in enumerate(sets):
        whole.setdefault(s.tobytes(), []).append(i)
    members = list(whole.values())
    own = [sets[m[0]] for m in members]
    size = np.array([len(s) for s in own])
    _, number = np.unique(np.concatenate(own), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(len(own)), size)[np.argsort(number, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(number))] if len(number) else np.zeros(1, np.int64)
    left, out = np.ones(len(own), bool), []
    for i in range(len(own)):
        if not left[i]:
            continue
        left[i], frontier, reached = False, [i], [i]
        while frontier and left.any():
            x = frontier.pop()
            if not size[x]:
                continue
            shared = np.bincount(np.concatenate([owner[first[k] : first[k + 1]] for k in number[at[x] : at[x + 1]]]), minlength=len(own))
            found = np.flatnonzero(left & (shared * OF >= (size[x] + size - shared) * SHARE)).tolist()
            left[found] = False
            frontier += found
            reached += found
        out.append([j for r in reached for j in members[r]])
    return out


@tidied
def _sets(batches):
    for b in batches:
        for i, j, texts in utf8_groups(b.column(3), TOGETHER):
            yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in range(3)), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["root", "row", "doc_id", "shingles"])


@tidied
def _later(batches):
    """Of each group the rows other than the first by (doc_id, row), a null doc_id before any other."""
    for t in _runs(batches):
        root, row, ids = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist()
        column, out = t.column(3), []
        start = np.flatnonzero(np.r_[True, root[1:] != root[:-1]])
        for s, e in zip(start, np.r_[start[1:], len(root)]):
            for group in similar([np.frombuffer(x, np.uint64) for x in column.slice(s, e - s).to_pylist()]):
                group = sorted((ids[s + j] is not None, ids[s + j] or 0, row[s + j]) for j in group)
                out += [r for *_, r in group[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["row"])


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scan: bool = False) -> DataFrame:
    """The numbers (row) of the documents that go where each group linked by the similarity keeps its smallest doc_id.

    Among rows that repeat this id the smallest row number stays, and a null id is smaller than any other. Texts
    without words, or null, form one group. Texts of any length count whole; an empty table gives an empty result.
    ``scan``: docs is a plain scan of files, whose rows common.numbered numbers alike.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "near")
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, text))
    source = numbered(docs, stage, F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), scan=scan)
    buckets = source.select("text", "row").mapInArrow(_tokens(frequent), "token long, row long, n long, a long, b long")
    links = stage.table(buckets.repartition("token").sortWithinPartitions("token").mapInArrow(_links, "u long, v long").distinct(), "links")
    roots = stage.table(components(links, stage), "roots")
    candidates = source.join(roots.withColumnRenamed("node", "row"), "row").select("root", "row", "doc_id", "text")
    sets = candidates.mapInArrow(_sets, "root long, row long, doc_id long, shingles binary")
    return stage.table(sets.repartition("root").sortWithinPartitions("root").mapInArrow(_later, "row long"), "later")

"""Exact duplicates by a Golomb-coded fingerprint exchange.

1. One scan lower-cases A-Z, takes SHA-256 and a 48-bit fingerprint of every text, and cuts the rows of a
   partition into chunks. A chunk sends each owner of a fingerprint range one message: its sorted distinct
   fingerprints as Golomb-Rice coded gaps.
2. An owner decodes its messages and answers each chunk with a bitmap: which fingerprints another chunk has too.
3. Rows whose bit is set, or which repeat within their chunk, are suspects. A second scan lets only their texts
   through, by a broadcast of their row numbers for as long as it has a bounded size. The texts are
   shuffled and grouped by their bytes, which is the verification; groups are pre-aggregated before the shuffle, so
   that a text with any number of copies crosses it once a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ASCII_LOWER, Stage, batch, numbered, rows_of, tidied, utf8_groups

FP_BITS = 48
#: Rows of a chunk, and about how many fingerprints an owner gets.
CHUNK_ROWS, OWNED = 1 << 16, 1 << 21

KEYS = "doc_id long, row long, chunk long, owner int, rank int, twin boolean, sha binary, message binary"
ARROW_KEYS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int64()), ("owner", pa.int32()), ("rank", pa.int32()), ("twin", pa.bool_()), ("sha", pa.binary()), ("message", pa.binary())])


def golomb_encode(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct values below 2**bits. Layout: count (4 bytes), Rice parameter (1), unary stream, remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(np.floor(np.log2(max(1.0, 0.69 * float(values[-1]) / n))))) if n else 0
    head = n.to_bytes(4, "little") + bytes([k])
    if not n:
        return head
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + n, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(unary).tobytes()
    return head + len(packed).to_bytes(4, "little") + packed + np.packbits(rest.ravel()).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    n, k = int.from_bytes(data[:4], "little"), data[4]
    if not n:
        return np.zeros(0, np.uint64)
    m = int.from_bytes(data[5:9], "little")
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, m, 9)))[:n]
    quotients = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    rest = np.unpackbits(np.frombuffer(data, np.uint8, offset=9 + m))[: n * k].reshape(n, k).astype(np.uint64)
    return np.cumsum((quotients << np.uint64(k)) + (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def _keys(owners: int):
    shift = np.uint64(FP_BITS - (owners.bit_length() - 1))

    def chunk_rows(ids, rows, fps, shas, chunk):
        fps = np.array(fps, np.uint64)
        values, inverse, counts = np.unique(fps, return_inverse=True, return_counts=True)
        owner = (values >> shift).astype(np.int64)
        first = np.searchsorted(owner, np.arange(owners + 1))
        rank = np.arange(len(values)) - first[owner]
        n = len(fps)
        yield batch(ARROW_KEYS, ids, rows, np.full(n, chunk), owner[inverse].astype(np.int32), rank[inverse].astype(np.int32), (counts > 1)[inverse], shas, pa.nulls(n, pa.binary()))
        full = [o for o in range(owners) if first[o] < first[o + 1]]
        sent = [golomb_encode(values[first[o] : first[o + 1]] - (np.uint64(o) << shift), int(shift)) for o in full]
        m = len(full)
        yield batch(ARROW_KEYS, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), np.full(m, chunk), np.array(full, np.int32), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.binary()), sent)

    @tidied
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, rows, fps, shas = [], [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            rows += b.column(2).to_pylist()
            for *_, texts in utf8_groups(b.column(1), 1 << 20):
                for t in texts:
                    t = t.translate(ASCII_LOWER)
                    fps.append(xxhash.xxh3_64_intdigest(t) >> (64 - FP_BITS))
                    shas.append(hashlib.sha256(t).digest())
            while len(ids) >= CHUNK_ROWS:
                yield from chunk_rows(ids[:CHUNK_ROWS], rows[:CHUNK_ROWS], fps[:CHUNK_ROWS], shas[:CHUNK_ROWS], part << 20 | seq)
                ids, rows, fps, shas, seq = ids[CHUNK_ROWS:], rows[CHUNK_ROWS:], fps[CHUNK_ROWS:], shas[CHUNK_ROWS:], seq + 1
        if ids:
            yield from chunk_rows(ids, rows, fps, shas, part << 20 | seq)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One owner: for each chunk's message the bitmap of fingerprints that another chunk sent too, in 64-bit words."""
    lists = [golomb_decode(m) for m in table.column("message").to_pylist()]
    every = np.concatenate(lists)
    values, counts = np.unique(every, return_counts=True)
    shared = values[counts > 1]
    words = []
    for x in lists:
        hit = np.zeros(-(-len(x) // 64) * 64, np.uint8)
        hit[: len(x)] = np.isin(x, shared, assume_unique=True)
        words.append(np.packbits(hit, bitorder="little").view(np.int64).tolist())
    return pa.table({"chunk": table.column("chunk"), "owner": table.column("owner"), "bitmap": pa.array(words, pa.list_(pa.int64()))})


@tidied
def _lowered(batches):
    for b in batches:
        for i, j, texts in utf8_groups(b.column(2), 4 << 20):
            columns = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([t.translate(ASCII_LOWER) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "norm"])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scan: bool = False) -> DataFrame:
    """One row per input row: doc_id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts form one
    group. The row with the largest doc_id stays; among rows that repeat this id, the one with the smallest row
    number. A null doc_id is smaller than any other. Texts of any length count whole. An empty table gives an empty
    result. Only the two named columns are read, so other columns may have any names. ``scan``: docs is a plain scan
    of files, which can be read twice without a copy (see common.numbered).
    """
    spark = docs.sparkSession
    stage = Stage(spark, "exact")
    source = numbered(docs, stage, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), scan=scan)
    owners = 1 << max(4, (docs.select(doc_id).count() // OWNED).bit_length())
    keys = stage.table(source.select("doc_id", "text", "row").mapInArrow(_keys(owners), KEYS), "keys")
    rows = keys.where("message is null")
    messages = keys.where("message is not null").select("chunk", "owner", "message")
    bitmaps = messages.groupBy("owner").applyInArrow(_answer, "chunk long, owner int, bitmap array<long>")
    told = F.element_at("bitmap", (F.shiftright("rank", 6) + 1).cast("int")).bitwiseAND(F.expr("shiftleft(1L, rank % 64)")) != 0
    suspects = stage.table(rows.select("chunk", "owner", "rank", "twin", "row").join(bitmaps, ["chunk", "owner"]).where(F.col("twin") | told).select("row"), "suspects")
    texts = rows_of(source, suspects).select("doc_id", "row", "text").mapInArrow(_lowered, "doc_id long, row long, norm binary")
    groups = texts.groupBy("norm").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", (-F.col("row")).alias("r"))).alias("keep")).where("n > 1")
    # One text has one SHA-256; two texts with the same one would be a collision, and no row may get two answers.
    verified = stage.table(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), F.col("keep.doc_id").alias("keep_id"), (-F.col("keep.r")).alias("keep_row"), "n"), "groups")
    stage.drop(suspects)
    found = rows.select("doc_id", "row", "sha").join(verified, "sha", "left")
    single = F.col("n").isNull()
    return found.select(
        "doc_id", "row", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True).drop("row")


ORACLE = {
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)"""
}

"""Near duplicates by SimHash fingerprints and pigeonhole blocks.

A 64-bit fingerprint is split into five blocks. Two fingerprints with three or fewer differing bits have at least
two equal blocks, so they meet in one of the ten pairs of blocks. Candidates of a pair are verified by Hamming
distance. Work is on distinct fingerprints; a bucket with many of them is dealt out as tiles of bounded size, and a
task returns the local components of its tile as links to one member, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import ASCII_LOWER, Stage, batch, keyed, utf8_groups
from tidemark.llm.components import components

SEED, SHINGLE, MOST_BITS, BLOCKS = 42, 3, 3, 5
#: Fingerprints of one bucket that are compared in one task are two such chunks at most.
CHUNK = 1024


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of one UTF-8 text; words are split at ASCII white space, A-Z lower-cased."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("fp", pa.int64())])


def _fingerprints(batches):
    for b in batches:
        prints = [fingerprint(t) for *_, texts in utf8_groups(b.column(1), 1 << 20) for t in texts]
        yield batch(SCHEMA, b.column(0), b.column(2), np.array(prints, np.uint64).view(np.int64))


def _local_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the components of one tile: a breadth-first walk that compares each member once with those not yet reached."""
    rest, out = fps, []
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= MOST_BITS
            if near.any():
                found = rest[near]
                out += [(int(x), int(root)) for x in found]
                frontier += list(found)
                rest = rest[~near]
    return out


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _tiles(batches):
    """Rows come sorted by tile; a tile is closed when the next one begins."""
    held: list[np.ndarray] = []
    held_key = None

    def close(tiles: list[np.ndarray]):
        pairs = [x for t in tiles if len(t) == 2 for x in [t]]
        u = []
        if pairs:
            p = np.stack(pairs)
            u.append(p[np.bitwise_count(p[:, 0] ^ p[:, 1]) <= MOST_BITS])
        more = [x for t in tiles if len(t) > 2 for x in _local_links(np.unique(t))]
        if more:
            u.append(np.array(more, np.uint64))
        p = np.concatenate(u) if u else np.zeros((0, 2), np.uint64)
        return batch(LINKS, p[:, 0].view(np.int64) if len(p) == 0 else np.ascontiguousarray(p[:, 0]).view(np.int64), np.ascontiguousarray(p[:, 1]).view(np.int64))

    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
        fps = b.column(3).to_numpy().view(np.uint64)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        runs = np.split(fps, cuts)
        if held_key is not None and (held_key == keys[0]).all():
            held.append(runs.pop(0))
            if not runs:
                continue
        done = ([np.concatenate(held)] if held else []) + runs[:-1]
        held, held_key = [runs[-1]], keys[-1]
        yield close(done)
    if held:
        yield close([np.concatenate(held)])


def block_key(fp: str, pair: tuple[int, int], blocks: int = BLOCKS):
    """The bits of two blocks, the others zero."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in pair)
    return F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def near_links(nodes: DataFrame, stage: Stage) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints nodes(fp) just as all pairs of three or fewer differing bits would."""
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("pair"), block_key("fp", p).alias("key")) for i, p in enumerate(combinations(range(BLOCKS), 2))])
    buckets = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.key")
    shared = stage.table(buckets.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = buckets.join(shared, ["pair", "key"]).select("pair", "key", "fp", chunks.alias("c"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("mine"))
    tiles = dealt.select("pair", "key", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("other"), "mine", "fp")
    tiles = tiles.select("pair", "key", (F.least("mine", "other").cast("long") * 1000003 + F.greatest("mine", "other")).alias("tile"), "fp")
    return tiles.repartition("pair", "key", "tile").sortWithinPartitions("pair", "key", "tile").mapInArrow(_tiles, "u long, v long")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, row, fingerprint (16 hex digits), component_id.

    A text of fewer than three words is one shingle; one without words, or null, has fingerprint zero and is linked
    like any other. component_id is the smallest doc_id reachable over links of three or fewer differing bits; null
    ids count only where a whole component has no other. Texts of any length count whole; a bit that half the shingles
    set is 0. Repeated rows share a fingerprint. An empty table gives an
    empty result; columns other than the two named are not read.
    """
    stage = Stage(docs.sparkSession, "simhash")
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = stage.table(source.mapInArrow(_fingerprints, "doc_id long, row long, fp long"), "prints")
    nodes = stage.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = stage.table(near_links(nodes, stage), "links")
    roots = components(links, stage)
    placed = stage.table(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    smallest = stage.table(placed.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    named = stage.table(placed.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")

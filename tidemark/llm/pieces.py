"""SentencePiece encoding and decoding over a relational lattice.

The vocabulary is a byte-fallback BPE model, whose result is the one segmentation in which each two neighbours, put
together, are encoded as just these two. So the lattice's fold keeps, for each place in a word, the one piece that
can end there after what ends at its start; scores decide only whether two pieces are such neighbours.

1. One scan cuts texts wherever no piece has the two characters side by side; no piece can cross such a place. It
   leaves, chunk by chunk of documents, a compressed message of distinct parts for each owner, and the documents as
   numbers of parts. Both are in one written table, so no other scan has to cut its chunks alike.
2. The distinct parts of all messages, known by their owner and their place among its sorted parts, are exploded into
   substrings of bounded length and joined to the piece table, which has as many rows as the model and is broadcast. A
   part's edges stay in its partition; each edge is told which of the pieces that end where it begins may stand before
   it. Spark's aggregate folds the edges in order, and a second one walks back.
3. Owners answer each message with the ids of its parts, in their order; chunk by chunk the documents meet the answers.
   Where digests are wanted, one slice of the chunks after the other is shuffled, and each goes when it is over: the
   documents never lie in their table and, whole, in a shuffle too.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Stage, batch, keyed, mix64, tidied, utf8_groups
from tidemark.llm.hashing import LONG as LONG_WORD, Sums

SPACE = "▁"
#: A chunk ends with the run of documents that brings it to so many distinct parts or characters; texts are taken in runs of so many bytes.
CHUNK_PARTS, CHUNK_CHARACTERS, TOGETHER = 400_000, 12_000_000, 1 << 19
#: Parts that an owner has, about; a part of more characters than LONG has too many edges for a row and is folded by the same recurrence in its task.
OWNED, LONG = 100_000, 2_000
#: Parts that one task's lattice has, about.
TASK_PARTS = 50_000
#: Slices of the chunks that meet their answers one after the other.
SLICES = 4
#: Ids that are Python numbers at a time when texts are made of them.
MOST_IDS = 1 << 18
#: Answers about two neighbours that a worker keeps, as a power of two: 19 MB.
SLOTS = 21


class Model:
    """Pieces and scores of a model file, and merges of neighbours by the best score, the leftmost first."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: m.get_score(i) for i in plain}
        self.beside = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.longest = max(map(len, self.id))
        halves = {p: (p, p) if len(p) == 1 else self.merge(p)[1] for p in self.id}
        self.stable = {p for p, h in halves.items() if h}
        # Ranks: single characters first, then pieces in the order in which they are merged.
        order = sorted(self.stable, key=lambda p: (len(p) > 1, -self.score[p], self.id[p]))
        rank = {p: i for i, p in enumerate(order)}
        self.rank = np.full(len(self.pieces), -1, np.int64)
        self.rank[[self.id[p] for p in order]] = np.arange(len(order))
        self.halves = np.array([[rank[x] for x in halves[p]] for p in order], np.int64)
        joins = sorted((rank[p[:i]] << 20 | rank[p[i:]], rank[p]) for p in self.stable for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank)
        self.join_keys, self.join_ranks = (np.array(c, np.int64) for c in zip(*joins))
        # Pieces of one score (runs of white marks) are merged leftmost first, whichever they are: ranks do not say that.
        scores = Counter(self.score[p] for p in self.stable if len(p) > 1)
        equal = [p for p in self.stable if len(p) > 1 and scores[self.score[p]] > 1]
        self.tied = np.array([any(t in p for t in equal) for p in self.pieces])
        # Characters that stand beside another in some piece, numbered from 1, and which stand beside which.
        signs = sorted(set("".join(self.beside)))
        self.sign = np.zeros(0x110000, np.uint16)
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.adjacent = np.zeros((len(signs) + 1, len(signs) + 1), bool)
        for x in self.beside:
            self.adjacent[self.sign[ord(x[0])], self.sign[ord(x[1])]] = True
        self.adjacent = self.adjacent.ravel()
        self.asked, self.answers = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """The encoding of a text of known characters by merges, and the halves of the last merge if one piece is left."""
        s, last = list(text), None
        while len(s) > 1:
            found = [(self.score[x], -i) for i in range(len(s) - 1) if (x := s[i] + s[i + 1]) in self.score]
            if not found:
                break
            i = -max(found)[1]
            last = s[i], s[i + 1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s, last if len(s) == 1 else None

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a[i] and b[i], put together, are encoded as just these two.

        Merges are taken back from the latest on, on whichever side it was made: they are such neighbours unless some
        state on the way has a merge over the border that would have come before the next merge on either side.
        """
        out = np.ones(len(a), bool)
        by_merging = self.tied[a] | self.tied[b]
        for i in np.flatnonzero(by_merging):
            two = [self.pieces[a[i]], self.pieces[b[i]]]
            out[i] = self.merge("".join(two))[0] == two
        live = np.flatnonzero(~by_merging)
        x, y, limit = self.rank[a[live]], self.rank[b[live]], np.full(len(live), 1 << 40, np.int64)
        last = len(self.join_keys) - 1
        while len(live):
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.join_keys, key), last)
            bad = (self.join_keys[at] == key) & (self.join_ranks[at] < limit)
            out[live[bad]] = False
            left, right = self.halves[x, 1], self.halves[y, 0]
            back_x, single_x, single_y = x > y, left == x, right == y
            # The later one is taken apart; a single character cannot be, and then the other one is.
            take_x = np.where(back_x, ~single_x, single_y)
            done = single_x & single_y
            limit = np.where(take_x, x, y + 1)
            x, y = np.where(take_x, left, x), np.where(take_x, y, right)
            go = ~(bad | done)
            live, x, y, limit = live[go], x[go], y[go], limit[go]
        return out

    def heads(self) -> dict[str, list[int]]:
        """The lengths of the pieces that begin with the same three characters."""
        out: dict[str, set[int]] = {}
        for p in self.stable:
            if len(p) > 2:
                out.setdefault(p[:3], set()).add(len(p))
        return {h: sorted(n) for h, n in out.items()}

    def known_neighbours(self, pairs: np.ndarray) -> np.ndarray:
        """The answer of ``neighbours`` for pairs a << 32 | b; of pairs with one slot the table keeps the last."""
        slot = (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out, new = self.answers[slot], np.flatnonzero(self.asked[slot] != pairs)
        if len(new):
            values, at, which = np.unique(pairs[new], return_index=True, return_inverse=True)
            fit = self.neighbours(values >> 32, values & 0xFFFFFFFF)
            out[new] = fit[which]
            _, one = np.unique(slot[new][at], return_index=True)
            self.asked[slot[new][at][one]], self.answers[slot[new][at][one]] = values[one], fit[one]
        return out

    def fold(self, part: str) -> list[int]:
        """The lattice's recurrence for one part, in time linear in its length."""
        ends: list[list[tuple[int, int]]] = [[(s, self.id[x]) for s in range(max(0, e - self.longest), e) if (x := part[s:e]) in self.stable] for e in range(len(part) + 1)]
        pairs = sorted({(a, i) for e in range(1, len(part) + 1) for s, i in ends[e] for _, a in ends[s]})
        fit = {p for p, ok in zip(pairs, self.neighbours(*np.array(pairs, np.int64).T)) if ok} if pairs else set()
        last: list[tuple[int, int]] = [(0, -1)]
        for e in range(1, len(part) + 1):
            last.append(next((s, i) for s, i in ends[e] if s == 0 or (last[s][1], i) in fit))
        out, e = [], len(part)
        while e > 0:
            out.append(last[e][1])
            e = last[e][0]
        return out[::-1]

    def ids(self, part: str) -> list[int]:
        return self.fold(part) if part in self.id or len(part) > 1 else self.fallback(part)

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def decode(self, ids) -> str:
        back = {i: b for b, i in self.bytes.items()}
        data = b"".join(bytes([back[i]]) if i in back else self.pieces[i].encode() for i in ids)
        return data.decode("utf-8", "replace").replace(SPACE, " ")[1:]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def cut(m: Model, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct parts of texts, for each place of a part its number, and how many places each text has."""
    marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
    sizes, whole = np.array(list(map(len, marked)), np.int64), "".join(marked)
    if not whole:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    sign = m.sign[points].astype(np.int32)
    starts = np.empty(len(points), bool)
    starts[0], width = True, int(len(m.adjacent) ** 0.5)
    np.logical_not(m.adjacent[sign[:-1] * width + sign[1:]], out=starts[1:])
    first = np.cumsum(sizes) - sizes
    starts[first[sizes > 0]] = True
    start = np.flatnonzero(starts)
    end = np.append(start[1:], len(points))
    h = Sums(0, mix64(points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))).span(start, end)
    for i in np.flatnonzero(end - start >= LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(points[start[i] : end[i]])
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    size, like = end - start, at[which]
    within = np.arange(len(points)) - np.repeat(start, size)
    if (size == size[like]).all() and (points == points[np.repeat(start[like], size) + within]).all():
        parts = [whole[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())]
    else:  # two parts with one hash
        names: dict[str, int] = {}
        which = np.array([names.setdefault(whole[i:j], len(names)) for i, j in zip(start.tolist(), end.tolist())])
        parts = list(names)
    return parts, which, np.diff(np.searchsorted(start, np.append(first, len(points))))


class Chunk:
    """Documents in order, their distinct parts, and their places as numbers of parts."""

    def __init__(self):
        self.parts: dict[str, int] = {}
        self.ids, self.rows, self.codes, self.sizes, self.characters, self.hash = [], [], [], [], 0, xxhash.xxh3_64()

    def add(self, m: Model, ids: list, rows: list, texts: list[bytes]) -> None:
        text = [t.decode() for t in texts]
        parts, which, sizes = cut(m, text)
        number = np.array([self.parts.setdefault(p, len(self.parts)) for p in parts], np.uint32)
        self.codes.append(number[which] if len(parts) else np.zeros(0, np.uint32))
        self.sizes.append(sizes)
        self.ids += ids
        self.rows += rows
        self.characters += sum(map(len, text))
        for t in texts:
            self.hash.update(len(t).to_bytes(8, "little"))
            self.hash.update(t)

    def key(self) -> int:
        """Of the texts and rows; signed."""
        self.hash.update(np.array(self.rows, np.int64).tobytes())
        return int(np.array([self.hash.intdigest()], np.uint64).view(np.int64)[0])

    def by_owner(self, owners: int) -> tuple[list[list[str]], np.ndarray]:
        """Each owner's parts, the most frequent first, and for each part its number: by the place in its owner's list,
        then by owner. So frequent parts have small numbers, which compress well, and the lists alone tell all numbers."""
        names, out, owner, place = list(self.parts), [[] for _ in range(owners)], [], []
        order = np.argsort(-np.bincount(np.concatenate(self.codes), minlength=len(names)), kind="stable")
        for i in order.tolist():
            o = zlib.crc32(names[i].encode()) % owners
            owner.append(o)
            place.append(len(out[o]))
            out[o].append(names[i])
        number = np.empty(len(names), np.int64)
        number[order[numbering(np.array(owner, np.int64), np.array(place, np.int64))]] = np.arange(len(names))
        return out, number


def numbering(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order of a chunk's parts."""
    return np.lexsort((owner, place))


def _chunks(path: str, batches):
    m, chunk = model(path), Chunk()
    for b in batches:
        ids, rows = b.column(0).to_pylist(), b.column(2).to_pylist()
        for i, j, texts in utf8_groups(b.column(1), TOGETHER):
            chunk.add(m, ids[i:j], rows[i:j], texts)
            if len(chunk.parts) > CHUNK_PARTS or chunk.characters > CHUNK_CHARACTERS:
                yield chunk
                chunk = Chunk()
    if chunk.ids:
        yield chunk


def packed(data: bytes) -> bytes:
    """Compressed, with the length in front."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def texts_packed(parts: list[str]) -> bytes:
    sizes = np.array([len(p.encode()) for p in parts], "<u4")
    return packed(len(parts).to_bytes(4, "little") + sizes.tobytes() + "".join(parts).encode())


def texts_unpacked(data: bytes) -> list[str]:
    data = unpacked(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.r_[4 + 4 * n, np.frombuffer(data, "<u4", n, 4)]).tolist()
    return [data[i:j].decode() for i, j in zip(ends, ends[1:])]


#: The slice of the messages.
MESSAGES = -1
CUT = "owner int, chunk long, count int, parts binary, doc_ids array<long>, rows array<long>, sizes array<int>, codes binary"
CUT_SCHEMA = pa.schema(
    [("owner", pa.int32()), ("chunk", pa.int64()), ("count", pa.int32()), ("parts", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())),
     ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())]
)


def planes(codes: np.ndarray) -> bytes:
    """Numbers below 2**24, their low bytes first: frequent bytes then stand together."""
    return packed(np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes())


def unplaned(data: bytes) -> np.ndarray:
    x = np.frombuffer(unpacked(data), np.uint8).reshape(3, -1).astype(np.int64)
    return x[0] | x[1] << 8 | x[2] << 16


def _cut(path: str, owners: int):
    """Of each chunk a message of distinct parts for each owner (owner, chunk, count, parts), and its documents (chunk,
    doc_ids, rows, sizes, codes) as numbers of the chunk's parts."""

    @tidied
    def run(batches):
        for chunk in _chunks(path, batches):
            (mine, number), key, at = chunk.by_owner(owners), chunk.key(), 0
            full = [o for o in range(owners) if mine[o]]
            none = [None] * len(full)
            yield batch(CUT_SCHEMA, full, [key] * len(full), [len(mine[o]) for o in full], [texts_packed(mine[o]) for o in full], none, none, none, none)
            for codes, sizes in zip(chunk.codes, chunk.sizes):
                to = at + len(sizes)
                yield batch(CUT_SCHEMA, [None], [key], [None], [None], [chunk.ids[at:to]], [chunk.rows[at:to]], [sizes.tolist()], [planes(number[codes])])
                at = to

    return run


def _owned(messages: list[bytes]) -> list[str]:
    """One owner's distinct parts, sorted."""
    parts: set[str] = set()
    for data in messages:
        parts.update(texts_unpacked(data))
    return sorted(parts)


def _distinct(table: pa.Table) -> pa.Table:
    """One owner's distinct parts, known by the owner and their place."""
    parts = _owned(table.column("parts").to_pylist())
    return pa.table({"key": pa.array(np.arange(len(parts)) + (table.column("owner")[0].as_py() << 32), pa.int64()), "part": pa.array(parts, pa.string())})


def _before(path: str):
    """Puts the edges of a part in order of their ends, and tells each, by its bits, which of the edges that end where it begins may stand before it."""

    @tidied
    def run(batches):
        m = model(path)
        for b in batches:
            lists = b.column(1)
            edges = lists.flatten().to_numpy()
            n = np.diff(lists.offsets.to_numpy())
            part = np.repeat(np.arange(len(n)), n)
            edges = edges[np.lexsort((edges, part))]
            e, s, ids = edges >> 36, edges >> 24 & 0xFFF, edges & 0xFFFFFF
            # Edges that end at one place follow each other: their first one, and each one's number among them.
            place, want = part << 32 | e, part << 32 | s
            first = np.searchsorted(place, place)
            number = np.arange(len(place)) - first
            lo, hi = np.searchsorted(place, want), np.searchsorted(place, want, "right")
            count = hi - lo
            edge = np.repeat(np.arange(len(place)), count)
            before = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + lo[edge]
            fit = m.known_neighbours(ids[before] << 32 | ids[edge])
            bits = np.zeros(len(place), np.int64)
            np.add.at(bits, edge, fit.astype(np.int64) << number[before])
            columns = [pa.array(c) for c in (s.astype(np.int32), s << 32 | number << 24 | ids, bits)]
            steps = pa.ListArray.from_arrays(pa.array(np.cumsum(np.r_[0, n]).astype(np.int32)), pa.StructArray.from_arrays(columns, ["s", "edge", "before"]))
            yield pa.RecordBatch.from_arrays([b.column(0), steps], names=["key", "steps"])

    return run


def _rest(path: str):
    """Ids of parts that need no lattice, a character without a piece, or have too many edges for a row."""

    @tidied
    def run(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.ids(p) for p in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["key", "ids"])

    return run


IDS = "key long, ids array<int>"


def lattice(parts: DataFrame, path: str) -> DataFrame:
    """(key, ids) of distinct parts(key, part), which repeat no key. An edge is one number: its end, start and id."""
    m, spark = model(path), parts.sparkSession
    table = F.broadcast(spark.createDataFrame([(p, m.id[p]) for p in sorted(m.stable)], "piece string, id int"))  # a row a piece of the model
    size = F.length("part")
    one = parts.where(size == 1).join(table.select(F.col("piece").alias("part"), "id"), "part", "left").select("key", "part", "id")
    starts = parts.where((size > 1) & (size <= LONG)).select("key", "part", F.explode(F.sequence(F.lit(1), size)).alias("s"))
    # Substrings of one and two characters, and of the lengths that a piece with the same first three characters has.
    heads = F.broadcast(spark.createDataFrame(sorted(m.heads().items()), "head string, lengths array<int>"))
    headed = starts.withColumn("head", F.substring("part", F.col("s"), F.lit(3))).join(heads, "head", "left")
    lengths = F.concat(F.array(F.lit(1), F.lit(2)), F.coalesce("lengths", F.array().cast("array<int>")))
    spans = headed.select("key", "part", "s", F.explode(lengths).alias("n")).where(F.col("s") + F.col("n") <= size + 1)
    found = spans.select("key", "s", "n", F.substring("part", F.col("s"), F.col("n")).alias("piece")).join(table, "piece")
    start = (F.col("s") - 1).cast("long")
    edge = F.shiftleft(start + F.col("n"), 36).bitwiseOR(F.shiftleft(start, 24)).bitwiseOR(F.col("id").cast("long"))
    edges = found.select("key", edge.alias("edge")).groupBy("key").agg(F.collect_list("edge").alias("edges"))
    steps = edges.mapInArrow(_before(path), "key long, steps array<struct<s: int, edge: long, before: long>>")
    # best[e] is the one edge that may end at e: its start, its number among those that end there, its id.
    best = F.expr("""aggregate(steps, array(-1L), (best, x) -> IF(
      x.s = 0 OR (shiftright(x.before, cast(shiftright(best[x.s], 24) & 255 AS int)) & 1) = 1, concat(best, array(x.edge)), best))""")
    back = F.expr("""aggregate(sequence(size(best) - 1, 1, -1), named_struct('at', size(best) - 1, 'ids', cast(array() AS array<int>)),
      (a, i) -> IF(i = a.at, named_struct('at', cast(shiftright(best[i], 32) AS int), 'ids', concat(a.ids, array(cast(best[i] & 16777215 AS int)))), a)).ids""")
    folded = steps.select("key", best.alias("best")).select("key", F.reverse(back).alias("ids"))
    simple = one.where("id IS NOT NULL").select("key", F.array("id").alias("ids"))
    rest = one.where("id IS NULL").select("key", "part").unionByName(parts.where(size > LONG).select("key", "part"))
    return folded.unionByName(simple).unionByName(rest.mapInArrow(_rest(path), IDS))


def _answers(messages: pa.Table, ids: pa.Table) -> pa.Table:
    """One owner: for each chunk's message the numbers of ids of its parts, and the ids, in the message's order."""
    sent = messages.column("parts").to_pylist()
    at = {p: i for i, p in enumerate(_owned(sent))}
    column, place = ids.column("ids").combine_chunks(), np.empty(len(at), np.int64)
    place[ids.column("key").to_numpy() & 0xFFFFFFFF] = np.arange(len(ids))
    flat, size = column.flatten().to_numpy().astype("<u4"), np.diff(column.offsets.to_numpy())
    first = np.cumsum(size) - size
    out = []
    for data in sent:
        k = place[np.array([at[p] for p in texts_unpacked(data)], np.int64)]
        n = size[k]
        out.append(packed(n.astype("<u4").tobytes() + flat[np.repeat(first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()))
    return pa.table({"owner": messages.column("owner"), "chunk": messages.column("chunk"), "count": messages.column("count"), "ids": pa.array(out, pa.binary())})


def _assemble(docs: pa.Table, answers: pa.Table) -> pa.Table:
    none = np.zeros(0, "<u4")
    sizes, ids, owner, place = [none], [none], [none], [none]
    for o, n, data in zip(*(answers.column(c).to_pylist() for c in ("owner", "count", "ids"))):
        x = np.frombuffer(unpacked(data), "<u4")
        sizes.append(x[:n])
        ids.append(x[n:])
        owner.append(np.full(n, o))
        place.append(np.arange(n))
    size, order = np.concatenate(sizes).astype(np.int64), numbering(np.concatenate(owner), np.concatenate(place))
    flat, first, size, out = np.concatenate(ids).astype(np.int32), (np.cumsum(size) - size)[order], size[order], []
    for codes, counts in zip(docs.column("codes").to_pylist(), docs.column("sizes").to_pylist()):
        c, counts = unplaned(codes), np.array(counts, np.int64)
        n = size[c]
        to = np.cumsum(n)
        tokens = flat[np.repeat(first[c] - (to - n), n) + np.arange(n.sum())]
        ends = np.r_[0, to][np.r_[0, np.cumsum(counts)]]
        out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens)))
    flatten = lambda c: pa.array([x for row in docs.column(c).to_pylist() for x in row], pa.int64())
    return pa.table({"doc_id": flatten("doc_ids"), "row": flatten("rows"), "ids": pa.chunked_array(out, pa.list_(pa.int32()))})


ENCODED = "doc_id long, row long, ids array<int>"


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, then=None) -> DataFrame:
    """One row per input row: doc_id, row, ids, those that the model's own library gives.

    ``then``: a function over the Arrow tables of these rows and its result's schema, for what is wanted of the ids alone;
    it runs where they are put together, so that they go to no other process. Its rows, which should be small beside the
    ids, are written before the result is returned.

    Null counts as empty: no ids. Whole texts of any length are encoded; characters without a piece become their
    bytes. Null ids are kept; repeated rows get equal ids; an empty table gives an empty result; columns other than the two named are not read.
    """
    path = path or model_path()
    stage = Stage(docs.sparkSession, "pieces")
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    owners = 16 << (docs.select(doc_id).count() // OWNED).bit_length()
    sliced = F.pmod(F.col("chunk"), F.lit(SLICES)).cast("int")
    cut = source.mapInArrow(_cut(path, owners), CUT).withColumn("slice", F.when(F.col("owner").isNull(), sliced).otherwise(MESSAGES))
    cut = stage.table(cut, "cut", "slice")
    messages = cut.where(F.col("slice") == MESSAGES).select("owner", "chunk", "count", "parts")
    parts = stage.table(messages.groupBy("owner").applyInArrow(_distinct, "key long, part string"), "parts")
    # A part is few bytes and many edges: the number of tasks follows the parts, so that no task's edges have to be spilled.
    ids = stage.table(lattice(parts.repartition(parts.count() // TASK_PARTS + 1, "key"), path), "ids")
    stage.drop(parts)
    owned = ids.select(F.shiftright("key", 32).cast("int").alias("owner"), "key", "ids")
    answers = messages.groupBy("owner").cogroup(owned.groupBy("owner")).applyInArrow(_answers, "owner int, chunk long, count int, ids binary")
    answers = stage.table(answers.withColumn("slice", sliced), "answers", "slice")  # what was shuffled for them goes before the documents are
    stage.drop(ids)
    stage.drop_part(cut, "slice", MESSAGES)
    finish, schema = then or (lambda table: table, ENCODED)

    def met(chosen) -> DataFrame:
        coded = cut.where(chosen).select("chunk", "doc_ids", "rows", "sizes", "codes")
        mine = answers.where(chosen).select("owner", "chunk", "count", "ids")
        return coded.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInArrow(lambda docs, answers: finish(_assemble(docs, answers)), schema)

    if then is None:
        return met(F.col("slice") != MESSAGES)
    done = []
    for k in range(SLICES):
        done.append(stage.table(met(F.col("slice") == k), "done"))
        for t in (cut, answers):
            stage.drop_part(t, "slice", k)
    return reduce(DataFrame.unionByName, done)


def id_runs(column: pa.Array):
    """(from, to, ids) of runs of rows of about MOST_IDS ids, each row's ids an array, or None; a longer row is alone.

    An Arrow batch has a bounded number of rows, not of ids: as Python numbers a whole one would not fit.
    """
    size = np.diff(column.offsets.to_numpy())
    ends, at, there = np.cumsum(size), 0, column.is_valid().to_numpy(zero_copy_only=False)
    values, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_IDS, "right")))
        yield at, to, [values[first[i] : first[i] + size[i]] if there[i] else None for i in range(at, to)]
        at = to


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, row, text of a table of doc_id, row, ids; null ids give null."""
    path = path or model_path()

    @tidied
    def run(batches):
        m = model(path)
        for b in batches:
            for at, to, ids in id_runs(b.column(2)):
                texts = pa.array([None if x is None else m.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), texts], names=["doc_id", "row", "text"])

    return encoded.select("doc_id", "row", "ids").mapInArrow(run, "doc_id long, row long, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


DIGEST = "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string"


def _digest(path: str):
    def run(encoded: pa.Table) -> pa.Table:
        m = model(path)
        back = {i: bytes([b]) for b, i in m.bytes.items()}
        table = [back.get(i) or p.replace(SPACE, " ").encode() for i, p in enumerate(m.pieces)]
        sizes, sums, hashes = [], [], []
        for column in encoded.column("ids").chunks:
            for *_, ids in id_runs(column):
                sizes += map(len, ids)
                sums += [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                hashes += [hashlib.sha256(b"".join(map(table.__getitem__, x.tolist()))[1:]).hexdigest() for x in ids]
        columns = [encoded.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(hashes, pa.string())]
        return pa.table(columns, names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256"])

    return run


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 (of the text that the ids give back)."""
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), then=(_digest(model_path()), DIGEST))

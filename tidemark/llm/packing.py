"""Packing of tokenised documents into sequences by a configuration linear program.

The histogram of piece lengths, at most ``capacity`` numbers whatever the input's size, is all that the driver sees.
A configuration is a multiset of lengths that fits into one sequence. The linear program - cover each length's
pieces with as few configurations as possible - is solved by multiplicative weights: lengths that are still short
weigh more, and a knapsack dynamic program prices the configurations under these weights. Each round takes the best
configuration and those close to it in small steps; the weights also give a lower bound on the number of sequences.
The solution is rounded down. What the rounding leaves, a few pieces for each configuration whatever the input's
size, is packed best fit, longest first.

The plan is a table of bounded size: of length L, the pieces ranked from..to go to these sequences at this offset.
Pieces get their rank within their length from counts by task, without bringing a length's pieces together.
"""

from __future__ import annotations

import base64
import os
import re
import string
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import Stage, batches_of, keyed, tidied, utf8_groups
from tidemark.llm.hashing import BYTE, Sums

CAPACITY, END = 1024, 2
#: Rounds of the linear program at most, configurations a round, how close to the best these must be, the share of a
#: length that one step covers, how fast covered lengths lose weight, and the power of the length that is its first weight.
ROUNDS, EACH, NEAR, STEP, ETA, POWER = 300, 128, 0.01, 0.34, 0.3, 1.05
#: Documents are encoded together up to so many bytes; parts are remembered up to so many.
TOGETHER, _CACHE = 1 << 20, 400_000
#: Whole texts that go to Python at a time.
TEXTS = 1_000
_MARKS = string.punctuation

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A text in UTF-8 with none of these has white space beside a space nowhere but at its ends.
_RARE = [b"  ", b" \n", b"\n ", *(bytes([i]) for i in b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"), b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def split_at_spaces(text: str) -> list[str]:
    """The text cut at each single space that stands between two characters other than white space; these spaces are left out."""
    return _SAFE.split(text)


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A byte-level vocabulary never has a token over a single space between two characters that are not white space,
    so a text is cut there, and each part is encoded once for as long as it is remembered. With ``ranks``, the same
    vocabulary as a rank file, new parts of letters only are encoded all in one text, whose ids are dealt out by the
    lengths of the tokens, and marks that follow the letters on their own; all others are encoded one by one.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known, self.words = Tokenizer.from_file(path), {}, None
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.words = tiktoken.Encoding("words", pat_str=r" ?\p{L}+", mergeable_ranks=table, special_tokens={})
            self.size = np.zeros(max(table.values()) + 1, np.int64)
            for token, i in table.items():
                self.size[i] = len(token)
            self.marks = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, each with a space in front."""
        if not words:
            return []
        text = " " + " ".join(words)
        ids = np.array(self.words.encode_ordinary(text), "<u4")
        ends = np.append(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 32)[1:], len(text.encode()))
        to = (4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *to], to)]

    def learn(self, new: list[bytes]) -> None:
        """Remembers the ids of each part with a space in front; parts are known by their UTF-8."""
        known = self.known
        if self.words:
            text = list(map(bytes.decode, new))
            words = {b: t for b, t in zip(new, text) if t.isalpha()}
            ended, rest = [], []
            for b, t in zip(new, text):
                if b not in words:
                    base = t.rstrip(_MARKS)
                    if base and base is not t and base.isalpha():
                        k = base.encode()
                        ended.append((b, k, t[len(base) :]))
                        if k not in known:
                            words[k] = base
                    else:
                        rest.append(b)
            known.update(zip(words, self._letters(list(words.values()))))
            if len(self.marks) > 10_000:
                self.marks.clear()
            marks = list({m for *_, m in ended}.difference(self.marks))
            self.marks.update(zip(marks, self._whole(marks)))
            known.update([(p, known[b] + self.marks[m]) for p, b, m in ended])
            new = rest
        known.update(zip(new, self._whole([" " + p.decode() for p in new])))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Text by text, for any texts."""
        parts = [split_at_spaces(t) for t in texts]
        firsts = self._whole([x.pop(0) for x in parts])
        parts = [list(map(str.encode, x)) for x in parts]
        if len(self.known) > _CACHE:
            self.known.clear()
        self.learn(list(set().union(*parts).difference(self.known)))
        return [f + b"".join(map(self.known.__getitem__, x)) for f, x in zip(firsts, parts)]

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """All texts together: words are found and told apart by hash, so that each distinct one is looked up once."""
        out = [b""] * len(texts)
        every = b"x".join(texts)
        rare = [x for x in _RARE if x in every]
        plain = [i for i, t in enumerate(texts) if t and t[0] != 32 and t[-1] != 32 and not any(x in t for x in rare)]
        rest = sorted(set(range(len(texts))).difference(plain))
        for i, x in zip(rest, self.ids([texts[i].decode() for i in rest])):
            out[i] = x
        if not plain:
            return out
        joined = b" ".join([b"", *(texts[i] for i in plain), b""])
        data = np.frombuffer(joined, np.uint8)
        space = np.flatnonzero(data == 32)
        start, end = space[:-1] + 1, space[1:]
        _, at, which = np.unique(Sums(0, BYTE[data]).span(start, end), return_index=True, return_inverse=True)
        if not _same_bytes(data, start, end, at[which]):  # two words with one hash
            for i, x in zip(plain, self.ids([texts[i].decode() for i in plain])):
                out[i] = x
            return out
        words = [joined[i:j] for i, j in zip(start[at].tolist(), end[at].tolist())]
        if len(self.known) > _CACHE:
            self.known.clear()
        self.learn([w for w in words if w not in self.known])
        # The first word of a text has no space in front.
        begins = np.cumsum([0] + [len(texts[i]) + 1 for i in plain[:-1]]) + 1
        first = np.searchsorted(start, begins)
        which[first] = len(words) + np.arange(len(plain))
        found = [*map(self.known.__getitem__, words), *self._whole([joined[start[i] : end[i]].decode() for i in first])]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, offsets = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[which]
        to = np.cumsum(n)
        tokens = flat[np.repeat(offsets[which] - (to - n), n) + np.arange(to[-1])].tobytes()
        cuts = [*(4 * (to - n)[first]).tolist(), len(tokens)]
        for i, lo, hi in zip(plain, cuts, cuts[1:]):
            out[i] = tokens[lo:hi]
        return out


def _same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether each span has the bytes of the span whose number ``other`` gives."""
    n = end - start
    if (n != n[other]).any():
        return False
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return bool((data[np.repeat(start, n) + within] == data[np.repeat(start[other], n) + within]).all())


@lru_cache(2)
def encoder(path: str, ranks: str | None = None) -> Encoder:
    return Encoder(path, ranks)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole sequences, the first piece takes the rest."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


ARROW_PIECES = pa.schema([(n, pa.int32() if n == "piece" else pa.int64()) for n in (x.split()[0] for x in PIECES.split(", "))])


def _pieces(path: str, ranks: str | None, capacity: int, together: int):
    end = np.array([END], "<u4").tobytes()

    @tidied
    def run(batches):
        e, task = encoder(path, ranks), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            ids, rows = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, _, texts in utf8_groups(b.column(1), together):
                out = []
                for i, data in enumerate(e.ids_of(texts), at):
                    data += end
                    for k, (s, n) in enumerate(cut(len(data) // 4, capacity)):
                        out.append((ids[i], rows[i], k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)]), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW_PIECES)], schema=ARROW_PIECES)
        e.known.clear()  # the worker lives on, its memory is for the next task

    return run


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room 0..capacity the greatest total value that fits, and the last length put in (0: none); values[0] is that of length 1."""
    sizes = np.flatnonzero(values > 0) + 1
    worth, upto = values[sizes - 1], np.searchsorted(sizes, np.arange(capacity + 1), "right")
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], upto[c]
        if k:
            total = best[c - sizes[:k]] + worth[:k]
            j = total.argmax()
            if total[j] > best[c]:
                best[c], last[c] = total[j], sizes[j]
    return best, last


def configuration(last: np.ndarray, room: int) -> list[int]:
    """The lengths that the knapsack's table puts into so much room."""
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
        room -= int(last[room]) or 1
    return out


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Configurations (lengths, ascending) and how often each is used, so that together they cover counts[L-1] pieces of
    each length L, fractionally and without excess; and a lower bound on the number of sequences of any packing."""
    lengths = np.arange(1, capacity + 1) / capacity
    covered, used, bound = np.zeros(capacity), Counter(), float(counts @ lengths)
    for _ in range(rounds):
        short = covered < counts * (1 - 1e-9)
        if not short.any():
            break
        share = covered[short] / counts[short]
        weights = np.zeros(capacity)
        weights[short] = lengths[short] ** POWER * np.exp(-ETA * (share - share.min()))
        best, last = knapsack(weights, capacity)
        bound = max(bound, float(counts @ weights) / best[capacity])  # the weights over the best price are a dual solution
        with_each = np.where(short, weights + best[capacity - 1 :: -1][:capacity], 0)
        for first in np.argsort(-with_each, kind="stable")[:EACH] + 1:
            if with_each[first - 1] < (1 - NEAR) * best[capacity]:
                break
            config = tuple(sorted([int(first), *configuration(last, capacity - int(first))]))
            at, copies = np.unique(np.array(config) - 1, return_counts=True)
            copies = np.minimum(copies, counts[at])
            times = min((STEP * counts[at] / copies).min(), ((counts - covered)[at] / copies).min())
            if times > 0:
                covered[at] += times * copies
                used[tuple(np.repeat(at + 1, copies).tolist())] += times
    return used, bound


def best_fit(counts: np.ndarray, capacity: int) -> Counter:
    """Configurations (lengths, longest first) and how often; each piece goes where it leaves the least room."""
    room, free = [], {}
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length - 1])):
            i = bisect_left(room, length)
            if i == len(room):
                bin_, left = [], capacity
            else:
                left = room[i]
                bin_ = free[left].pop()
                if not free[left]:
                    del free[left], room[i]
            bin_.append(length)
            left -= length
            if left not in free:
                free[left] = []
                insort(room, left)
            free[left].append(bin_)
    return Counter(tuple(x) for bins in free.values() for x in bins)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, copies in a sequence, first sequence, offset of the first copy), sorted; and how many sequences there are."""
    counts = np.zeros(capacity, np.int64)
    for length, n in histogram.items():
        counts[length - 1] = n
    configs: Counter = Counter()
    if counts[-1]:
        configs[(capacity,)] = int(counts[-1])
        counts[-1] = 0
    while counts.any():
        used, _ = solve(counts, capacity)
        placed = 0
        for config, times in used.items():
            at, copies = np.unique(np.array(config) - 1, return_counts=True)
            n = int(min(times + 1e-6, (counts[at] // copies).min()))
            if n:
                configs[config[::-1]] += n
                counts[at] -= n * copies
                placed += n
        if not placed or counts.sum() <= 16 * len(used):
            break
    configs += best_fit(counts, capacity)
    rows, ranks, sequence = [], Counter(), 0
    for config, n in configs.items():
        offset = 0
        for length, copies in Counter(config).items():
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def _placed(table):
    @tidied
    def run(batches):
        rows = np.frombuffer(table.value, np.int64).reshape(-1, 5)
        starts = np.searchsorted(rows[:, 0], np.arange(rows[-1, 0] + 2)) if len(rows) else None
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            order = np.lexsort((rank, length))
            at = np.empty(len(order), np.int64)
            for n in np.unique(length):
                mine = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, "right")]
                lo, hi = starts[n], starts[n + 1]
                at[mine] = lo + np.searchsorted(rows[lo:hi, 1], rank[mine], "right") - 1
            r = rows[at]
            i = rank - r[:, 1]
            sequence, offset = r[:, 3] + i // r[:, 2], r[:, 4] + i % r[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "row", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY, together: int = TOGETHER) -> DataFrame:
    """One row per piece: doc_id, row, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then id 2; null counts as empty, so that it and the empty text are one token.
    Repeated rows and null ids are documents of their own. Texts of any length are encoded whole and cut only into
    pieces of the capacity. An empty table gives an empty result; columns other than the two named are not read.
    """
    if path is None:
        path, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")
    stage = Stage(docs.sparkSession, "pack")
    source = keyed(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with batches_of(docs.sparkSession, TEXTS):
        pieces = stage.table(source.mapInArrow(_pieces(path, ranks, capacity, together), PIECES), "pieces")
    counts = stage.table(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    rows, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    table = docs.sparkSession.sparkContext.broadcast(rows.tobytes())
    return ranked.mapInArrow(_placed(table), "doc_id long, row long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), together=3 << 20).drop("row")

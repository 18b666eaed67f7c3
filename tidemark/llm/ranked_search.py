"""Ranked lexical search over an index of shards with blocks of varying length.

The index has one row a shard, which is some megabytes of text: its terms, and for each term a list of postings
(document, impact), in the order of doc_id, cut into blocks. An impact is the score of a posting for a weight of one, so
a block's greatest impact times the weight bounds what the term can add in it. Where a list is cut decides how tight
these bounds are: dynamic programming finds the cuts with the least sum of (bound - impact) over the postings, plus a
fixed price a block, all lists of a shard side by side.

A search goes through the shards of a task one after the other and keeps its ten best documents and their least score,
the threshold. A pivot is a document that can reach it: one in a list without which the lists' bounds stay below the
threshold, and whose own value there, plus the bounds of the other lists' blocks that lie over it, reaches it. Pivots are
taken in the order of documents, and only blocks over them are opened; blocks over which all bounds are too low are
skipped. Tasks return ten rows a query at most. Shards are written, read and handed to Python one at a time, so that a
task's memory is that of a shard, however many it has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import ASCII_LOWER, Stage, batch, batches_of, tidied, utf8_groups

TOP = 10
#: Text of a shard in bytes; a longer document is a shard of its own. And its documents at most.
SHARD, DOCUMENTS = 4 << 20, 1 << 15
#: Postings of a block at most, and the price of a block in units of impact.
LONGEST, PRICE = 64, 1_000_000
#: Queries that are searched in one pass over the index, and the bytes of their texts.
QUERIES, QUERY_BYTES = 4096, 8 << 20
#: Pivots that are scored together.
TOGETHER = 256

_TERM = np.zeros(256, bool)
_TERM[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts one after the other, and how many each text has."""
    data = _LOWER[np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)] if texts else np.zeros(1, np.uint8)
    term = _TERM[data]
    start, end = np.flatnonzero(~term[:-1] & term[1:]) + 1, np.flatnonzero(term[:-1] & ~term[1:]) + 1
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[term])])
    edges = np.searchsorted(start, np.cumsum([1] + [len(t) + 1 for t in texts]))
    return found, np.diff(edges)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(1000000000 tf) div (1000 tf + 8 m), where m = 10 + (90 n documents) div length."""
    m = 10 + 90 * n.astype(np.int64) * documents // max(1, length)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def cut_blocks(impact: np.ndarray, sizes: np.ndarray, longest: int = LONGEST, price: int = PRICE) -> np.ndarray:
    """The places among all postings where blocks end, for lists of these sizes one after the other.

    For each list, the blocks of at most ``longest`` postings with the least sum of (greatest impact - impact), plus the
    price of each. cost[i], the least for the first i postings, is worked out for all lists at once, longest first.
    """
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    order = np.argsort(-sizes, kind="stable")
    ends = []
    for group in np.split(order, np.flatnonzero(np.diff(np.floor(np.log2(np.maximum(sizes[order], 1))))) + 1) if len(order) else ():
        n, k = sizes[group], len(group)
        most, w = int(n.max(initial=0)), min(longest, int(n.max(initial=0)))
        if most == 0:
            continue
        step = max(1, (1 << 22) // most)
        for at in range(0, k, step):  # lists of about one length, a bounded number together
            some, size = group[at : at + step], n[at : at + step]
            lists = np.zeros((len(some), most), np.int64)
            inside = np.arange(most) < size[:, None]
            lists[inside] = impact[(first[some][:, None] + np.arange(most))[inside]]
            cost = np.full((len(some), w + most + 1), np.int64(1) << 61)  # cost[:, w + i] is that of i postings
            cost[:, w] = 0
            back = np.zeros((len(some), most + 1), np.int32)
            tallest, lengths = np.zeros((len(some), w), np.int64), np.arange(1, w + 1)
            for i in range(1, most + 1):
                live = int(np.searchsorted(-size, -i, "right"))  # sizes fall, so these are the first ones
                x = lists[:live, i - 1]
                tallest[:live, 1:] = np.maximum(tallest[:live, :-1], x[:, None])
                tallest[:live, 0] = x
                total = cost[:live, i : w + i][:, ::-1] + lengths * tallest[:live]
                j = total.argmin(axis=1)
                cost[:live, w + i] = total[np.arange(live), j] + price
                back[:live, i] = j + 1
            where, rows = size.copy(), np.arange(len(some))
            while len(rows):
                ends.append(first[some[rows]] + where[rows])
                where[rows] -= back[rows, where[rows]]
                rows = rows[where[rows] > 0]
    return np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)


#: terms sorted; sizes, numbers of blocks and postings run in the order of the terms. docs are places in doc_id.
INDEX = pa.schema(
    [("shard", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), ("blocks", pa.list_(pa.int32()))]
    + [(n, pa.binary()) for n in ("ends", "tops", "docs", "impacts")]
)
INDEX_SQL = "shard long, doc_id array<long>, terms array<binary>, sizes array<int>, blocks array<int>, ends binary, tops binary, docs binary, impacts binary"


def shard_row(number: int, ids: list[int | None], texts: list[bytes], documents: int, length: int) -> pa.RecordBatch:
    """The index of some documents; those without a term are left out."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids, (found, n) = [ids[i] for i in order], words([texts[i] for i in order])
    coded = found.dictionary_encode()
    names = coded.dictionary
    by_name = pc.sort_indices(names).to_numpy()
    place = np.empty(len(by_name), np.int64)
    place[by_name] = np.arange(len(by_name))
    key = place[coded.indices.to_numpy()] * len(ids) + np.repeat(np.arange(len(ids)), n)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // max(1, len(ids)), key % max(1, len(ids))
    impact = impacts(tf, n[doc], documents, length)
    sizes = np.bincount(term, minlength=len(names))
    ends = cut_blocks(impact, sizes)
    first = np.concatenate(([0], ends))[:-1].astype(np.int64)
    blocks = np.bincount(term[first], minlength=len(names)) if len(first) else np.zeros(len(names), np.int64)
    tops = np.maximum.reduceat(impact, first) if len(first) else impact
    raw = [ends.astype(np.int32), tops.astype(np.int32), doc.astype(np.uint16), impact.astype(np.int32)]
    return batch(INDEX, [number], [ids], pa.array([names.take(pa.array(by_name)).to_pylist()], pa.list_(pa.binary())), [sizes], [blocks], *[[x.tobytes()] for x in raw])


def _indexer(documents: int, length: int):
    @tidied
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, texts in utf8_groups(b.column(1), SHARD):
                for k in range(0, len(texts), DOCUMENTS):
                    yield shard_row(number, ids[i + k : min(j, i + k + DOCUMENTS)], texts[k : k + DOCUMENTS], documents, length)
                    number += 1

    return run


def _counted(batches):
    for b in batches:
        for *_, texts in utf8_groups(b.column(0), SHARD):
            _, n = words(texts)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["documents", "length"])


class Index:
    """The table of shards, the number of documents with a term and of all their terms."""

    def __init__(self, table: DataFrame, documents: int, length: int):
        self.table, self.documents, self.length = table, documents, length


def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Index:
    """Indexes every row in two passes, without a shuffle: counts first, since impacts rest on the mean length."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = source.select("text").mapInArrow(_counted, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()
    documents, length = (x or 0 for x in total)
    table = Stage(docs.sparkSession, "index").table(source.mapInArrow(_indexer(documents, length), INDEX_SQL), "shards", group=1)
    return Index(table, documents, length)


def query_terms(text: str | None) -> list[bytes]:
    """Distinct terms."""
    return sorted(set(words([(text or "").encode()])[0].to_pylist()))


def _frequencies(vocabulary):
    @tidied
    def run(batches):
        terms = pa.array(vocabulary.value, pa.binary())
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for row in range(b.num_rows):
                at = pc.index_in(b.column(0)[row].values, value_set=terms)
                known = at.is_valid().to_numpy(zero_copy_only=False)
                total[at.drop_null().to_numpy()] += b.column(1)[row].values.to_numpy()[known]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    return run


class Shard:
    """One row of the index, ready to be searched."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.ids = row["doc_id"].values
        self.n = len(self.ids)
        self.terms = row["terms"].values
        self.first = np.concatenate(([0], np.cumsum(row["sizes"].values.to_numpy(), dtype=np.int64)))
        self.first_block = np.concatenate(([0], np.cumsum(row["blocks"].values.to_numpy(), dtype=np.int64)))
        self.ends, self.tops, self.docs, self.impacts = (np.frombuffer(row[k].as_buffer(), t) for k, t in zip(("ends", "tops", "docs", "impacts"), (np.int32, np.int32, np.uint16, np.int32)))
        start = np.concatenate(([0], self.ends))[:-1].astype(np.int64)
        self.block_from = self.docs[start].astype(np.int64) if len(start) else start
        self.block_to = self.docs[self.ends - 1].astype(np.int64) if len(start) else start
        #: Each term's greatest impact anywhere in the shard.
        self.top = np.maximum.reduceat(self.tops, self.first_block[:-1]) if len(self.tops) else self.tops

    def places(self, vocabulary: pa.Array) -> np.ndarray:
        """Where each term of the queries stands here, or -1."""
        return pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy()

    def search(self, at: np.ndarray, weight: np.ndarray, best: list[tuple[int, int, int]], top: int = TOP) -> int:
        """Puts this shard's documents among best, which has (score, whether the id is null, id), highest first; returns how many it scored."""
        least = lambda: best[-1][0] if len(best) == top else 1
        most = weight * self.top[at] if len(at) else np.zeros(0, np.int64)
        if int(most.sum()) < least():
            return 0
        order = np.argsort(most, kind="stable")
        scored = self._ahead(at, weight, order, best, top) if len(best) < top else np.zeros(0, np.int64)
        # lists whose bounds together stay below the threshold cannot bring a document into the result by themselves
        needed = np.zeros(len(at), bool)
        needed[order[np.cumsum(most[order]) >= least()]] = True
        bound = self._bounds(at, weight)
        hopeful = np.concatenate(([0], np.cumsum(bound >= least())))
        partial = np.zeros(self.n, np.int64)
        block, w = self._blocks(at[needed], weight[needed])
        some = hopeful[self.block_to[block] + 1] > hopeful[self.block_from[block]]  # others are skipped
        doc, value = self._open(block[some], w[some])
        np.add.at(partial, doc, value)
        pivot = partial > 0
        pivot[scored] = False
        bound = partial + self._bounds(at[~needed], weight[~needed])
        count, now = len(scored), 0
        while now < self.n:
            pivots = np.flatnonzero(pivot[now:] & (bound[now:] >= least()))[:TOGETHER] + now
            if not len(pivots):
                break
            self._score(pivots, at, weight, best, top)
            count += len(pivots)
            now = int(pivots[-1]) + 1
        return count

    def _blocks(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of some lists, each with its list's weight."""
        b0, b1 = self.first_block[at], self.first_block[at + 1]
        return _ranges(b0, b1), np.repeat(weight, b1 - b0)

    def _open(self, block: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and what they get from the postings of some blocks."""
        start = np.where(block > 0, self.ends[block - 1], 0)
        posting = _ranges(start, self.ends[block])
        return self.docs[posting].astype(np.int64), np.repeat(weight, self.ends[block] - start) * self.impacts[posting]

    def _bounds(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sum over the blocks that lie over each document of their greatest values."""
        block, w = self._blocks(at, weight)
        rise = np.zeros(self.n + 1, np.int64)
        np.add.at(rise, self.block_from[block], w * self.tops[block])
        np.add.at(rise, self.block_to[block] + 1, -w * self.tops[block])
        return np.cumsum(rise[:-1])

    def _ahead(self, at, weight, order, best: list, top: int) -> np.ndarray:
        """Scores some documents that stand high in the lists of the greatest values, to raise the threshold first."""
        partial = np.zeros(self.n, np.int64)
        for k in order[::-1]:
            np.add.at(partial, *self._open(*self._blocks(at[k : k + 1], weight[k : k + 1])))
            if np.count_nonzero(partial) >= 4 * top:
                break
        seen = np.flatnonzero(partial)
        seen = np.sort(seen[np.argsort(-partial[seen], kind="stable")[: 2 * top]])
        self._score(seen, at, weight, best, top)
        return seen

    def _score(self, docs: np.ndarray, at: np.ndarray, weight: np.ndarray, best: list, top: int) -> None:
        if not len(docs):
            return
        block, w = self._blocks(at, weight)
        over = np.searchsorted(docs, self.block_from[block], "left") < np.searchsorted(docs, self.block_to[block], "right")
        total = np.zeros(self.n, np.int64)
        np.add.at(total, *self._open(block[over], w[over]))  # only blocks that lie over a pivot
        score = total[docs]
        least = best[-1][0] if len(best) == top else 1
        for d, s in zip(docs[score >= least].tolist(), score[score >= least].tolist()):
            i = self.ids[d].as_py()
            best.append((s, i is None, i or 0))
        best.sort(key=lambda r: (-r[0], r[1], r[2]))
        del best[top:]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1 and so on."""
    n = end - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searcher(plan, top: int):
    @tidied
    def run(batches):
        vocabulary, queries = plan.value
        terms = pa.array([t for t, _ in vocabulary], pa.binary())
        weight = np.array([w for _, w in vocabulary], np.int64)
        best: list[list] = [[] for _ in queries]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard({n: b.column(k)[i] for k, n in enumerate(b.schema.names)})
                place = shard.places(terms)
                for q, held in zip(queries, best):
                    at = place[q]
                    shard.search(at[at >= 0], weight[q[at >= 0]], held, top)
        rows = [(k, None if none else i, s) for k, held in enumerate(best) for s, none, i in held]
        yield batch(FOUND, *(zip(*rows) if rows else ((), (), ())))

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def search(index: Index, queries: list[str | None], top: int = TOP) -> DataFrame | None:
    """(query, doc_id, score): the best documents of each task for each query, which hold the best of all. One pass over the index.

    To be called and run within ``batches_of(spark, 1)``, which gives Python one shard at a time.
    """
    spark = index.table.sparkSession
    terms = [query_terms(q) for q in queries]
    vocabulary = sorted({t for q in terms for t in q})
    if not vocabulary or not index.documents:
        return None
    counted = index.table.select("terms", "sizes").mapInArrow(_frequencies(spark.sparkContext.broadcast(vocabulary)), "term long, df long")
    df = dict(counted.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator())  # one row a term of the queries
    weighed = [(vocabulary[i], weight(index.documents, n)) for i, n in sorted(df.items())]
    at = {t: i for i, (t, _) in enumerate(weighed)}
    plan = spark.sparkContext.broadcast((weighed, [np.array([at[t] for t in q if t in at], np.int64) for q in terms]))
    columns = [f.name for f in INDEX]
    return index.table.select(*columns[1:]).mapInArrow(_searcher(plan, top), "query long, doc_id long, score long")


def _in_blocks(items: DataFrame):
    """Lists of (id, text), each of a bounded number of rows and bytes; a longer text is alone."""
    held, size = [], 0
    for r in items.toLocalIterator():
        n = len(r[1] or "")
        if held and (len(held) == QUERIES or size + n > QUERY_BYTES):
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += n
    if held:
        yield held


def ranked_search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item: str = "item_id", query: str = "text", top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's best documents with a score above zero.

    Null texts and items have no terms; an item without a term that the documents have gives no row. Equal scores
    are in the order of doc_id, null last; rows that repeat a document are documents of their own, and items that
    repeat an id are items of their own. Texts of any length count whole. Queries are taken in blocks of bounded size,
    each against all shards. Empty tables give an empty result; columns other than those named are not read.
    """
    spark, index, found, stage = docs.sparkSession, build(docs, text, doc_id), None, Stage(docs.sparkSession, "found")
    for block in _in_blocks(items.select(F.col(item).cast("long"), F.col(query))):
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "query long, item_id long")  # at most QUERIES rows
        with batches_of(spark, 1):
            some = search(index, [q for _, q in block], top)
            if some is None:
                continue
            ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            best = some.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
            part = stage.table(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "best")
        found = part if found is None else found.unionByName(part)
    stage.drop(index.table)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {terms} AS w FROM documents),
n AS MATERIALIZED (SELECT doc_id, r, len(w) AS n FROM d WHERE len(w) > 0),
t AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
i AS (SELECT item, item_id, unnest(list_distinct({terms})) AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)),
s AS (SELECT item, item_id, doc_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN p USING (term) JOIN n USING (r), t GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= {TOP}"""


ORACLE = {"op11_ranked_search": _sql()}

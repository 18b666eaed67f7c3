"""Repeated passages by de Bruijn compaction.

A window of 20 words is an edge of the de Bruijn graph. Consecutive windows of a document that share their
minimizer (of the 6-word grams in a window, the least hash) are one path without branches inside the document; such
a path is compacted into one row, known by 128 bits of two independent hashes of its words.

1. A scan finds the minimizers that occur more than once; only paths around these can repeat.
2. A second scan emits the paths with such a minimizer. A bitmap lets them through, which is sized by their number;
   where they are too many for one, a join does. Grouped by their hash they are the distinct paths, each with its
   first place by (doc_id, row, start).
3. A minimizer with several distinct paths is a branch. Of each distinct path there, the first place is expanded
   into single windows; what comes later is the same path again and is compared whole. Where all paths of a
   minimizer are the same, the compacted rows have said everything.
4. Repeated paths and expanded windows go back to the texts by their coordinates, where SHA-256 of the words is
   taken. This verifies them, as only then are spans grouped, by SHA-256. The first place is the source, and a join
   hands its coordinates to the later ones.
5. The spans are gathered by document and joined to the texts; words that they cover go. Texts without a request,
   or without a span, cross no shuffle.

Each grouping is pre-aggregated, so a passage that a third of all documents share crosses a shuffle once a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Bitmap, Stage, batch, fresh, mix64, numbered, rows_of, tidied, utf8_groups
from tidemark.llm.hashing import Sums, word_hashes

WINDOW, GRAM = 20, 6
#: Documents are hashed together up to so many bytes; a longer one is hashed alone.
TOGETHER = 1 << 20

_GRAM = np.random.default_rng(20).integers(1 << 62, 1 << 63, GRAM, dtype=np.uint64) | np.uint64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Paths:
    """The compacted paths of some documents: document, first window, number of windows, minimizer.

    A path is a run of windows whose minimizer stands at the same place, of equal grams the leftmost; so no two
    windows of a path are equal.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        first = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.document = np.searchsorted(first, start, "right") - 1
        self.first_word = np.searchsorted(start, first[:-1])
        n = max(0, len(start) - WINDOW + 1)
        valid = np.flatnonzero(self.document[:n] == self.document[WINDOW - 1 :][:n])
        word, other = word_hashes(data, start, end)
        self.hashes = Sums(1, word), Sums(2, other)
        if not len(valid):
            self.start = self.length = valid
            self.minimizer = valid.astype(np.uint64)
            return
        grams = np.zeros(len(word) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            grams += word[j : j + len(grams)] * _GRAM[j]
        least, at, width = mix64(grams), np.arange(len(grams), dtype=np.int32), 1
        while width < (full := WINDOW - GRAM + 1):
            by = min(width, full - width)
            left = least[:-by] <= least[by:]
            least, at, width = np.where(left, least[:-by], least[by:]), np.where(left, at[:-by], at[by:]), width + by
        m, at = least[valid], at[valid]
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(valid) > 1)])
        self.start, self.length, self.minimizer = valid[new], np.diff(new, append=len(valid)), m[new]

    def place(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word within it."""
        d = self.document[start]
        return d, start - self.first_word[d]

    def hash(self, start: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each span of so many words."""
        return tuple(h.span(start, start + words).view(np.int64) for h in self.hashes)


def _documents(batches):
    """(doc_ids, rows, Paths) of documents taken together."""
    for b in batches:
        for i, j, texts in utf8_groups(b.column(1), TOGETHER):
            yield b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), Paths(texts)


@tidied
def _minimizers(batches):
    for *_, p in _documents(batches):
        values, counts = np.unique(p.minimizer, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int8))], names=["m", "n"])


def _spans(ids, rows, p: Paths, start: np.ndarray, length: np.ndarray, minimizer: np.ndarray) -> pa.RecordBatch:
    document, word = p.place(start)
    document = pa.array(document)
    columns = [*p.hash(start, length + WINDOW - 1), ids.take(document), rows.take(document), word.astype(np.int32), length.astype(np.int32), minimizer.view(np.int64)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["h1", "h2", "doc_id", "row", "start", "length", "m"])


def _paths(bitmap):
    """Paths whose minimizer the bitmap has; all without one."""

    @tidied
    def run(batches):
        for ids, rows, p in _documents(batches):
            k = bitmap.value.has(p.minimizer) if bitmap else np.ones(len(p.start), bool)
            yield _spans(ids, rows, p, p.start[k], p.length[k], p.minimizer[k])

    return run


SPANS = "h1 long, h2 long, doc_id long, row long, start int, length int, m long"


def _around(source: DataFrame, minimizers: DataFrame, most: int | None) -> DataFrame:
    """Paths with one of these minimizers, and perhaps a few more."""
    bitmap = Bitmap.of(minimizers, "m", most)
    shared = source.sparkSession.sparkContext.broadcast(bitmap) if bitmap else None
    found = source.select("doc_id", "text", "row").mapInArrow(_paths(shared), SPANS)
    return found if bitmap else found.join(minimizers, "m", "left_semi").select("h1", "h2", "doc_id", "row", "start", "length", "m")


@tidied
def _digests(batches):
    """128 bits of SHA-256 of the words at each coordinate, of single windows where these are asked for."""
    for b in batches:
        for i, j, texts in utf8_groups(b.column(1), TOGETHER):
            asked = b.column(3).slice(i, j - i)
            start, length, single = (asked.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            document = np.repeat(np.arange(j - i), np.diff(asked.offsets.to_numpy()))
            n = np.where(single == 1, length, 1)
            start, document = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(document, n)
            length = np.repeat(np.where(single == 1, 1, length), n)
            at, keys = np.searchsorted(document, np.arange(len(texts) + 1)), []
            for t, lo, hi in zip(texts, at, at[1:]):
                words = t.split()
                joined, to = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])
                first = to[start[lo:hi]].tolist()
                last = (to[start[lo:hi] + length[lo:hi] + WINDOW - 1] - 1).tolist()
                keys += [hashlib.sha256(joined[x:y]).digest()[:16] for x, y in zip(first, last)]
            key, document = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2), pa.array(document + i)
            columns = [np.ascontiguousarray(key[:, 0]), np.ascontiguousarray(key[:, 1]), b.column(0).take(document), b.column(2).take(document), start.astype(np.int32), length.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["k1", "k2", "doc_id", "row", "start", "length"])


def repeated_spans(source: DataFrame, stage: Stage, most: int | None = None) -> DataFrame:
    """(row, start, length, source_row, source_start) of source(doc_id, text, row): from start on, length windows in a
    row have started earlier at the source. Up to ``most`` minimizers are told to the tasks by a bitmap."""
    seen = source.select("doc_id", "text", "row").mapInArrow(_minimizers, "m long, n byte")
    minimizers = stage.table(seen.groupBy("m").agg(F.sum("n").alias("n")).where("n > 1").select("m"), "minimizers")
    paths = stage.table(_around(source, minimizers, most), "paths")
    stage.drop(minimizers)
    place = F.min(F.struct("doc_id", "row", "start", "length", "m")).alias("first")
    distinct = stage.table(paths.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), place), "distinct")
    branches = distinct.groupBy("first.m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m")
    repeated = distinct.where("n > 1").select("h1", "h2")
    whole = paths.select("h1", "h2", "row", "start", "length").join(repeated, ["h1", "h2"]).select("row", "start", "length", F.lit(False).alias("single"))
    expanded = distinct.select("first.row", "first.start", "first.length", "first.m").join(branches, "m").select("row", "start", "length", F.lit(True).alias("single"))
    asked = stage.table(whole.unionByName(expanded), "asked")
    stage.drop(paths, distinct)

    # A document's requests are two a window at most.
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("start", "length", "single")).alias("asked"))
    touched = stage.table(asked.select("row").distinct(), "touched")
    texts = rows_of(source, touched).join(by_row, "row").select("doc_id", "text", "row", "asked")
    digests = stage.table(texts.mapInArrow(_digests, "k1 long, k2 long, doc_id long, row long, start int, length int"), "digests")
    stage.drop(asked)
    first = digests.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stage.table(first.select("k1", "k2", F.col("first.row").alias("source_row"), F.col("first.start").alias("source_start")), "first")
    joined = digests.select("k1", "k2", "row", "start", "length").join(first, ["k1", "k2"]).where("row <> source_row or start <> source_start")
    out = stage.table(joined.select("row", "start", "length", "source_row", "source_start"), "later")
    stage.drop(digests, first)
    return out


OUT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def kept_words(words: list[bytes], start: np.ndarray, length: np.ndarray) -> list[bytes]:
    """The words that no span covers."""
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length + WINDOW - 1, -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


def _with_spans(texts: pa.Array, spans: pa.Array):
    """(from, to, [(words, start, length) of each text]) of runs of rows; a null list of spans is an empty one."""
    for i, j, some in utf8_groups(texts, TOGETHER):
        mine = spans.slice(i, j - i)
        flat = mine.flatten()
        start, length = (flat.field(k).to_numpy().astype(np.int64) for k in range(2))
        at = np.cumsum(np.r_[0, pc.fill_null(pc.list_value_length(mine), 0).to_numpy(zero_copy_only=False)])
        yield i, j, [(t.split(), start[lo:hi], length[lo:hi]) for t, lo, hi in zip(some, at, at[1:])]


@tidied
def _kept(batches):
    """Words that no span covers, joined by one space."""
    for b in batches:
        for i, j, found in _with_spans(b.column(1), b.column(3)):
            left = [kept_words(words, start, length) if len(start) else words for words, start, length in found]
            n_words = [len(words) for words, *_ in found]
            yield batch(OUT, b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), n_words, [n - len(x) for n, x in zip(n_words, left)], [b" ".join(x) for x in left])


def cut_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scan: bool = False) -> DataFrame:
    """The documents with all their columns; where words repeat, the text is what substring_dedup keeps, and n_chars
    its length if there is such a column. Others stay as they are, a document that has nothing left with an empty text."""
    stage, name = Stage(docs.sparkSession, "substring"), fresh(docs, "row")
    listed, changed = fresh(docs, "spans"), fresh(docs, "cut")
    source = numbered(docs, stage, *[F.col(f"`{c}`") for c in docs.columns], scan=scan, name=name)
    spans = repeated_spans(source.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(name).alias("row")), stage)
    by_row = spans.groupBy(F.col("row").alias(name)).agg(F.collect_list(F.struct("start", "length")).alias(listed))
    rows, at, names = stage.table(spans.select("row").distinct(), "rows"), docs.columns.index(text), [*docs.columns, changed]

    @tidied
    def run(batches):
        for b in batches:
            spans, columns = b.column(b.num_columns - 1), [b.column(i) for i in range(b.num_columns - 1)]
            for i, j, found in _with_spans(b.column(at), spans):
                some = [c.slice(i, j - i) for c in columns]
                some[at] = pa.array([b" ".join(kept_words(*x)).decode() if len(x[1]) else old for x, old in zip(found, some[at].to_pylist())], some[at].type)
                yield pa.RecordBatch.from_arrays([*some, pa.array([len(x[1]) > 0 for x in found], pa.bool_())], names=names)

    touched = rows_of(source, rows, True, name).join(by_row, name).drop(name)
    touched = touched.mapInArrow(run, touched.drop(listed).withColumn(changed, F.lit(True)).schema)
    chars = lambda c: F.when(F.col(changed), F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
    touched = touched.select(*[chars(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
    return touched.unionByName(rows_of(source, rows, False, name).select(*[F.col(f"`{c}`") for c in docs.columns]))


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scan: bool = False, most: int | None = None) -> DataFrame:
    """One row per input row: doc_id, row, n_words, n_removed and kept, the UTF-8 of the remaining words.

    Words are runs of bytes other than ASCII white space; null has none. Each word covered by a window of 20 words
    whose sequence also starts earlier goes; earlier means a smaller doc_id (null before any other), among repeated
    ids the smaller row number, within a document the smaller start. Texts of fewer than 20 words stay whole, and
    texts of any length count whole. An empty table gives an empty result, and columns other than the two named are
    not read. ``scan``: docs is a plain scan of files, which can be read again without a copy (see common.numbered).
    """
    stage = Stage(docs.sparkSession, "substring")
    source = numbered(docs, stage, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), scan=scan)
    spans = repeated_spans(source, stage, most)
    rows, none = stage.table(spans.select("row").distinct(), "rows"), F.array().cast("array<struct<start: int, length: int>>")
    cut = rows_of(source, rows).join(spans.groupBy("row").agg(F.collect_list(F.struct("start", "length")).alias("spans")), "row").select("doc_id", "text", "row", "spans")
    whole = rows_of(source, rows, False).select("doc_id", "text", "row", none.alias("spans"))
    schema = "doc_id long, row long, n_words long, n_removed long, kept binary"
    return cut.unionByName(whole).mapInArrow(_kept, schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), scan=True)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op3_substring_dedup": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, r, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: struct_pack(s := i, g := array_to_string(w[i : i + {WINDOW - 1}], ' ')))) AS x FROM d),
later AS (SELECT r, x.s AS s FROM g QUALIFY row_number() OVER (PARTITION BY x.g ORDER BY doc_id, r, x.s) > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS p FROM later),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)"""
}

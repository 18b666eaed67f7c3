"""Folds along ordered groups of which one group is many tasks.

Rows are laid out by range of (keys, order) into sorted partitions and checkpointed there, so that the layout stands
still. A fold is then a scan in two passes: each partition says what its first and its last group do to a state, which is
one row a partition; the driver carries the state along these rows; and each partition, given the state with which its
first group comes in, gives every row its value. Only a partition's first group can have rows in an earlier one.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

PART = "_part"
#: Groups of equal values of at least so many rows are counted beforehand; smaller ones are held back until they end.
BIG = 4096


def checkpoint_folder(spark) -> None:
    """Sets the folder of checkpoints where the session has none; it is shared, but on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/tidemark"
    sc.setCheckpointDir(root)
    path = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)  # this application's own folder


def laid_out(df: DataFrame, keys: list[str], order: list[str] = (), parts: int | None = None) -> DataFrame:
    """df in partitions by range of (keys, order), each sorted, with its number in ``_part``."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    by = [F.col(f"`{c}`") for c in [*keys, *order]]
    ranged = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by) if by else df.coalesce(1)
    return ranged.sortWithinPartitions(*by).withColumn(PART, F.spark_partition_id()).checkpoint()


def starts(columns: list[pa.Array], n: int) -> np.ndarray:
    """The places at which one of the columns changes, and 0."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, n - 1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def pieces(batch: pa.RecordBatch, keys: list[str]):
    """(key, rows) of each run of one key in a batch."""
    columns = [batch.column(k) for k in keys]
    first = starts(columns, batch.num_rows)
    for a, b in zip(first, [*first[1:], batch.num_rows]):
        yield tuple(c[int(a)].as_py() for c in columns), batch.slice(int(a), int(b - a))


class Fold:
    """What a scan computes. A summary says what consecutive rows of a group do to the state; None is the state before the first row."""

    def summarise(self, summary, rows: pa.RecordBatch, part: int | None):
        """The summary with further rows; part is the partition's number where the group is its first, else None."""
        raise NotImplementedError

    def carry(self, state, summary):
        """The state after the rows of a summary."""
        raise NotImplementedError

    def apply(self, state, rows: pa.RecordBatch, part: int | None):
        """(a list of result columns, the state after the rows)."""
        raise NotImplementedError


def _ends(fold: Fold, keys: list[str]):
    def run(batches):
        key, part, summary, first = None, None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            found = list(pieces(b, keys))
            for i, (k, rows) in enumerate(found):
                if part is None:
                    part = rows.column(PART)[0].as_py()
                elif k != key:
                    first = first or (key, summary)
                    summary = None
                    if i < len(found) - 1:  # neither the first nor the last group
                        key = k
                        continue
                key = k
                summary = fold.summarise(summary, rows, None if first else part)
        if part is not None:
            last = (key, summary)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps((first or last, last, first is None))], pa.binary())], names=["part", "ends"])

    return run


def carries(laid: DataFrame, keys: list[str], fold: Fold) -> dict[int, object]:
    """The state with which the first group of each partition comes in, where it began in an earlier one."""
    found = laid.mapInArrow(_ends(fold, keys), "part long, ends binary").collect()  # one row a partition
    out, state, key = {}, None, None
    for r in sorted(found):
        (first, gained), (last, final), single = pickle.loads(r.ends)
        come = state if first == key else None
        if first == key:
            out[r.part] = state
        state, key = fold.carry(come, gained) if single else fold.carry(None, final), last
    return out


def scan(laid: DataFrame, keys: list[str], fold: Fold, results: str, keep: list[str] | None = None) -> DataFrame:
    """The laid out rows with the fold's results, "name type, ..."; keep names the columns that stay."""
    spark = laid.sparkSession
    carried = spark.sparkContext.broadcast(carries(laid, keys, fold))
    keep = [c for c in laid.columns if c != PART] if keep is None else keep
    added = spark.createDataFrame([], results).schema

    def run(batches):
        key, state, part, first = None, None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            made = []
            for k, rows in pieces(b, keys):
                if part is None:
                    part, key = rows.column(PART)[0].as_py(), k
                    state = carried.value.get(part)
                elif k != key:
                    key, state, first = k, None, False
                out, state = fold.apply(state, rows, part if first else None)
                made.append(out)
            columns = [pa.concat_arrays([pa.array(m[i]) if not isinstance(m[i], pa.Array) else m[i] for m in made]) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, *added.names])

    return laid.mapInArrow(run, StructType([laid.schema[c] for c in keep] + added.fields))


class Number(Fold):
    """Places within the group, from 0."""

    def summarise(self, summary, rows, part):
        return (summary or 0) + rows.num_rows

    def carry(self, state, summary):
        return (state or 0) + summary

    def apply(self, state, rows, part):
        n = state or 0
        return [pa.array(np.arange(n, n + rows.num_rows))], n + rows.num_rows


class Before(Fold):
    """The sum of a whole-number column over the rows before, within the group."""

    def __init__(self, c: str):
        self.c = c

    def summarise(self, summary, rows, part):
        return (summary or 0) + pc.sum(rows.column(self.c)).as_py()

    def carry(self, state, summary):
        return (state or 0) + summary

    def apply(self, state, rows, part):
        n = rows.column(self.c).to_numpy()
        after = (state or 0) + np.cumsum(n)
        return [pa.array(after - n)], int(after[-1])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "_n") -> DataFrame:
    """Adds the place of each row within its keys, from 0."""
    return scan(laid_out(df, keys, order), keys, Number(), f"`{out}` long")


def _ties(keys: list[str], c: str):
    """What a partition tells of its groups of equal values: the first and the last of them with their counts, the
    rows of its first and last key, and the counts of the big ones."""

    def run(batches):
        part, first_tie, tie, count, first_key, key, rows, big = None, None, None, 0, None, None, 0, {}

        def close():
            nonlocal first_tie
            first_tie = first_tie or (tie, count)
            if count >= BIG:
                big[tie] = count

        for b in batches:
            if not b.num_rows:
                continue
            by = [b.column(k) for k in keys]
            at = starts([*by, b.column(c)], b.num_rows)
            sizes = np.diff(at, append=b.num_rows)
            # of the groups in a batch, only the first, the last and the big ones are looked at by themselves
            wanted = sorted({0, len(at) - 1, *np.flatnonzero(sizes >= BIG).tolist()} | ({1} if len(at) > 1 else set()))
            for i in wanted:
                k = tuple(x[int(at[i])].as_py() for x in by)
                t = (k, b.column(c)[int(at[i])].as_py())
                if part is None:
                    part, tie, count = b.column(PART)[0].as_py(), t, 0
                elif t != tie:
                    close()
                    tie, count = t, 0
                count += int(sizes[i])
            for k, piece in pieces(b, keys):
                if key is None or k != key:
                    first_key = first_key or ((key, rows) if key is not None else None)
                    key, rows = k, 0
                rows += piece.num_rows
        if part is not None:
            close()
            single = first_key is None
            told = (first_tie, (tie, count), first_tie[0] == tie, first_key or (key, rows), (key, rows), single, big)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps(told)], pa.binary())], names=["part", "told"])

    return run


def average_ranks(df: DataFrame, c: str, keys: list[str], out: str) -> DataFrame:
    """Adds the average rank of c, which is never missing, within the keys.

    Neither a large group of keys nor one of equal values is in one task: rows of equal values are spread by a hash of
    all their columns. df is planned once, apart from the sample that finds the ranges.
    """
    salted = df.withColumn("_salt", F.xxhash64(*[F.col(f"`{x}`") for x in df.columns]))
    laid = laid_out(salted, [*keys, c], ["_salt"])
    told = {r.part: pickle.loads(r.told) for r in laid.mapInArrow(_ties(keys, c), "part long, told binary").collect()}  # one row a partition
    at = sorted(told)
    known = {p: {"rows": 0, "before": 0, "after": 0, "big": told[p][6]} for p in at}
    key, rows, tie, count = None, 0, None, 0
    for p in at:
        first_tie, last_tie, one_tie, first_key, last_key, one_key, _ = told[p]
        if first_key[0] == key:
            known[p]["rows"] = rows
        if first_tie[0] == tie:
            known[p]["before"] = count
        rows, key = last_key[1] + (known[p]["rows"] if one_key else 0), last_key[0]
        count, tie = last_tie[1] + (known[p]["before"] if one_tie else 0), last_tie[0]
    tie, count = None, 0
    for p in reversed(at):
        first_tie, last_tie, one_tie, *_ = told[p]
        if last_tie[0] == tie:
            known[p]["after"] = count
        count, tie = first_tie[1] + (known[p]["after"] if one_tie else 0), first_tie[0]
    ends = {p: (told[p][0][0], told[p][1][0]) for p in at}
    shared = df.sparkSession.sparkContext.broadcast((known, ends))
    keep = df.columns

    def run(batches):
        part, key, place, tie, inside = None, None, 0, None, 0
        held: list[pa.RecordBatch] = []

        def ranks(b: pa.RecordBatch) -> pa.RecordBatch:
            """Of rows whose groups of equal values end with them, or are big."""
            nonlocal part, key, place, tie, inside
            if part is None:
                part = b.column(PART)[0].as_py()
                place = shared.value[0][part]["rows"]
                key = tuple(b.column(k)[0].as_py() for k in keys)
            mine, (first, last) = shared.value[0][part], shared.value[1][part]
            by = [b.column(k) for k in keys]
            at = starts([*by, b.column(c)], b.num_rows)
            new_key = np.isin(at, starts(by, b.num_rows))
            sizes = np.diff(at, append=b.num_rows).astype(np.int64)
            total, gone = sizes.copy(), np.zeros(len(at), np.int64)  # rows of the group, and of these those before this batch
            name = lambda i: (tuple(x[int(at[i])].as_py() for x in by), b.column(c)[int(at[i])].as_py())
            for i in sorted({0, len(at) - 1, *np.flatnonzero(sizes >= BIG).tolist()}):
                t = name(i)
                whole = mine["big"].get(t, int(sizes[i]))
                gone[i] = inside if t == tie else 0
                total[i] = whole
                if t == first:
                    total[i] += mine["before"]
                    gone[i] += mine["before"]
                if t == last:
                    total[i] += mine["after"]
                if i == len(at) - 1:
                    inside = (inside if t == tie else 0) + int(sizes[i])
                    tie = t
            if key != name(0)[0]:
                place, key = 0, name(0)[0]
            if len(keys):
                new_key[0] = False
            before = np.cumsum(sizes) - sizes  # rows of the batch before the group
            base = np.zeros(len(at), np.int64)
            base[new_key] = before[new_key]
            base = np.maximum.accumulate(base)
            start = np.where(base > 0, before - base, before + place) - gone
            rank = start + (total + 1) / 2
            here = base[-1]
            place = b.num_rows - here if here > 0 else place + b.num_rows
            key = name(len(at) - 1)[0]
            return pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(np.repeat(rank, sizes))], names=[*keep, out])

        for b in batches:
            if not b.num_rows:
                continue
            if held:
                b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
                held = []
            at = int(starts([b.column(k) for k in [*keys, c]], b.num_rows)[-1])
            last = (tuple(b.column(k)[at].as_py() for k in keys), b.column(c)[at].as_py())
            number = b.column(PART)[0].as_py()
            if last in shared.value[0][number]["big"]:
                at = b.num_rows  # its count is known
            if at:
                yield ranks(b.slice(0, at))
            if at < b.num_rows:
                held = [b.slice(at)]
        if held:
            yield ranks(held[0])

    return laid.mapInArrow(run, StructType([*df.schema.fields, *df.sparkSession.createDataFrame([], f"`{out}` double").schema.fields]))


def _last_known(keys: list[str], c: str):
    def run(batches):
        part, first, key, value, single = None, None, None, None, True
        for b in batches:
            if not b.num_rows:
                continue
            by = [b.column(k) for k in keys]
            at = int(starts(by, b.num_rows)[-1])
            head, tail = (tuple(x[i].as_py() for x in by) for i in (0, at))
            if part is None:
                part, first = b.column(PART)[0].as_py(), head
            if tail != key and key is not None or at:
                single, value = False, None
            key, known = tail, b.column(c).slice(at).drop_null()
            value = known[len(known) - 1].as_py() if len(known) else value
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps((first, key, single, value))], pa.binary())], names=["part", "told"])

    return run


def carried(df: DataFrame, keys: list[str], order: list[str], c: str, out: str) -> DataFrame:
    """Adds the last value of c that is not null, up to this row, within the keys; a key with much of the table is many tasks.

    Each partition tells the last value of its last key, which the driver carries on to the next ones; whole batches are
    filled at once, whatever the number of keys.
    """
    laid = laid_out(df, keys, order)
    state, key, known = None, None, {}
    for r in sorted(laid.mapInArrow(_last_known(keys, c), "part long, told binary").collect()):  # one row a partition
        first, last, single, value = pickle.loads(r.told)
        come = state if first == key else None
        known[r.part] = come
        state, key = (come if value is None and single else value), last
    shared, keep = df.sparkSession.sparkContext.broadcast(known), df.columns

    def run(batches):
        key, value, part = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            by, n = [b.column(k) for k in keys], b.num_rows
            at = starts(by, n)
            head = tuple(x[0].as_py() for x in by)
            if part is None:
                part, key = b.column(PART)[0].as_py(), head
                value = shared.value[part]
            value = value if head == key else None
            place = np.arange(n)
            source = np.maximum.accumulate(np.where(b.column(c).is_valid().to_numpy(zero_copy_only=False), place, -1))
            run_start = np.repeat(at, np.diff(at, append=n))
            before = (source < run_start) & (run_start == 0)  # of the first key, before its first value here
            index = np.where(source >= run_start, source, np.where(before, n, -1))
            pool = pa.concat_arrays([b.column(c), pa.array([value], b.column(c).type)])
            filled = pool.take(pa.array(index, mask=index < 0))
            key, value = tuple(x[int(at[-1])].as_py() for x in by), filled[n - 1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), filled], names=[*keep, out])

    return laid.mapInArrow(run, StructType([*df.schema.fields, df.withColumnRenamed(c, out).schema[out]]))

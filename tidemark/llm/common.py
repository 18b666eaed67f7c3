"""What the corpus operators share: row keys, staged tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes A-Z become a-z, every other byte stays.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Used where spark.checkpoint.dir is unset and driver and executors are one local process.
LOCAL_SHARED = "file:///tmp/checkpoints/tidemark"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without."""
    key, conf = "spark.checkpoint.dir", spark.sparkContext.getConf()
    found = spark.conf.get(key, None) or conf.get(key)
    if found:
        return found
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return LOCAL_SHARED
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


class Stage:
    """Writes intermediate tables into the shared folder, which cuts their lineage, and reads them back.

    A lost executor then costs the tasks it ran, never a recomputation of earlier steps. Tables that no later
    step reads are deleted with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex[:12]}", 0

    def table(self, df: DataFrame, name: str = "t", by: str | None = None, group: int | None = None) -> DataFrame:
        """``by``: a column whose values get folders of their own, which are read and dropped alone.
        ``group``: rows that are written, and read again, together at most. Else a writer looks at its memory every
        hundred rows first, and a reader takes thousands, which rows of megabytes do not allow."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}_{name}"
        writer = df.write.option("compression", "zstd")
        writer = writer.option("parquet.block.row.count.limit", group) if group else writer
        (writer.partitionBy(by) if by else writer).parquet(path)
        if self.n == 1:  # what is left goes with the application
            root = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        self.release()
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._tidemark_path)

    def drop_part(self, table: DataFrame, by: str, value: int) -> None:
        """The rows with this value of the column that the table was written by."""
        self._delete(f"{table._tidemark_path}/{by}={value}")

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner delete the shuffle files of queries that are over."""
        gc.collect()
        self.spark._jvm.System.gc()


def tidied(run):
    """A function over batches that gives memory back to the system when its task ends: Python workers live on, and what
    one query leaves in them stands beside the next one's."""

    @wraps(run)
    def wrapped(batches):
        yield from run(batches)
        for cache in CACHES:
            cache()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Jobs that start within it hand so many rows at a time to Python: the executor and the worker each hold a batch,
    and the buffers that it is written to and read from."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


#: What empties a module's caches at the end of a task.
CACHES: list = []


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """The named columns plus ``row``, a number that tells the rows of one scan apart, repeated ones and null ids too.

    Another scan may give other numbers: what reads the documents more than once takes ``numbered``.
    """
    return docs.select(*columns, F.monotonically_increasing_id().alias("row"))


def numbered(docs: DataFrame, stage: Stage, *columns, scan: bool = False, name: str = "row") -> DataFrame:
    """The named columns plus a number for each row, which stays the same however often and in whatever splits it is read.

    With ``scan``, docs is a plain scan of files, and a row is known by its file's place among the sorted paths and
    its place in the file. The table of paths has one row a file, and is broadcast for as long as it is small. Any
    other DataFrame is written to the shared folder once.
    """
    if not scan:
        return stage.table(docs.select(*columns, F.monotonically_increasing_id().alias(name)), "numbered")
    path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    files = sorted(r[0] for r in docs.select(path.alias("p")).distinct().collect())  # one row a file
    if len(files) == 1:
        return docs.select(*columns, place.alias(name))
    if len(files) > MOST_FILES:
        return numbered(docs, stage, *columns, name=name)
    at, in_file, number = (fresh(docs, x) for x in ("path", "place", "file"))
    table = F.broadcast(docs.sparkSession.createDataFrame(list(enumerate(files)), f"{number} long, {at} string"))
    placed = docs.select(*columns, path.alias(at), place.alias(in_file)).join(table, at)
    return placed.select(*[F.col(f"`{c}`") for c in docs.select(*columns).columns], (F.shiftleft(number, 40) + F.col(in_file)).alias(name))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: Paths that are broadcast: at 200 bytes a path, 20 MB.
MOST_FILES = 100_000
#: Hashes that one bitmap may hold, its bits a hash, and its bits at most (32 MB).
MOST_ONES, BITS_EACH, MOST_BITS = 1 << 24, 64, 1 << 28


class Bitmap:
    """A set of 64-bit hashes by their leading bits: it says yes to each member, and to few others."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, hashes: DataFrame, column: str, most: int | None = None) -> Bitmap | None:
        """The set of a column, sized by its number of rows; None where these are more than ``most``."""
        n = hashes.count()
        if n > (MOST_ONES if most is None else most):
            return None
        bits = max(16, (min(MOST_BITS, BITS_EACH * n) - 1).bit_length())
        top = hashes.select(F.shiftrightunsigned(column, 64 - bits).alias("t"))
        words = top.select(F.shiftright("t", 6).alias("w"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        out = np.zeros(1 << (bits - 6), np.int64)
        out[words.column("w").to_numpy()] = words.column("b").to_numpy()
        return cls(out, bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        i = hashes.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.words.view(np.uint64)[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63))) & np.uint64(1) == 1


#: Row numbers that are broadcast; a hash table of so many takes about 50 MB.
MOST_ROWS = 1 << 21


def rows_of(source: DataFrame, rows: DataFrame, has: bool = True, column: str = "row") -> DataFrame:
    """The rows of source whose number is, or is not, in the staged table rows(row), which repeats none.

    While these are few, the join is made where source is scanned, and what it drops crosses no shuffle.
    """
    listed = rows.select(F.col("row").alias(column))
    return source.join(F.broadcast(listed) if rows.count() <= MOST_ROWS else listed, column, "left_semi" if has else "left_anti")


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null counts as empty."""
    return [x or b"" for x in (column if pa.types.is_binary(column.type) else column.cast(pa.binary())).to_pylist()]


def utf8_groups(column: pa.Array, size: int):
    """(from, to, texts) of runs of rows of about so many bytes; a longer text is alone. One run's texts are in memory at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield at, to, utf8(column.slice(at, to - at))
        at = to


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type, from_pandas=False) for c, f in zip(columns, schema)], schema=schema)


def partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))

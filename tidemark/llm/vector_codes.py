"""Product codes for vectors: codebooks a part, found by Lloyd's rounds with an exponion search.

A part's search starts at the entry it had in the round before. By the triangle inequality, an entry that is as near as
that one lies within twice its distance of it, so only the head of the start entry's neighbour list (the codebook by
distance from it) is scanned. All distances are squared and whole numbers, so the radius loses nothing: a neighbour at
squared distance r can win only if r <= 4 d. Ties go to the lower index.

A round writes the new codes next to the vectors, and sums a task by entry before anything is shuffled; the driver sees
one number a component of the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import Stage, tidied

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Whole components beyond this count as this, which keeps the squares of parts of up to 2,048 components in 64 bits.
BOUND = 1 << 24
#: Vectors that are compared with one list of neighbours at a time.
TOGETHER = 1024


class Codebook:
    """Entries of one part position, and for each entry all of them by distance from it."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        norm = (self.entries**2).sum(axis=1)
        apart = norm[:, None] - 2 * self.entries @ self.entries.T + norm[None, :]
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.radius = np.take_along_axis(apart, self.order, axis=1)
        self.norm = norm

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's nearest entry, its squared distance, and how many distances were computed."""
        index, error, scanned = start.astype(np.int64), ((x - self.entries[start]) ** 2).sum(axis=1), len(x)
        most = max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0))
        kind = np.float64 if 4 * x.shape[1] * int(most) ** 2 < 1 << 53 else np.int64  # both exact, the first faster
        points, entries, norm = x.astype(kind), self.entries.astype(kind), (x**2).sum(axis=1)
        by = np.argsort(start, kind="stable")
        for rows in np.split(by, np.flatnonzero(np.diff(start[by])) + 1) if len(by) else ():
            a = start[rows[0]]
            reach = np.searchsorted(self.radius[a], 4 * error[rows], side="right")
            wide = np.argsort(reach, kind="stable")
            for i in range(0, len(rows), TOGETHER):
                some = rows[wide[i : i + TOGETHER]]
                near = np.sort(self.order[a, : reach[wide[min(i + TOGETHER, len(rows)) - 1]]])  # by index: the first least one wins
                d = norm[some, None] - 2 * (points[some] @ entries[near].T).astype(np.int64) + self.norm[near]
                at = d.argmin(axis=1)
                index[some], error[some] = near[at], d[np.arange(len(some)), at]
                scanned += d.size
        return index, error, scanned


def cuts(dimension: int, parts: int = PARTS) -> list[int]:
    return [dimension * i // parts for i in range(parts + 1)]


def matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have so many components, and these rows as a matrix."""
    length = np.diff(column.offsets.to_numpy())
    fits = length == dimension
    if not fits.all():
        column = column.filter(pa.array(fits))
    return fits, column.flatten().to_numpy().astype(np.int64).reshape(int(fits.sum()), dimension)


def _coder(books, edges: list[int]):
    """Adds code (an index a part, as bytes) and error to batches whose last two columns are v and the code before."""

    @tidied
    def run(batches):
        search = [Codebook(b) for b in books.value]
        for b in batches:
            names = b.schema.names
            fits, x = matrix(b.column(names.index("v")), edges[-1])
            code, error = np.zeros((len(x), len(search)), np.uint8), np.zeros(len(x), np.int64)
            before = b.column(names.index("code"))
            started = before.null_count < b.num_rows
            if started:
                old = np.frombuffer(b"".join(before.drop_null().to_pylist()), np.uint8).reshape(len(x), len(search))
            for p, book in enumerate(search):
                index, d, _ = book.nearest(x[:, edges[p] : edges[p + 1]], old[:, p].astype(np.int64) if started else np.zeros(len(x), np.int64))
                code[:, p] = index
                error += d
            spread = np.full(len(fits), -1)
            spread[fits] = np.arange(len(x))  # rows that do not fit stay without a code
            at = pa.array(spread, mask=~fits)
            codes = pa.array([c.tobytes() for c in code], pa.binary()).take(at)
            errors = pa.array(error).take(at)
            columns = [b.column(i) for i, n in enumerate(names) if n not in ("code", "error")]
            yield pa.RecordBatch.from_arrays([*columns, codes, errors], names=[n for n in names if n not in ("code", "error")] + ["code", "error"])

    return run


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _sums(edges: list[int], entries: int):
    """One row a part and entry that a task has seen: the number of its vectors and their sums."""

    @tidied
    def run(batches):
        widths = np.diff(edges)
        n = np.zeros((len(widths), entries), np.int64)
        sums = [np.zeros((entries, w), np.int64) for w in widths]
        for b in batches:
            _, x = matrix(b.column(0), edges[-1])
            if not len(x):
                continue
            code = np.frombuffer(b"".join(b.column(1).drop_null().to_pylist()), np.uint8).reshape(len(x), len(widths))
            for p in range(len(widths)):
                by = np.argsort(code[:, p], kind="stable")
                c = code[by, p]
                first = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
                sums[p][c[first]] += np.add.reduceat(x[by, edges[p] : edges[p + 1]], first, axis=0)
                n[p] += np.bincount(c, minlength=entries)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array([sums[p][e].tolist() for p, e in zip(part, entry)], pa.list_(pa.int64()))], schema=SUMS)

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def whole(vector: str):
    """floor(1024 x) of each component, within the bound."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("int"))


def vector_codes(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
    """(codes, codebooks): one row per kept vector: vec_id, label, code (an index a part, as bytes), error; and the final entries.

    Rows whose vector is null or has a null or non-finite component are dropped. The number of components is that of the
    smallest vec_id; kept vectors of another length have a null code and error and take no part. A number of components
    that the parts do not divide is cut at its rounded shares. Codebooks start from the smallest vec_ids (null last,
    equal ids by their components, repeated rows each for itself), fewer than 256 where there are no more rows. Whole
    components beyond 2**24 count as that bound. Equal entries are allowed: the lower index is used, and the other stays.
    Null ids and labels are kept; an empty table gives an empty result; columns other than the three named are not read.
    """
    if entries > 256:
        raise ValueError("an index must fit a byte")
    spark, stage = vectors.sparkSession, Stage(vectors.sparkSession, "codes")
    raw = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("raw"))
    real = F.forall("raw", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = raw.where(F.col("raw").isNotNull() & real).select("vec_id", "label", whole("raw").alias("v"))
    table = stage.table(kept.withColumn("code", F.lit(None).cast("binary")), "vectors")
    first = [r.v for r in table.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()]  # one row an entry
    if not first:
        return table.withColumn("error", F.lit(None).cast("long")).drop("v"), []
    edges = cuts(len(first[0]), parts)
    start = np.array([v for v in first if len(v) == edges[-1]], np.int64)
    books = [start[:, a:b].copy() for a, b in zip(edges, edges[1:])]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", `error` long"
    for k in range(rounds + 1):
        coded = table.drop("error").mapInArrow(_coder(spark.sparkContext.broadcast(books), edges), kinds)
        coded, before = stage.table(coded, f"round{k}"), table
        stage.drop(before)
        table = coded
        if k == rounds:
            break
        sums = coded.select("v", "code").mapInArrow(_sums(edges, entries), "part int, entry int, n long, sums array<long>")
        sums = sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        for r in sums.collect():  # as many as the codebooks have components
            books[r.part][r.entry, r.place] = r.x // r.n
    return table.drop("v"), books


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    stage = Stage(spark, "labels")
    by_label = stage.table(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "sums")  # written: its size is known
    found = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    n = f"(SELECT max(len(v)) // {PARTS} FROM kept)"
    near = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    steps = [
        f"kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * {n} + 1 : (p + 1) * {n}] AS x FROM kept, range({PARTS}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"d{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min(CAST({near} AS BIGINT) * {ENTRIES} + e) AS best FROM parts JOIN b{k} USING (p) GROUP BY vec_id, label, p, x)")
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, p, x, best // {ENTRIES} AS error, best % {ENTRIES} AS e FROM d{k})")
        if k < ROUNDS:
            steps.append(f"s{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i]) / count(*)) AS m FROM a{k}, (SELECT unnest(range(1, {n} + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN s{k} s USING (p, e))")
    steps.append("codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(error) AS BIGINT) AS error FROM " + f"a{ROUNDS} GROUP BY vec_id, label)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(CAST(m AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS m, unnest(range(len(c))) AS i FROM b{ROUNDS}))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, h"


ORACLE = {"op12_vector_codes": _sql()}

"""Bounded training samples: the only rows of the corpus that a classifier learns from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def words_of(text: str = "text"):
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+"))


def first_by_hash(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most so many rows, those whose keys hash lowest: any part of the table has the same chance, each run the same rows.

    Rows are counted first, so that only about as many as are wanted leave the tasks that read them.
    """
    n = df.select(*keys).count()
    h = F.shiftrightunsigned(F.xxhash64(*keys), 24)
    if n > rows:
        df = df.where(h < int(min(1.0, 1.2 * rows / n + 50 / n) * (1 << 40)))
    return df.orderBy(h, *keys).limit(rows)

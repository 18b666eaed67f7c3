"""Queries with the SQL that must give the same rows.

A query names its result's columns and kinds: s string, l whole number, d number (rounded to four places on both
sides), t time, b boolean. Both sides are cast alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, functions as F

from tidemark.plans.views import SQL

#: Added before rounding, so that the last bit of a sum does not decide a tie.
OFF_TIES = 3.14159e-6

QUERIES: dict[str, "Query"] = {}


@dataclass
class Query:
    run: Callable
    sql: str | None


def _spark(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    kinds = {"s": "string", "l": "bigint", "t": "timestamp_ntz", "b": "boolean"}
    return df.select(*[(F.round(F.col(c).cast("double") + F.lit(OFF_TIES), 4) + F.lit(0.0)).alias(c) if k == "d" else F.col(c).cast(kinds[k]).alias(c) for c, k in columns])


def _duck(sql: str, columns: list[tuple[str, str]], views: tuple[str, ...]) -> str:
    kinds = {"s": "VARCHAR", "l": "BIGINT", "t": "TIMESTAMP", "b": "BOOLEAN"}
    out = ", ".join(f"round(CAST({c} AS DOUBLE) + {OFF_TIES!r}::DOUBLE, 4) + 0.0::DOUBLE AS {c}" if k == "d" else f"CAST({c} AS {kinds[k]}) AS {c}" for c, k in columns)
    heads = [SQL[v] for v in views]
    start = "WITH RECURSIVE " if sql.startswith("WITH RECURSIVE ") else "WITH "
    if sql.startswith(start):
        body, sql = sql[len(start) :].rsplit("\nFINALLY ", 1)
        heads.append(body)
    return f"{start}{', '.join(heads)} SELECT {out} FROM ({sql}) AS final" if heads else f"SELECT {out} FROM ({sql}) AS final"


def query(name: str, columns: str, run: Callable, sql: str | None = None, views: tuple[str, ...] = ()) -> None:
    """Registers run(spark, sf_dir). SQL of the form "WITH a AS (...)\\nFINALLY SELECT ..." has further tables, which may be recursive."""
    if name in QUERIES:
        raise KeyError(name)
    spec = [tuple(c.split(":")) for c in columns.split()]
    QUERIES[name] = Query(lambda spark, sf_dir: _spark(run(spark, sf_dir), spec), sql and _duck(sql, spec, views))

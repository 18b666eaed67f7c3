"""All registered queries and the SQL that gives the same rows."""

from tidemark.plans import aggregates, factors, io, joins, leadlag, models, pairs, portfolio, reshape, scoring, windows  # noqa: F401
from tidemark.plans.registry import QUERIES


def queries():
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql():
    return {name: q.sql for name, q in QUERIES.items() if q.sql}

"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoutflow.plans import audits, candidates, catalogues, documents, events, modelruns, pagefacts, pages, records, relational, scalars, sources

MODULES = [pages, documents, relational, events, scalars, candidates, audits, modelruns, records, pagefacts, catalogues, sources]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}

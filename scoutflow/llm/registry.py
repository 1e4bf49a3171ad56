"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoutflow.llm import collocations, countjoin, decontaminate, filteraudit, fuzzyhash, htmldiff, langid, licenses, mixing, neardup, sharding, toxicity, warc

MODULES = [warc, fuzzyhash, htmldiff, neardup, licenses, toxicity, langid, decontaminate, sharding, mixing, collocations, filteraudit, countjoin]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}

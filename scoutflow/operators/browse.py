"""Faceted browsing: a conjunctive filter, counts and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.operators.topk import page_of


def matches(search: str = "", topic: str = "", fresh: bool | None = None, **equal: str) -> Column:
    """Substring search over ``search_text`` ignoring case, membership in ``topics`` (split at ``|``), ``is_new``, and equality on any further facet. Empty means any."""
    keep = F.lit(True)
    if search:
        keep = keep & F.contains(F.lower("search_text"), F.lit(search.lower()))
    if topic:
        keep = keep & F.array_contains(F.split("topics", "[|]"), topic)
    if fresh is not None:
        keep = keep & (F.col("is_new") == fresh)
    for facet, value in equal.items():
        if value:
            keep = keep & (F.col(facet) == value)
    return keep


def browse(df: DataFrame, order: list[Column], page: int = 1, size: int = 15, **facets) -> DataFrame:
    return page_of(df.filter(matches(**facets)), order, page, size)


def topic_facet(df: DataFrame) -> DataFrame:
    """Distinct topics with their counts, once for all spellings by case (the least one is shown)."""
    rows = df.select(F.explode(F.split("topics", "[|]")).alias("topic")).filter("topic <> ''")
    return rows.groupBy(F.lower("topic").alias("folded")).agg(F.min("topic").alias("topic"), F.count(F.lit(1)).alias("n")).select("topic", "n")

"""Conditional fetches against a table of stored responses, and where a landing page sends its reader.

A cache row is ``url, final_url, etag, last_modified, text, validated_at``; one row a URL. A response row is
``url, status, final_url, etag, last_modified, text, raised``; ``status`` is null where the request raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutflow.operators.state import cache_outcome

CACHE = ["url", "final_url", "etag", "last_modified", "text", "validated_at"]
# Response headers worth keeping, in order.
KEPT_HEADERS = ["etag", "last-modified", "content-type", "cache-control"]


def kept_headers(headers: Column) -> Column:
    """The headers of a map that a stored response keeps; names compare without case."""
    return F.map_filter(headers, lambda k, v: F.lower(k).isin(*KEPT_HEADERS))


def conditional(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (``url``) with ``if_none_match`` and ``if_modified_since`` where a stored response has a validator; null otherwise."""
    sent = cache.select("url", F.nullif(F.trim("etag"), F.lit("")).alias("if_none_match"), F.nullif(F.trim("last_modified"), F.lit("")).alias("if_modified_since"))
    return requests.join(sent, "url", "left")


def settled(responses: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``url, outcome, final_url, text, age_seconds``: what each request gives in the end.

    A 304 takes the stored text; an outage (raised, 429, 5xx) takes it while it is recent enough, and ``age_seconds``
    says how old it is; anything else is an ``error`` without a text. A null text is not stored, so it can't be taken.
    """
    stored = cache.select("url", *[F.col(c).alias(f"__{c}") for c in CACHE[1:]])
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp("__validated_at"), F.lit(0))
    has = F.coalesce(F.col("__text").isNotNull(), F.lit(False))
    both = responses.join(stored, "url", "left").withColumn("outcome", cache_outcome(F.coalesce("status", F.lit(0)), F.col("raised"), has, age / 86400))
    old = F.col("outcome").isin("revalidated", "stale")
    return both.select(
        "url", "outcome", F.when(old, F.coalesce(F.nullif("__final_url", F.lit("")), "url")).when(F.col("outcome") == "fresh", F.col("final_url")).alias("final_url"),
        F.when(old, F.col("__text")).when(F.col("outcome") == "fresh", F.col("text")).alias("text"), F.when(F.col("outcome") == "stale", age).alias("age_seconds"),
    )


def next_cache(responses: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """The cache after the responses: a 200 replaces the row, a 304 with a stored text renews its clock, and an outage changes nothing, so it cannot keep old text alive."""
    fresh = (F.col("r.status") == 200) & ~F.col("r.raised")
    renewed = (F.col("r.status") == 304) & ~F.col("r.raised") & F.col("c.text").isNotNull()
    both = cache.alias("c").join(responses.alias("r"), F.col("c.url") == F.col("r.url"), "full_outer").withColumn("__fresh", F.coalesce(fresh, F.lit(False)))
    value = lambda name: F.when(F.col("__fresh"), F.col(f"r.{name}")).otherwise(F.col(f"c.{name}")).alias(name)
    clock = F.when(F.col("__fresh") | F.coalesce(renewed, F.lit(False)), now).otherwise(F.col("c.validated_at"))
    return both.filter(F.col("__fresh") | F.col("c.url").isNotNull()).select(F.coalesce("c.url", "r.url").alias("url"), *[value(c) for c in CACHE[1:-1]], clock.alias("validated_at"))


@F.pandas_udf(T.StringType())
def _joined(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(base: str | None, target: str | None) -> str | None:
        try:
            return urljoin(base or "", target) if target else None
        except ValueError:
            return None

    for base, target in batches:
        yield pd.Series([one(b, t) for b, t in zip(base, target)], dtype=object)


def meta_refresh(html: Column, url: Column) -> Column:
    """Where the page's first refresh tag leads, relative to its URL; null without one."""
    tag = F.regexp_extract(html, r"""(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["']?[^"'>]*refresh[^>]*>)""", 1)
    content = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    target = F.regexp_replace(F.regexp_extract(content, r"(?i)url=([^;\s]+)", 1), r"""^["']+|["']+$""", "")
    return _joined(url, F.nullif(target, F.lit("")))

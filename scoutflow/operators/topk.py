"""Top-k, caps, budgets and interleaving. All ties are settled by columns that the caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark drops later ones before it shuffles (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def capped_top(df: DataFrame, source: str, order: list[Column], cap: int, n: int) -> DataFrame:
    """The best ``n`` rows with at most ``cap`` from one source (0 or less: no cap, no limit).

    The same as a greedy scan in order: a row that its source's cap passes over takes nothing from the total.
    """
    kept = top_per_group(df, [source], order, cap, "__r").drop("__r") if cap > 0 else df
    return kept.orderBy(*order).limit(n) if n > 0 else kept.orderBy(*order)


def char_budget(df: DataFrame, group: list[str], order: list[Column], text: str, per_row: int, total: int) -> DataFrame:
    """Cut each row's text to ``per_row`` characters and to what earlier rows of its group left of ``total``; rows left with nothing go."""
    size = F.least(F.length(text), F.lit(per_row))
    before = F.coalesce(F.sum(size).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.least(F.lit(per_row), F.lit(total) - before)
    return df.withColumn("room", room).filter("room > 0").withColumn(text, F.substr(F.col(text), F.lit(1), F.col("room").cast("int"))).drop("room")


def round_robin(df: DataFrame, group: str, order: list[Column], position: str = "turn") -> DataFrame:
    """Adds each row's turn within its group: by ``turn`` and then by the groups' first rows, groups take turns."""
    return df.withColumn(position, F.row_number().over(W.partitionBy(group).orderBy(*order)))


def soonest_upcoming(df: DataFrame, key: list[str], day: str, as_of: Column, tie: str) -> DataFrame:
    """Each key's first row on or after ``as_of``, by aggregation."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.filter(F.col(day) >= as_of).groupBy(*key).agg(F.min_by(whole, F.struct(day, tie)).alias("__r")).select("__r.*")


def best_per_key(df: DataFrame, key: list[str], quality: list[Column], first: str) -> DataFrame:
    """Each key's row of greatest quality; of equals, that with the least ``first``."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    worth = F.struct(*[q.alias(f"q{i}") for i, q in enumerate(quality)], (-F.col(first)).alias("last"))
    return df.groupBy(*key).agg(F.max_by(whole, worth).alias("__r")).select("__r.*")


def keep_if_better(initial: DataFrame, revised: DataFrame, key: str, quality: str) -> DataFrame:
    """``initial`` with the revised row wherever that is at least as good; revised keys without an initial row are left out."""
    columns = [c for c in initial.columns if c != key]
    new = revised.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    take = F.coalesce(F.col("__new") & (F.col(f"__{quality}") >= F.col(quality)), F.lit(False))
    return initial.join(new, key, "left").select(key, *[F.when(take, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns], take.alias("replaced"))


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 15) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)

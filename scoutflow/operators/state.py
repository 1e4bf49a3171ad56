"""State that evolves from run to run, as snapshot merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STALE_DAYS, PRUNE_DAYS = 14, 45


def upsert_seen(previous: DataFrame, current: DataFrame, today: Column) -> DataFrame:
    """Seen state after a run. Both have ``state_key, title, status``; ``previous`` also ``first_seen, last_seen``, ``current`` also ``url``.

    A key seen before keeps ``first_seen``, under its url if it had no key of its own then; a first date that
    is missing becomes today. Keys that are gone stay. New keys start today.
    """
    cur = current.select(F.col("state_key"), "url", F.col("title").alias("t"), F.col("status").alias("s"), F.lit(True).alias("now"))
    prev = previous.select("state_key", "first_seen", "last_seen", "title", "status")
    direct = cur.join(prev.select("state_key", F.col("first_seen").alias("f1")), "state_key", "left")
    moved = direct.join(prev.select(F.col("state_key").alias("url"), F.col("first_seen").alias("f2")), "url", "left")
    new = moved.select("state_key", F.coalesce("f1", "f2", today).alias("first_seen"), today.alias("last_seen"), F.col("t").alias("title"), F.col("s").alias("status"))
    migrated = moved.filter("f1 is null and f2 is not null and url <> state_key").select(F.col("url").alias("state_key"))
    old = prev.join(current.select("state_key"), "state_key", "left_anti").join(migrated, "state_key", "left_anti")
    return old.select("state_key", F.coalesce("first_seen", today).alias("first_seen"), "last_seen", "title", "status").unionByName(new)


def next_streaks(previous: DataFrame, attempts: DataFrame, today: Column) -> DataFrame:
    """Source health after a run: ``attempts`` has ``name, ok``; a success resets ``consecutive_failures``, a failure adds one."""
    before = previous.select("name", F.col("consecutive_failures").alias("c"), F.col("last_success").alias("ls"))
    rows = attempts.join(before, "name", "left")
    return rows.select(
        "name",
        F.when(F.col("ok"), "ok").otherwise("failed").alias("status"),
        today.alias("last_attempt"),
        F.when(F.col("ok"), today).otherwise(F.col("ls")).alias("last_success"),
        F.when(F.col("ok"), 0).otherwise(F.coalesce("c", F.lit(0)) + 1).alias("consecutive_failures"),
    )


def failure_islands(log: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """The length of each unbroken run of failures in a log: ``key, streak`` (0-based by successes before it), ``n``."""
    by = W.partitionBy(key).orderBy(*order)
    marked = log.withColumn("failed", failed).withColumn("streak", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(by))
    return marked.filter("failed").groupBy(key, "streak").agg(F.count(F.lit(1)).alias("n"))


def cache_outcome(status: Column, raised: Column, has_body: Column, age_days: Column) -> Column:
    """What a conditional fetch gives: ``fresh`` (200), ``revalidated`` (304 with a cached body), ``stale`` (failure, 429 or 5xx with a body of at most 14 days), else ``error``."""
    outage = raised | (status == 429) | (status >= 500)
    usable = has_body & (age_days <= STALE_DAYS)
    return F.when(~raised & (status == 200), "fresh").when(~raised & (status == 304) & has_body, "revalidated").when(outage & usable, "stale").otherwise("error")


def pruned(cache: DataFrame, now: Column) -> DataFrame:
    """Entries validated within 45 days."""
    return cache.filter(F.datediff(now, "validated_at") <= PRUNE_DAYS)

"""Comparing runs, rolling up audits, and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = ["", "unknown", "none", "null", "n/a"]
COVERAGE, RETENTION, RETENTION_LEAST_ROWS = 0.70, 0.35, 10


def known(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin(UNKNOWN)


def field_agreement(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a field: of the keys in both runs, how many ``agree``, ``differ``, are known only on the ``left_only`` or ``right_only``, or are ``both_missing``."""
    pairs = left.select(key, *[F.col(f).cast("string").alias(f"l_{f}") for f in fields]).join(right.select(key, *[F.col(f).cast("string").alias(f"r_{f}") for f in fields]), key)
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l_{f}").alias("l"), F.col(f"r_{f}").alias("r")) for f in fields])).alias("x")).select("x.*")
    lk, rk = known(F.col("l")), known(F.col("r"))
    outcome = F.when(lk & rk & (F.lower(F.trim("l")) == F.lower(F.trim("r"))), "agree").when(lk & rk, "differ").when(lk, "left_only").when(rk, "right_only").otherwise("both_missing")
    return rows.withColumn("outcome", outcome).groupBy("field").pivot("outcome", ["agree", "differ", "left_only", "right_only", "both_missing"]).agg(F.count(F.lit(1))).na.fill(0)


def run_diff(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each key with ``side``: ``both``, ``left`` or ``right``. Repeated keys count once."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right").alias("side"))


def yes_rate(df: DataFrame, group: list[str], answer: str) -> DataFrame:
    """Counts of yes and no and the share of yes among them (0 without any)."""
    a = F.lower(F.trim(F.col(answer).cast("string")))
    yes, no = F.count_if(a.isin("yes", "true", "1")), F.count_if(a.isin("no", "false", "0"))
    return df.groupBy(*group).agg(yes.alias("yes"), no.alias("no"), F.coalesce(F.try_divide(yes.cast("double"), yes + no), F.lit(0.0)).alias("rate"))


def coverage(attempted: Column, succeeded: Column) -> Column:
    """Share of sources that worked, in [0, 1] to four places; nothing attempted counts as 1."""
    return F.when(attempted == 0, 1.0).otherwise(F.round(F.least(F.greatest(succeeded / attempted, F.lit(0.0)), F.lit(1.0)), 4))


def coverage_gate(attempted: Column, succeeded: Column, least: float = COVERAGE) -> Column:
    return F.when(attempted == 0, "error: nothing attempted").when(coverage(attempted, succeeded) < least, "error: low coverage").otherwise("ok")


def retention_gate(before: Column, now: Column, least: float = RETENTION, rows: int = RETENTION_LEAST_ROWS) -> Column:
    """Ok where enough of a baseline of at least ``rows`` rows is left; exactly ``least`` passes."""
    return F.when(now == 0, "error: empty").when((before >= rows) & (now < before * least), "error: low retention").otherwise("ok")


def run_summary(items: DataFrame) -> DataFrame:
    """One row for items with ``warnings`` (array), ``valid``, ``evidence_count``: totals and averages, 0.0 where nothing divides."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    n, warned = F.count(F.lit(1)), F.sum(F.size("warnings"))
    return items.agg(n.alias("n_items"), F.count_if("valid").alias("n_valid"), ratio(warned, n).alias("avg_warnings"), ratio(F.sum("evidence_count"), n).alias("avg_evidence"), F.count_if(F.col("evidence_count") == 0).alias("n_without_evidence"))

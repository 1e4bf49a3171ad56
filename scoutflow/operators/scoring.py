"""Additive scores with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each fact is worth.
TOPIC, TOPIC_MOST = 6, 30
FUNDED, GRANT, WAIVER, KNOWN_FEE = 20, 5, 5, 12
OPEN, UNCERTAIN = 15, 4
PRIORITY_REGION, OTHER_REGION = 12, 5
TRUSTED_LAYER, SECOND_LAYER = 10, 5
ON_SITE, LEVEL, FAILURE = 10, 8, -8
REVIEW_FUNDING, REVIEW_FEE, REVIEW_DEADLINE, REVIEW_DURATION = 4, 2, 2, 1


def candidate_score() -> Column:
    """Never below zero. A short programme counts half its days, a longer one its days up to twenty."""
    c = F.col
    funded = F.coalesce(c("funding_available"), F.lit(False))
    kinds = F.coalesce(c("funding_type"), F.array().cast("array<string>"))
    topics = F.least(F.greatest(F.coalesce(F.size("topic_keywords"), F.lit(0)), F.lit(0)) * TOPIC, F.lit(TOPIC_MOST))
    grants = FUNDED + F.when(F.array_contains(kinds, "travel grant"), GRANT).otherwise(0) + F.when(F.array_contains(kinds, "tuition waiver"), WAIVER).otherwise(0)
    money = F.when(funded, grants).when(c("fee_eur").isNotNull(), KNOWN_FEE).otherwise(0)
    deadline = F.when(c("deadline_status") == "open", OPEN).when(c("deadline_status") == "uncertain", UNCERTAIN).otherwise(0)
    days = F.coalesce(c("duration_days"), F.lit(0))
    length = F.when(days >= 5, F.least(days, F.lit(20)).cast("double")).otherwise(days / 2)
    region = F.when(c("region_priority") == "priority", PRIORITY_REGION).when(c("region_priority").isin("supplementary", "global"), OTHER_REGION).otherwise(0)
    layer = F.when(c("source_layer").isin("1", "1.5"), TRUSTED_LAYER).when(c("source_layer") == "2", SECOND_LAYER).otherwise(0)
    site = F.when(c("mode").isin("in-person", "hybrid"), ON_SITE).otherwise(0)
    level = F.when(c("target_level") != "uncertain", LEVEL).otherwise(0)
    failures = FAILURE * F.greatest(F.coalesce(F.size("failed_hard_conditions"), F.lit(0)), F.lit(0))
    return F.greatest((topics + money + deadline + length + region + layer + site + level + failures).cast("double"), F.lit(0.0))


def score_reasons() -> Column:
    """The reasons for the score, in the order of its parts."""
    c = F.col
    funded = F.coalesce(c("funding_available"), F.lit(False))
    some = lambda name: F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)) > 0
    return F.array_compact(
        F.array(
            F.when(some("topic_keywords"), F.concat(F.lit("topic match: "), F.array_join(F.slice("topic_keywords", 1, 4), ", "))),
            F.when(funded, F.concat(F.lit("funding evidence: "), F.array_join(F.coalesce("funding_type", F.array().cast("array<string>")), ", "))).when(c("fee_eur").isNotNull(), F.concat(F.lit("low fee: approximately EUR "), F.format_string("%.0f", c("fee_eur")))),
            F.when(c("deadline_status") == "open", "deadline appears open"),
            F.when(c("duration_days") >= 5, F.concat(c("duration_days").cast("string"), F.lit(" days"))),
            F.when(c("region_priority") == "priority", "priority region"),
            F.when(c("source_layer").isin("1", "1.5"), F.concat(F.lit("trusted source layer "), c("source_layer"))),
            F.when(c("mode").isin("in-person", "hybrid"), c("mode")),
            F.when(c("target_level") != "uncertain", F.concat(F.lit("target level: "), c("target_level"))),
            F.when(some("failed_hard_conditions"), F.concat(F.lit("near-match only: "), F.array_join("failed_hard_conditions", "; "))),
        )
    )


def scored(candidates: DataFrame) -> DataFrame:
    """Adds ``score``, ``score_explanation`` and ``recommendation_reason`` (its first four parts)."""
    out = candidates.withColumn("score", candidate_score()).withColumn("score_explanation", score_reasons())
    return out.withColumn("recommendation_reason", F.array_join(F.slice("score_explanation", 1, 4), "; "))


def review_priority() -> Column:
    """What a look by hand may settle is worth more: funding most, then fee and deadline, then duration."""
    has = lambda part: F.exists("failed_hard_conditions", lambda r: F.contains(r, F.lit(part)))
    return (
        F.when(has("funding is not explicit"), REVIEW_FUNDING).otherwise(0)
        + F.when(has("fee"), REVIEW_FEE).otherwise(0)
        + F.when(has("deadline is uncertain"), REVIEW_DEADLINE).otherwise(0)
        + F.when(has("duration is uncertain"), REVIEW_DURATION).otherwise(0)
    )

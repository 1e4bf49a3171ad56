"""Evidence snippets, tolerant JSON, and validation of model output against its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoutflow.functions import money
from scoutflow.functions import text as tx

MOST, LONGEST = 20, 450
# Which signals matter first.
PRIMARY = ["deadline", "fee", "funding", "eligibility"]
SECONDARY = ["dates", "mode"]
FILLER = r"(?i)\b(cookie|privacy policy|skip to main content|follow us|newsletter|subscribe|terms of use|social media|all rights reserved|javascript|enable cookies)\b"


def snippets(chunks: DataFrame, most: int = MOST, longest: int = LONGEST) -> DataFrame:
    """Tagged sentences of chunks (``page_url, chunk_index, chunk``): each page's best, labelled E1, E2, ... in that order.

    A sentence needs four words and a signal and is no filler; repeated ones, case aside, count once.
    """
    rows = chunks.select("page_url", "chunk_index", F.posexplode(tx.sentences(F.col("chunk"))).alias("pos", "raw")).withColumn("text", tx.shorten(F.col("raw"), longest))
    rows = rows.filter((F.size(F.split("text", " ")) >= 4) & ~F.col("text").rlike(FILLER)).withColumn("signals", tx.signals(F.col("text"))).filter("size(signals) > 0")
    first = rows.groupBy("page_url", F.lower("text").alias("low")).agg(F.min_by(F.struct("chunk_index", "pos", "text", "signals"), F.struct("chunk_index", "pos")).alias("s")).select("page_url", "s.*")
    count = lambda names: F.size(F.array_intersect("signals", F.array(*map(F.lit, names))))
    order = [F.desc("primary"), F.desc("secondary"), F.desc(F.size("signals")), F.asc("chunk_index"), F.asc("pos")]
    ranked = first.withColumn("primary", count(PRIMARY)).withColumn("secondary", count(SECONDARY)).withColumn("n", F.row_number().over(W.partitionBy("page_url").orderBy(*order)))
    return ranked.filter(F.col("n") <= most).select("page_url", F.concat(F.lit("E"), F.col("n").cast("string")).alias("id"), "chunk_index", "text", "signals")


def model_json(reply: Column) -> Column:
    """The JSON object in a model's reply as a variant: as it is, without a fence or thinking, or from the first to the last brace. Else null."""
    bare = F.trim(F.regexp_replace(reply, "(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(bare, "(?s)```(?:json)?\\s*(\\{.*\\})\\s*```", 1)
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    tries = [F.when(F.ltrim(t).startswith("{"), F.try_parse_json(t)) for t in (bare, fenced, braces)]
    return F.coalesce(*tries)


def field(value: Column, path: str, default: str = "unknown") -> Column:
    """One field of a parsed reply as text, at most 500 characters."""
    return F.substring(F.coalesce(F.try_variant_get(value, f"$.{path}", "string"), F.lit(default)), 1, 500)


def evidence_ids(ids: Column) -> Column:
    """Only ids that name a snippet."""
    return F.filter(F.transform(ids, lambda x: F.upper(F.trim(x))), lambda x: x.startswith("E"))


def money_supported(claim: Column, evidence: Column) -> Column:
    """Whether every amount of a claim stands in its evidence."""
    return F.size(F.array_except(F.array_distinct(money.amounts(claim)), F.array_distinct(money.amounts(evidence)))) == 0

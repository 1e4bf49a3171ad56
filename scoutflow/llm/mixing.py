"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the target size over its own size. Each document's count is the inverse of
the Poisson distribution with that rate at a seeded hash of its id (large rates are sums of parts), so counts do not depend on partitioning,
and a retried task repeats them. Documents are exploded by their counts and sorted by a second hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import load, unit_hash, written

SEED = "mix-1"
TEMPERATURE = 0.5
# Fixed value: the largest rate that is inverted at once; exp(-rate) stays far from underflow.
PART_RATE = 64.0
# Bytes of text in a partition of the output.
PART_BYTES = 128 << 20


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... far into the tail, as an array of doubles."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, scale: float = 1.0) -> DataFrame:
    """One row a source: ``source, n_docs, n_bytes, weight, rate, parts, cdf``.

    ``weights`` are the target shares (sources not named get none); without them a source's weight is its
    size to the power ``temperature``. ``scale`` times the input's bytes is the target size.
    A rate above ``PART_RATE`` is the sum of ``parts`` equal rates; ``cdf`` is that of one part.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    stats = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("n_bytes"))
    if weights is None:
        stats = stats.withColumn("weight", F.pow(F.col("n_bytes").cast("double"), F.lit(float(temperature))))
    else:
        named = F.lit(0.0)
        for name, w in weights.items():
            named = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(named)
        stats = stats.withColumn("weight", named)
    total = stats.agg(F.sum("n_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") * F.lit(float(scale)) / F.col("n_bytes")).otherwise(F.lit(0.0))
    rated = stats.join(F.broadcast(total), F.lit(True)).withColumn("rate", rate)
    split = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int"))
    return split.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts"))).select("source", "n_docs", "n_bytes", "weight", "rate", "parts", "cdf")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = TEMPERATURE, scale: float = 1.0, seed: str = SEED) -> DataFrame:
    """``docs`` replicated to the target weights, in the order of a global shuffle.

    Adds ``rate``, ``n_copies``, ``copy`` (0-based) and ``shuffle_key`` in [0, 1); rows are sorted by
    ``shuffle_key``, over partitions and within them: the key is uniform, so equal parts of [0, 1) are equal parts of the rows,
    and no sample of the plan's output is needed to find their bounds. A null source is a source of its own; rows of equal ``doc_id`` and text get equal counts; null ids are drawn by their text; empty tables stay empty.
    The table of rates goes through the shared folder, so the planner knows its size when it chooses how to join.
    """
    docs = docs.drop("rate", "n_copies", "copy", "shuffle_key")
    # One row a source; the planner broadcasts the written table if it is under its threshold and else joins by shuffle.
    rates = written(source_rates(docs, weights, temperature, scale).select(F.col("source").alias("__source"), "rate", F.col("parts").alias("__parts"), "cdf", (F.col("n_bytes") * F.col("rate")).alias("__bytes")), "mix-rates")
    size = rates.agg(F.sum("__bytes")).first()[0] or 0.0
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // PART_BYTES) + 1)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    joined = docs.join(rates, F.col("source").eqNullSafe(F.col("__source")))
    u = unit_hash(seed, key)
    first = F.size(F.filter("cdf", lambda c: c <= F.col("__u")))
    # Each further part is drawn by a hash of its own.
    more = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), first, lambda n, i: n + F.size(F.filter("cdf", lambda c: c <= unit_hash(seed, key, i))))
    counted = joined.withColumn("__u", u).withColumn("n_copies", F.when(F.col("__parts") > 1, more).otherwise(first))
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", unit_hash(seed + "-order", key, F.col("copy")))
    dealt = keyed.drop("__source", "__parts", "__bytes", "cdf", "__u").repartitionById(n_parts, F.floor(F.col("shuffle_key") * n_parts).cast("int"))
    return dealt.sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of every document, with its text, in shuffled order."""
    mixed = mix(load(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies", F.round("rate", 9).alias("rate"), "shuffle_key")


MIX_CTES = """
mix_stats AS (
  SELECT source, sum(coalesce(strlen(text), 0) + 1)::DOUBLE AS n_bytes FROM {docs} GROUP BY source),
mix_weights AS (SELECT source, n_bytes, pow(n_bytes, 0.5) AS weight FROM mix_stats),
mix_rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM mix_weights) * (SELECT sum(n_bytes) FROM mix_weights) / n_bytes AS rate FROM mix_weights),
mix_parts AS (SELECT source, rate, greatest(ceil(rate / 64), 1)::BIGINT AS parts, rate / greatest(ceil(rate / 64), 1) AS part FROM mix_rates),
mix_cdf AS (
  SELECT source, rate, part, parts, 0 AS k, exp(-part) AS p, exp(-part) AS c FROM mix_parts
  UNION ALL
  SELECT source, rate, part, parts, k + 1, p * part / (k + 1), c + p * part / (k + 1) FROM mix_cdf WHERE k < ceil(part + 12 * sqrt(part) + 20)),
mix_keys AS (
  SELECT d.*, row_number() OVER () AS rid, coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS key FROM {docs} d),
mix_drawn AS (
  SELECT rid, k.source, ('0x' || substr(md5(concat_ws('|', 'mix-1', key, CASE WHEN i > 0 THEN i::VARCHAR END)), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM (SELECT k.rid, k.source, k.key, unnest(generate_series(0, m.parts - 1)) AS i FROM mix_keys k JOIN mix_parts m ON k.source IS NOT DISTINCT FROM m.source) k),
mix_numbers AS (
  SELECT d.rid, any_value(m.rate) AS rate, count(*) FILTER (m.c <= d.u) AS n_copies
  FROM mix_drawn d JOIN mix_cdf m ON d.source IS NOT DISTINCT FROM m.source GROUP BY d.rid),
mix_counted AS (SELECT k.*, n.rate, n.n_copies FROM mix_keys k JOIN mix_numbers n USING (rid)),
mixed AS (SELECT *, unnest(generate_series(0, n_copies - 1)) AS copy FROM mix_counted WHERE n_copies > 0)
"""
ORACLE = (
    "WITH RECURSIVE "
    + MIX_CTES.format(docs="documents")
    + """
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, n_copies::INTEGER AS n_copies, round(rate, 9) AS rate,
  ('0x' || substr(md5(concat_ws('|', 'mix-1-order', coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))), copy::VARCHAR)), 1, 13))::BIGINT / pow(2, 52) AS shuffle_key
FROM mixed
"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_mixing": op10_mixing}
ORACLES: dict[str, str] = {"op10_mixing": ORACLE}

"""Sharding by a two-pass external shuffle.

Pass one scatters the records into memory-sized buckets by a seeded hash (one exchange). Pass two shuffles
each bucket with Spark's Fisher-Yates ``shuffle`` and writes it to its shard's files. A record's shard comes
from rendezvous hashing of ``doc_id``: the shard with the largest hash wins, so one more shard takes rows
only into itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoutflow.llm.common import fresh_path, load

SEED = 20261
LAW = "key"


def rendezvous(key: Column, n_shards: int, seed: int = SEED) -> Column:
    """Shard 0..n_shards-1 with the largest seeded hash of ``key`` (null keys share one shard)."""
    bits = max(1, (n_shards - 1).bit_length())
    ranked = [F.shiftleft(F.shiftright(F.xxhash64(key, F.lit(seed), F.lit(i)), bits), bits) + F.lit(i).cast("long") for i in range(n_shards)]
    best = F.greatest(*ranked) if n_shards > 1 else ranked[0]
    return best.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def shard(docs: DataFrame, out: str, n_shards: int = 16, bucket_bytes: int = 16 << 20, seed: int = SEED) -> DataFrame:
    """Write ``docs`` to ``out`` as Parquet, one folder a shard, and return the written table.

    Added columns: ``shard``, ``slot`` (gapless from 0 within the shard, the order of the shuffle) and
    ``bucket``. Input columns of these names are overwritten, any others are kept. Null texts and ids are kept as they are (null ids share a
    shard, by the law); repeated rows each get a slot of their own; an empty table gives an empty one.

    A shard has as many buckets as its bytes ask for. A bucket is about ``bucket_bytes`` of text, a longer single text, or all
    copies of one row (equal in id and text), which hash alike; a task of pass two holds the one to few buckets that hash to it.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "bucket", "slot")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    to_shard = rendezvous(F.col("doc_id"), n_shards, seed)
    sizes = {r["s"]: r["b"] for r in docs.groupBy(to_shard.alias("s")).agg(F.sum(size).alias("b")).collect()}  # one row a shard
    buckets = [max(1, -(-sizes.get(s, 0) // bucket_bytes)) for s in range(n_shards)]
    first = [sum(buckets[:s]) for s in range(n_shards)]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), to_shard + 1)
    tie = F.xxhash64(F.lit(seed), "doc_id", "text")
    row = F.struct(F.struct(*columns).alias("row"), to_shard.alias("shard"), (at(first) + F.pmod(tie, at(buckets)).cast("int")).alias("bucket"), tie.alias("tie"))
    keyed = docs.select(row.alias("r")).select("r.*")
    counts = keyed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # Buckets are numbered through all shards. Twice as many partitions as buckets, so that few share one; the aggregation below
    # needs no second exchange, and Spark seeds each partition's shuffle by its number.
    scattered = keyed.repartition(2 * sum(buckets), F.col("bucket")).sortWithinPartitions("bucket", "tie", "row.doc_id")
    shuffled = scattered.groupBy("shard", "bucket").agg(F.shuffle(F.collect_list("row"), seed).alias("rows")).select("shard", "bucket", F.posexplode("rows").alias("pos", "row"))
    placed = shuffled.join(offsets, "bucket").select("row.*", "bucket", (F.col("start") + F.col("pos")).alias("slot"), "shard")
    placed.write.partitionBy("shard").parquet(out)
    return spark.read.schema(placed.schema).parquet(out)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written shards of ``documents`` under the law ``key``, with sizes and checksums of what was written."""
    shards = shard(load(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return shards.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        rendezvous(F.col("doc_id"), 17).alias("grown_shard"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}

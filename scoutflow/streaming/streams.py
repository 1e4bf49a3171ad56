"""Structured Streaming forms of the state operators. Each runs what is there and ends (``availableNow``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scoutflow-")
    return f"{base.rstrip('/')}/scoutflow/{name}-{uuid.uuid4().hex}"


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files at ``path`` (one file or a folder)."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema)
    rows = reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need the zoned type


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def _run(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run to the end; each micro-batch's changed keys are written under its number, and the latest of each key is the result.

    A repeated batch overwrites its own folder, so a restart after a failure counts nothing twice.
    """
    spark = stream.sparkSession
    out, log = shared_folder(spark, name), shared_folder(spark, f"{name}-log")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.parquet(out)
    columns = [c for c in done.columns if c not in ("batch", "n=", *keys)]
    latest = done.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return latest.select(*keys, *[f"s.{c}" for c in stream.columns if c not in keys])


def seen_state(spark: SparkSession, path: str) -> DataFrame:
    """First and last sight of every user, kept for ever: keys are never dropped from the state."""
    stream = _source(spark, path).groupBy("user_id").agg(F.unix_timestamp(F.min("ts")).alias("first_seen"), F.unix_timestamp(F.max("ts")).alias("last_seen"), F.count(F.lit(1)).alias("n_events"))
    return _run(stream, "seen", ["user_id"]).withColumnRenamed("n_events", "n")


def tumbling_counts(spark: SparkSession, path: str, late: str = "2 days") -> DataFrame:
    """Events by type and day, with a watermark that lets state older than ``late`` go."""
    stream = _source(spark, path).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))
    flat = stream.select(F.unix_timestamp("w.start").alias("day"), "event_type", "n_events")
    return _run(flat, "tumbling", ["day", "event_type"]).withColumnRenamed("n_events", "n")

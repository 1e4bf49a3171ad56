"""Readers that survive damage: every file or row gets an outcome, and what is sound is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _present(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    named = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, hadoop in named if hadoop.getFileSystem(conf).exists(hadoop)]


def read_payloads(spark: SparkSession, paths: Sequence[str], items: str | None = None) -> DataFrame:
    """``path, priority, outcome, payload`` of JSON documents, one a path (a file, or a folder of one file), in the order of ``paths``.

    The outcome is ``ok``, ``missing``, ``invalid`` (no JSON), ``not_object``, or ``no_items`` where the member ``items`` is asked for and is no
    list; ``payload`` is a VARIANT, null unless the outcome is ok.
    """
    there = _present(spark, paths)
    listed = spark.createDataFrame([(p, i, p in there) for i, p in enumerate(paths)], "path string, priority int, there boolean")
    texts = None
    for path in there:
        one = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), "value")
        texts = one if texts is None else texts.unionByName(one)
    rows = listed.join(texts, "path", "left") if texts is not None else listed.withColumn("value", F.lit(None).cast("string"))
    parsed = F.try_parse_json(F.ltrim("value"))
    return rows.select("path", "priority", outcome(F.col("there"), parsed, items).alias("outcome"), parsed.alias("payload")).withColumn("payload", F.when(F.col("outcome") == "ok", F.col("payload")))


def outcome(there: Column, parsed: Column, items: str | None = None) -> Column:
    kind = F.schema_of_variant(parsed)
    found = F.when(~there, "missing").when(parsed.isNull(), "invalid").when(~kind.startswith("OBJECT"), "not_object")
    if items:
        found = found.when(F.try_variant_get(parsed, f"$.{items}", "array<variant>").isNull(), "no_items")
    return found.otherwise("ok")


def first_readable(payloads: DataFrame) -> DataFrame:
    """Of ``read_payloads`` the first document, by priority, that is ok; no row where none is."""
    return payloads.filter("outcome = 'ok'").orderBy("priority").limit(1)


def items_by_key(payloads: DataFrame, items: str, key: str) -> DataFrame:
    """``path, key, item`` of the documents' list ``items``: members that are objects with a non-empty ``key``; of equal keys the last in its document."""
    rows = payloads.filter("outcome = 'ok'").select("path", F.posexplode(F.try_variant_get("payload", f"$.{items}", "array<variant>")).alias("at", "item"))
    keyed = rows.withColumn("key", F.trim(F.coalesce(F.try_variant_get("item", f"$.{key}", "string"), F.lit("")))).filter(F.schema_of_variant("item").startswith("OBJECT") & (F.col("key") != ""))
    last = keyed.groupBy("path", "key").agg(F.max("at").alias("at"))
    return keyed.join(last, ["path", "key", "at"]).select("path", "key", "item")


def seen_state(payloads: DataFrame, as_of: Column) -> DataFrame:
    """``state_key, first_seen, last_seen, title, status`` of documents that map a key to a record. A record that is no object is left out; dates that can't be read are ``as_of``."""
    pairs = payloads.filter("outcome = 'ok'").select(F.explode(F.expr("try_variant_get(payload, '$', 'map<string,variant>')")).alias("state_key", "v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    text = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    day = lambda f: F.coalesce(F.try_to_date(text(f), "yyyy-MM-dd"), as_of)
    return pairs.select("state_key", day("first_seen").alias("first_seen"), day("last_seen").alias("last_seen"), text("title").alias("title"), text("status").alias("status"))


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines that fit ``schema``, and ``file, line`` of the others: cut off, of another shape or type."""
    wanted = T._parse_datatype_string(schema)
    whole = T.StructType([*wanted.fields, T.StructField(CORRUPT, T.StringType())])
    read = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(read.alias("r"), F.col("_metadata.file_path").alias("file"), "value")
    sound = F.col(f"r.{CORRUPT}").isNull()
    return rows.filter(sound).select("r.*").select(*wanted.names), rows.filter(~sound).select("file", F.col("value").alias("line"))


def annotated(spark: SparkSession, path: str, answers: Sequence[str]) -> DataFrame:
    """Rows of an annotated CSV (with or without a byte order mark) in which any of ``answers`` is filled in; columns that the file lacks are empty."""
    rows = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    rows = rows.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in rows.columns])
    full = rows.select("*", *[F.lit("").alias(c) for c in answers if c not in rows.columns])
    return full.filter(F.greatest(*[F.trim(F.coalesce(c, F.lit(""))) != "" for c in answers], F.lit(False)))

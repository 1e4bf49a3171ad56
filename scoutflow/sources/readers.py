"""Readers of registries, catalogues, structured data, snapshots and pages behind an injected client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.functions import dates
from scoutflow.operators.topk import soonest_upcoming

SOURCE = "name string, url string, layer string, region string, source_type string, keywords array<string>, notes string, enabled boolean, blocked_link_domains array<string>, render boolean, collector string"
CATALOGUE = "products array<struct<id:string,name:string,introduction:string,plannedproducts:array<struct<executionstartdate:string,executionenddate:string,applicationenddate:string,price:double,cancelled:boolean>>>>"
COURSE = "struct<`@type`:string,name:string,abstract:string,hasCourseInstance:array<struct<name:string,startDate:string,endDate:string,url:string,courseMode:array<string>,offers:array<struct<name:string,price:double,priceCurrency:string>>>>>"
PAGE = "url string, status int, html string, error string"


def source_registry(spark: SparkSession, path: str, disabled: bool = False) -> DataFrame:
    """Sources from JSON lines or one JSON array; missing columns get their defaults, disabled ones are left out unless asked for."""
    rows = spark.read.schema(SOURCE).option("multiLine", True).json(path)
    empty = F.array().cast("array<string>")
    filled = rows.select(
        "name", "url", F.coalesce("layer", F.lit("2")).alias("layer"), F.coalesce("region", F.lit("global")).alias("region"), F.coalesce("source_type", F.lit("page")).alias("source_type"), F.coalesce("keywords", empty).alias("keywords"),
        F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("blocked_link_domains", empty).alias("blocked_link_domains"), F.coalesce("render", F.lit(False)).alias("render"), F.coalesce("collector", F.lit("")).alias("collector"),
    )
    return filled if disabled else filled.filter("enabled")


def yaml_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Rows under ``key`` of one YAML file. The file is a small registry and is read by the driver through Spark's file system."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    data = (yaml.safe_load(text["value"]) if text else None) or {}
    columns = spark.createDataFrame([], schema).columns
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in data.get(key) or [] if isinstance(r, dict)], schema)


def catalogue_editions(rows: DataFrame, as_of: Column, body: str = "body") -> DataFrame:
    """Each product's soonest upcoming edition that is not cancelled, from catalogue JSON in column ``body``."""
    product = rows.select(F.explode(F.from_json(body, CATALOGUE)["products"]).alias("p")).select("p.id", "p.name", F.explode("p.plannedproducts").alias("e"))
    editions = product.filter(~F.coalesce("e.cancelled", F.lit(False))).select(
        F.concat(F.lit("catalogue:"), "id").alias("identity_key"), "name", F.to_date(F.substring("e.executionstartdate", 1, 10)).alias("start_date"), F.to_date(F.substring("e.executionenddate", 1, 10)).alias("end_date"),
        F.to_date(F.substring("e.applicationenddate", 1, 10)).alias("deadline"), F.col("e.price").alias("price"),
    )
    return soonest_upcoming(editions, ["identity_key"], "start_date", as_of, "name")


def course_instances(rows: DataFrame, min_days: int = 5, body: str = "body") -> DataFrame:
    """JSON-LD courses, one row an instance of at least ``min_days``; equal identities once."""
    course = rows.select(F.from_json(body, COURSE).alias("c")).filter("lower(c.`@type`) = 'course'").select("c.name", F.explode("c.hasCourseInstance").alias("i"))
    start, end = F.to_date(F.substring("i.startDate", 1, 10)), F.to_date(F.substring("i.endDate", 1, 10))
    modes = F.transform("i.courseMode", F.lower)
    mode = F.when(F.array_contains(modes, "online") & F.array_contains(modes, "onsite"), "hybrid").when(F.array_contains(modes, "online"), "online").when(F.array_contains(modes, "onsite"), "in-person").otherwise("uncertain")
    academic = F.get(F.filter("i.offers", lambda o: F.contains(F.lower(o["name"]), F.lit("academic"))), F.lit(0))
    offer = F.coalesce(academic, F.get("i.offers", F.lit(0)))
    key = F.concat(F.lit("course:"), F.sha2(F.concat_ws("|", "name", "i.url", "i.startDate"), 256))
    out = course.select(key.alias("identity_key"), F.coalesce("i.name", "name").alias("name"), F.col("i.url").alias("url"), start.alias("start_date"), end.alias("end_date"), dates.duration_days(start, end).alias("duration_days"), mode.alias("mode"), offer["price"].alias("price"), offer["priceCurrency"].alias("currency"))
    return out.filter(F.col("duration_days") >= min_days).dropDuplicates(["identity_key"])


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Scanner rows of a snapshot: ``scanner_opportunities``, or where an old one lacks them the displayed rows that did not come from a model."""
    rows = spark.read.schema(f"schema_version int, generated string, opportunities array<{schema}>, scanner_opportunities array<{schema}>").option("multiLine", True).json(path)
    own = F.coalesce("scanner_opportunities", F.filter("opportunities", lambda r: F.upper(F.trim(F.coalesce(r["source_layer"], F.lit("")))) != "AI"))
    return rows.select(F.explode(own).alias("r")).select("r.*")


def fetched(urls: DataFrame, client: Callable[[], Callable[[str], tuple[int, str]]]) -> DataFrame:
    """``url, status, html, error`` for each row of ``urls``: ``client()`` opens one fetcher for each partition, and its failures become rows."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = client()
        for batch in batches:
            out = []
            for url in batch["url"]:
                try:
                    status, body = get(url)
                    out.append((url, status, body, None))
                except Exception as e:  # the source's failure is data, not ours
                    out.append((url, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "status", "html", "error"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(fetch, PAGE)


def collected(collectors: dict[str, Callable[[], DataFrame]], names: list[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of the named collectors' rows, and an outcome for each name: ok, or why not. One failing leaves the others whole."""
    union, outcomes = None, []
    for name in names:
        try:
            rows = collectors[name]()
            union = rows if union is None else union.unionByName(rows, allowMissingColumns=True)
            outcomes.append((name, "ok"))
        except KeyError:
            outcomes.append((name, "unknown collector"))
        except Exception as e:  # isolated by design: the outcome reports it
            outcomes.append((name, f"{type(e).__name__}: {e}"))
    return union, outcomes


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, where it looks like that and reads back cleanly."""
    again = F.try_to_binary(F.hex(F.encode(text, "ISO-8859-1")), F.lit("hex"))
    fixed = F.try_validate_utf8(again.cast("string"))
    return F.when(text.rlike("[ÃÂâ][\\x80-\\xBF]"), F.coalesce(fixed, text)).otherwise(text)

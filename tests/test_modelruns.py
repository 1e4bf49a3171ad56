"""Fetches, model runs and coverage on empty and odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutflow.operators import coverage, fetching, modelruns

CACHE = "url string, final_url string, etag string, last_modified string, text string, validated_at timestamp"
RESPONSE = "url string, status int, final_url string, etag string, last_modified string, text string, raised boolean"


def test_empty_cache(spark):
    cache = spark.createDataFrame([], CACHE)
    rows = spark.createDataFrame([("a", 200, "a2", "e", "", "t", False), ("b", 304, "b", "", "", None, False), ("c", None, None, None, None, None, True)], RESPONSE)
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    got = {r["url"]: (r["outcome"], r["final_url"], r["text"]) for r in fetching.settled(rows, cache, now).collect()}
    assert got == {"a": ("fresh", "a2", "t"), "b": ("error", None, None), "c": ("error", None, None)}
    assert [(r["url"], r["etag"]) for r in fetching.next_cache(rows, cache, now).collect()] == [("a", "e")]


def test_headers_and_refresh(spark):
    one = spark.range(1).select(
        fetching.kept_headers(F.create_map(F.lit("ETag"), F.lit("x"), F.lit("Server"), F.lit("y"))).alias("h"), fetching.meta_refresh(F.lit(None).cast("string"), F.lit("http://a")).alias("none"),
        fetching.meta_refresh(F.lit('<meta http-equiv="refresh" content="0; url=b/c">'), F.lit("http://a/x/")).alias("to"),
    ).first()
    assert (one["h"], one["none"], one["to"]) == ({"ETag": "x"}, None, "http://a/x/b/c")


def test_nulls(spark):
    fields = F.lit(None).cast("map<string,struct<value:string,texts:array<string>>>")
    none = F.lit(None).cast("array<string>")
    text = F.lit(None).cast("string")
    r = spark.range(1).select(
        modelruns.trusted(fields, "fee", none).alias("fee"), modelruns.trusted_status(fields, none, F.current_date()).alias("status"), modelruns.model_warnings(none, text).alias("own"), modelruns.worth_a_look(F.lit(None).cast("boolean"), none, fields).alias("look"),
        modelruns.preview(text).alias("preview"), coverage.listed(text).alias("parts"), coverage.too_short(F.lit(None).cast("int")).alias("short"), coverage.specific_place(text, text).alias("place"), coverage.fee_table(F.lit("free")).alias("table"),
    ).first()
    assert (r["fee"], r["status"], r["own"], r["preview"], r["parts"], r["short"], r["place"]) == ("", "uncertain", [], "", [], False, False)
    assert not r["look"] and tuple(r["table"]) == ("", None)


def test_nothing_to_rank(spark):
    pages = spark.createDataFrame([("u", "t")], "url string, text string")
    cache = spark.createDataFrame([], f"key string, chunks array<{modelruns.CHUNK}>")
    empty = "page_url string, page_title string, source_name string, chunk_index int, text string, score double"
    got = modelruns.ranked_through_cache(pages, cache, {}, lambda rows: spark.createDataFrame([], empty)).collect()
    assert [(r["page_url"], r["cached"], r["chunks"]) for r in got] == [("u", False, [])]

"""Audit operators on hand-made rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from scoutflow.operators import audit

ITEM = "page_url string, page_title string, confidence string, warnings array<string>, fields map<string,struct<value:string,ids:array<string>>>, missing_before array<string>, re_extracted boolean, at int"


def test_rows_of_nulls_count_as_unknown(spark):
    rows = spark.createDataFrame([("u", None, None, None, None, None, None, 1), ("u", "t", "high", [], {"fee": ("5", ["E1"])}, ["fee"], True, 2)], ITEM)
    got = {(r["kind"], r["name"]): r["n"] for r in audit.histograms(rows).collect()}
    assert got == {("confidence", "unknown"): 1, ("confidence", "high"): 1}
    fee = audit.field_audit(rows).filter("field = 'fee'").first()
    assert (fee["n_known"], fee["n_bare"], fee["n_ids"], fee["n_gained"]) == (1, 0, 1, 1)
    assert audit.field_audit(rows.limit(0)).count() == 0


def test_last_item_of_a_page_counts(spark):
    rows = spark.createDataFrame([(" u ", "old", None, None, None, None, None, 1), ("u", "new", None, None, None, None, None, 2), (" ", "x", None, None, None, None, None, 3)], ITEM)
    assert [tuple(r) for r in audit.last_by_page(rows, "at").select("page_url", "page_title").collect()] == [("u", "new")]


def test_usable_needs_value_evidence_and_text(spark):
    schema = "n int, warnings array<string>, fields map<string,struct<value:string,ids:array<string>,texts:array<string>>>"
    rows = [
        (1, [], {"fee": ("5", ["E1"], ["5 EUR"])}),
        (2, ["llm_json_parse_failed"], {"fee": ("5", ["E1"], ["5 EUR"])}),
        (3, [], {"fee": ("Unknown", ["E1"], ["5 EUR"])}),
        (4, [], {"fee": ("5", ["E1"], [" "])}),
        (5, None, {"fee": ("5", ["E1"], ["5 EUR"])}),
        (6, [], None),
    ]
    got = spark.createDataFrame(rows, schema).select("n", audit.usable(F.col("fields"), F.col("warnings"), ["fee", "title"]).alias("ok")).collect()
    assert {r["n"] for r in got if r["ok"]} == {1}
    assert all(r["ok"] is not None for r in got)


def test_decoded_reads_field_by_field(spark):
    body = '{"title": "A", "start_date": "2026-07-01", "score": "x", "funding_available": false, "fee_eur": 12.5, "extra": {"a": [1]}, "sessions": [{"name": "S", "start_date": "2026-07-01", "end_date": "2026-07-05"}, {"name": "", "start_date": "2026-07-01", "end_date": "2026-07-05"}]}'
    rows = audit.decoded(spark.createDataFrame([(1, body), (2, None), (3, "[]"), (4, "{")], "n int, body string")).orderBy("n").collect()
    first = rows[0]
    assert (first["title"], first["start_date"], first["score"], first["funding_available"], first["fee_eur"], first["bad"]) == ("A", datetime.date(2026, 7, 1), 0.0, False, 12.5, ["score"])
    assert [s["name"] for s in first["sessions"]] == ["S"]
    assert all(r["bad"] == ["record"] and r["title"] == "" and r["sessions"] == [] for r in rows[1:])


def test_topics_are_whole_words_of_any_script(spark):
    rows = spark.createDataFrame([("Über AI und Naïve Öl",), ("FAIR ölig",), (None,)], "t string")
    assert [r[0] for r in rows.select(audit.topics_in(F.col("t"), ["ai", "öl", "C++"])).collect()] == [["ai", "öl"], [], []]

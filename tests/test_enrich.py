"""Overrides, model facts, follow-up crawling and sessions."""

from __future__ import annotations

import tempfile
from datetime import date

from pyspark.sql import functions as F

from scoutflow.operators import enrich, sessions

AS_OF = date(2026, 7, 14)


def test_overrides(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scoutflow-test-"))
    rows = spark.createDataFrame([("http://www.a.org/x/?ref=1", "A", "r", date(2026, 8, 1), 5.0), ("http://b.org", "Bee school", "", None, 1.0), ("http://c.org", "C", "", None, 1.0)], "source_url string, title string, risk_points string, deadline date, fee_eur double")
    over = spark.createDataFrame(
        [(1, "http://a.org/x", "", "", "", "seen", {"deadline": None, "fee_eur": "7"}), (2, "", "A", "", "", "twice", {"fee_eur": "9", "deadline": "2026-09-01"}), (3, "", "", "bee", "exclude", "", None)], enrich.OVERRIDE
    )
    got = {r["title"]: r for r in enrich.apply_overrides(rows, over).collect()}
    assert set(got) == {"A", "C"} and (got["A"]["fee_eur"], got["A"]["deadline"], got["A"]["risk_points"]) == (9.0, date(2026, 9, 1), "r; seen; twice")
    got = enrich.apply_overrides(rows, over.filter("ord = 1")).filter("title = 'A'").first()
    assert got["deadline"] is None and got["fee_eur"] == 7.0


ITEM = "page_url string, ord int, confidence string, warnings array<string>, score double, location string, mode string, start_date date, end_date date, deadline date, status string"


def test_model_facts(spark):
    c = spark.createDataFrame(
        [("http://a.org/x", "", "europe", "uncertain", date(2026, 8, 1), None, None, None, "uncertain"), ("http://b.org", "http://c.org/apply/", "Lund", "online", None, None, 9, date(2026, 7, 1), "open")],
        "source_url string, application_link string, location string, mode string, start_date date, end_date date, duration_days int, deadline date, deadline_status string",
    )
    items = spark.createDataFrame(
        [
            ("http://www.a.org/x?utm_a=1", 1, "low", [], 0.9, "Rome", "hybrid", None, None, None, None), ("http://a.org/x", 2, "high", ["w"], 0.1, "Oslo", "in-person", date(2026, 9, 9), date(2026, 8, 10), date(2026, 7, 30), "open"),
            ("http://c.org/apply", 3, "high", [], 0.5, "Bonn", "hybrid", None, None, None, None), ("http://new.org", 4, "low", [], 0.5, "", "", None, None, None, None), ("http://old.org", 5, "low", ["event_past"], 0.5, "", "", None, None, None, None),
        ], ITEM,
    )
    got = {r["source_url"]: r for r in enrich.enrich_unresolved(c, items, F.lit(AS_OF)).collect()}
    a, b = got["http://a.org/x"], got["http://b.org"]
    assert (a["location"], a["mode"], a["start_date"], a["duration_days"], a["deadline"], a["deadline_status"]) == ("Oslo", "in-person", date(2026, 8, 1), 10, date(2026, 7, 30), "open")
    assert (b["location"], b["mode"], b["deadline_status"], b["duration_days"]) == ("Lund", "online", "closed", 9)
    assert [r["page_url"] for r in enrich.unmatched_items(items, c).collect()] == ["http://new.org"]


def test_crawl(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scoutflow-test-"))
    web = {"http://a.org/fees": '<a href="http://a.org/apply">apply</a><a href="http://a.org/venue">venue</a>', "http://a.org/apply": "<p>x</p>", "http://a.org/venue": "<p>y</p>"}
    start = spark.createDataFrame([("http://a.org/", '<a href="http://a.org/fees">Fees and cost</a><a href="http://b.org/apply">apply</a><a href="http://a.org/x.pdf">apply</a>', ["fee"])], "url string, html string, missing array<string>")
    table = spark.createDataFrame(list(web.items()), "url string, html string")
    got = enrich.crawl(start, lambda urls_: urls_.join(table, "url"), rounds=2, per_parent=2).collect()
    assert sorted((r["parent"], r["url"]) for r in got) == [("http://a.org/", "http://a.org/apply"), ("http://a.org/", "http://a.org/fees")]


def test_sessions(spark):
    text = "Session one: 1 July 2027 to 12 July 2027, deadline 1 May 2027. Session II: 2 August 2027 to 6 August 2027. Session 3: 1 September 2027 to 5 September 2027 (cancelled)"
    got = sessions.sessions_of(text)
    assert got == [("Session 1", date(2027, 7, 1), date(2027, 7, 12), date(2027, 5, 1)), ("Session 2", date(2027, 8, 2), date(2027, 8, 6), None)]
    assert sessions.sessions_of("Session 1: 1 July 2027 to 12 July 2027") == [] and sessions.sessions_of(None) == []
    span = spark.createDataFrame([(text,)], "t string").select(sessions.programme_sessions(F.col("t")).alias("s")).select(sessions.programme_span(F.col("s")).alias("p")).first()["p"]
    assert (span["duration_days"], span["reference_start"]) == (12, date(2027, 8, 2))

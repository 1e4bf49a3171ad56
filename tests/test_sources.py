"""Damaged files, spaced searches and preservation checks."""

import json
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from scoutflow.functions import preserve
from scoutflow.sinks import writers
from scoutflow.sources import ordered, resilient, search


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    return put


def test_payload_outcomes(spark, files, tmp_path):
    good = json.dumps({"items": [{"page_url": " u ", "n": 1}, 5, {"page_url": ""}, {"page_url": "u", "n": 2}, {"n": 3}]})
    paths = [str(tmp_path / "none"), files("cut", good[:20]), files("list", "[1]"), files("other", '{"items": 3}'), files("empty", ""), files("good", good), files("more", '{"items": []}')]
    got = resilient.read_payloads(spark, paths, "items")
    assert [r["outcome"] for r in got.orderBy("priority").collect()] == ["missing", "invalid", "not_object", "no_items", "invalid", "ok", "ok"]
    assert resilient.first_readable(got).first()["path"] == paths[5]
    assert [(r["key"], r["item"].toPython()) for r in resilient.items_by_key(got, "items", "page_url").collect()] == [("u", {"n": 2, "page_url": "u"})]
    assert resilient.read_payloads(spark, [paths[3]]).first()["outcome"] == "ok"
    assert resilient.first_readable(resilient.read_payloads(spark, paths[:3])).count() == 0
    assert resilient.read_payloads(spark, [paths[0]]).first()["outcome"] == "missing"


def test_seen_state_of_damaged_records(spark, files):
    path = files("seen", json.dumps({"a": {"first_seen": "2026-01-02", "last_seen": "bad", "title": "T"}, "b": 3, "c": {}}))
    got = {r["state_key"]: (r["first_seen"], r["last_seen"], r["title"]) for r in resilient.seen_state(resilient.read_payloads(spark, [path]), F.lit("2026-06-01").cast("date")).collect()}
    assert got == {"a": (date(2026, 1, 2), date(2026, 6, 1), "T"), "c": (date(2026, 6, 1), date(2026, 6, 1), None)}


def test_lines_that_do_not_fit(spark, files):
    good, bad = resilient.read_lines(spark, files("rows.json", '{"a": 1, "b": "x"}\n{"a": "no"}\n{"a": 2}\n{"a": 3, "b"\n'), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, "x"), (2, None)]
    assert [r["line"] for r in bad.orderBy("line").collect()] == ['{"a": "no"}', '{"a": 3, "b"'] and bad.first()["file"].endswith("rows.json")


def test_annotated_rows(spark, files):
    path = files("a.csv", '﻿page_url,human_fee_correct,human_notes\nu1,yes,"a ""b"",\nc"\nu2, ,note\nu3,,\n')
    got = resilient.annotated(spark, path, ["human_fee_correct", "human_deadline_correct"]).collect()
    assert [(r["page_url"], r["human_fee_correct"], r["human_notes"], r["human_deadline_correct"]) for r in got] == [("u1", "yes", 'a "b",\nc', "")]


def test_searches_are_spaced(spark, tmp_path):
    log = str(tmp_path / "log")

    def client(name):
        def open_():
            def find(query):
                if query == "bad":
                    raise ValueError("down")
                return [{"url": f"http://{name}/{query}/{i}"} for i in range(9)]

            return find

        return open_

    class Clock:
        """Time that only sleeping moves, kept in a file that all tasks see."""

        def now(self):
            return 0.0

        def sleep(self, seconds):
            with open(log, "a") as f:
                f.write(f"{seconds}\n")

    queries = spark.createDataFrame([(q, p) for p in "xy" for q in ("q1", "bad", "q2", "q1")] + [("q1", "z")], "query string, provider string")
    clock = Clock()
    rows = search.searched(queries, {"x": client("x"), "y": client("y")}, most=2, clock=clock.now, sleep=clock.sleep).collect()
    assert Counter((r["provider"], r["query"], r["error"]) for r in rows) == Counter({(p, q, None): 2 for p in "xy" for q in ("q1", "q2")} | {(p, "bad", "down"): 1 for p in "xy"} | {("z", "q1", "no searcher for z"): 1})
    with open(log) as f:
        assert [float(x) for x in f] == [search.SPACING] * 4  # three calls of each provider, with two pauses between them


def test_results_go_to_their_parents(spark):
    results = spark.createDataFrame(
        [("q", "p", i, "", u, "", None) for i, u in enumerate(["http://a.org/1", "http://b.org/1", "ftp://a.org/x", "http://a.org/f.pdf", "", "HTTP://A.org/2#y", "http://a.org/1", "http://x.a.org/3"], 1)] + [("r", "p", 1, "", "http://a.org/3", "", None), ("bad", "p", None, None, None, None, "e")],
        search.RESULT,
    )
    asked = spark.createDataFrame([("http://www.a.org/", "r", 1), ("http://www.a.org/", "q", 2), ("http://b.org/", "q", 1), ("http://b.org/", "bad", 2)], "parent string, query string, ord int")
    seen = spark.createDataFrame([("http://www.a.org/", "http://a.org/1")], "parent string, url string")
    got = lambda **k: [tuple(r) for r in search.results_of_parents(results, asked, seen, 2, **k).orderBy("parent", "ord").collect()]
    assert got() == [("http://b.org/", "http://b.org/1", 1), ("http://www.a.org/", "http://a.org/3", 1), ("http://www.a.org/", "http://a.org/2", 2)]
    assert ("http://b.org/", "http://a.org/1", 1) in got(official_only=False)


def test_preservation(spark):
    rows = [
        (1, "See https://a.b/c by 2027-01-02 for EUR 1,500 or €20.", "看 https://a.b/c 2027-01-02 1500 20"), (2, "See https://a.b/c by 2027-01-02", "See by 2027-01-03"), (3, "CHF 70 and CHF 70", "90"), (4, "x", " "), (5, None, None), (6, None, "b"),
    ]
    frame = spark.createDataFrame(rows, "id int, original string, changed string")
    got = {r[0]: (r[1], r[2], r[3], r[4]) for r in frame.select("id", preserve.faults(F.col("original"), F.col("changed")), preserve.lost_tokens(F.col("original"), F.col("changed")), preserve.lost_amounts(F.col("original"), F.col("changed")), preserve.has_han(F.col("changed"))).collect()}
    assert got == {1: ([], [], [], True), 2: (["protected token changed"], ["https://a.b/c", "2027-01-02"], [], False), 3: (["currency amount changed"], [], ["70"], False), 4: (["empty"], [], [], False), 5: (["empty"], [], [], False), 6: ([], [], [], False)}
    words = spark.createDataFrame([(1, "A b b c ö", "B x"), (2, None, "a"), (3, "a", None)], "id int, original string, changed string")
    assert sorted(map(tuple, preserve.missing_words(words, "id").collect())) == [(1, "a", 1), (1, "b", 1), (1, "c", 1), (1, "ö", 1), (3, "a", 1)]


def test_ordered_fetch_equals_a_sequential_run(spark):
    web = {
        "http://a/1": (200, "http://a/1", "<title>A</title>one"), "http://a/2": (404, "http://a/2", ""), "http://a/3": (200, "http://a/in", '<meta HTTP-EQUIV="Refresh" CONTENT="5; url=/4">'), "http://a/4": (200, "http://a/4", '<meta http-equiv=refresh content="0;url=/1">four'),
        "http://b/1": (200, "", "<p>no title"), "http://b/2": (200, "http://b/2", '<meta name="x" content="url=/1"><meta http-equiv="refresh" content="5">stay'), "http://b/3": (200, "http://b/3", '<meta http-equiv="refresh" content="0; url=/none">'),
    }
    sources = [(i, f"s{i}", u) for i, u in enumerate(["http://b/1", "http://a/3", "http://gone/1", "http://a/2", "http://a/1", "http://b/3", "http://b/2", "http://a/1"])]

    def client():
        return lambda url: web[url]

    want = []
    for at, name, url in sources:
        try:
            want.append((at, *ordered.read_source(web.__getitem__, url), None))
        except Exception as e:
            want.append((at, None, None, f"{name}: {e}"))
    for lanes in (1, 3):
        got = ordered.collected(spark.createDataFrame(sources, "ord int, name string, url string"), client, lanes)
        assert [(r["ord"], r["final_url"], r["html"], r["error"]) for r in got.orderBy("ord").collect()] == want
    assert [(r["ord"], r["title"], r["text"]) for r in ordered.pages_of(got).orderBy("ord").collect()] == [(0, "s0", "no title"), (1, "s1", "four"), (4, "A", "one"), (6, "s6", "stay"), (7, "A", "one")]
    assert [r["ord"] for r in ordered.errors_of(got).orderBy("ord").collect()] == [2, 3, 5]


def test_sidecar_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("u", '{"title": "T", "n": [1]}'), ("v", "no")], "page_url string, j string").select("page_url", F.try_parse_json("j").alias("extraction"))
    for _ in range(2):
        writers.write_sidecar(items, str(tmp_path / "s"), {"model": "m", "schema_version": "2"})
    good, bad = resilient.read_lines(spark, str(tmp_path / "s" / "items"), "page_url string, extraction struct<title:string,n:array<int>>")
    assert sorted((r["page_url"], r["extraction"] and r["extraction"]["title"]) for r in good.collect()) == [("u", "T"), ("v", None)] and bad.count() == 0
    assert spark.read.json(str(tmp_path / "s" / "about")).collect() == [("m", "2")]

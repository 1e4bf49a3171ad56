"""Structured data against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scoutflow.operators import structured


def compact(value):
    if isinstance(value, list):
        return "; ".join(t for t in map(compact, value) if t)
    if isinstance(value, dict):
        return "; ".join(f"{k}: {t}" for k, v in value.items() if (t := compact(v)))
    return " ".join(str(value or "").split())


def flat(value):
    if isinstance(value, list):
        return [n for v in value for n in flat(v)]
    if isinstance(value, dict) and isinstance(value.get("@graph"), list):
        return flat(value["@graph"])
    return [value]


def made(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.4:
        return r.choice(["", " a  b ", "[1]", '{"x": 1}', 'q"\\]', "ü", 0, 7, 1.5, True, False, None, "end"])
    if kind < 0.7:
        return [made(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {k: made(r, depth - 1) for k in r.sample(["b", "a b", "@graph", "z'", "k.l", "x"], r.randint(0, 3))}


@pytest.fixture(scope="module")
def values():
    r = random.Random(5)
    return [made(r, r.randint(0, 5)) for _ in range(300)]


def test_compact_value(spark, values):
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, values))), "i int, j string").select("i", structured.compact_value(F.col("j")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in rows} == {i: compact(v) for i, v in enumerate(values)}
    odd = spark.createDataFrame([(None,), ("",), ("no  json {",)], "j string").select(structured.compact_value(F.col("j"))).collect()
    assert [r[0] for r in odd] == ["", "", "no json {"]


def test_nodes(spark, values):
    rows = spark.createDataFrame(list(enumerate(map(json.dumps, values))), "i int, j string").select("i", structured.nodes(F.col("j")).cast("array<string>").alias("n")).collect()
    same = lambda x: json.dumps(x, sort_keys=True) if isinstance(x, dict | list) else x
    for r in rows:
        want = flat(values[r["i"]])
        assert len(r["n"]) == len(want)
        for got, node in zip(r["n"], want):
            assert same(json.loads(got)) == same(node) if isinstance(node, dict | list) else True
    assert spark.createDataFrame([("{",), (None,)], "j string").select(F.size(structured.nodes(F.col("j")))).collect() == [(0,), (0,)]


def test_events(spark):
    place = {"@type": "Place", "name": "Hall", "address": {"addressCountry": "SE", "addressLocality": " Lund "}}
    days = [{"startDate": "2027-01-02", "endDate": "2027-01-05", "name": "One"}, "x", {"startDate": "2027-02-01"}, {"startDate": "2027-01-01", "endDate": "2027-09-01"}]
    scripts = [
        json.dumps({"@graph": [{"@type": "WebPage"}, [{"@type": ["Thing", "Course"], "name": "A", "startDate": ["2027-03-01T10:00"], "location": [place], "subEvent": days}]]}),
        "broken {",
        json.dumps([{"@type": "EVENT", "startDate": "3 May 2027", "endDate": 5, "location": "  Up  north", "subEvents": days[0]}, {"@type": "Event", "startDate": "2027-13-01"}, {"@type": "Event"}, 7]),
    ]
    rows = spark.createDataFrame([(1, scripts), (2, []), (3, None)], "page_id int, jsonld array<string>")
    got = [(r["page_id"], r["ord"], str(r["start"]), str(r["end"]), r["name"], r["location"], [(s["name"], str(s["start"]), str(s["end"])) for s in r["sessions"]]) for r in structured.page_events(rows).collect()]
    assert got == [
        (1, 0, "2027-03-01", "2027-03-01", "A", "Hall, Lund, SE", [("One", "2027-01-02", "2027-01-05"), ("Session 3", "2027-02-01", "2027-02-01")]),
        (1, 1, "2027-05-03", "2027-05-03", "", "Up north", []),
    ]

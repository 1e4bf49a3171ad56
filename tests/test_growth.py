"""What larger tables and odd rows showed: the work of a step, and results against the SQL on rows that differ from the given ones."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from scoutflow.functions import dates, spans
from scoutflow.functions import text as tx
from scoutflow.operators import catalogues, deadlines, extract, fees, filters, modelruns, resolve, structured, validation
from scoutflow.plans import registry


def compared(spark, folder, name, **tables):
    """Rows of a query and of its SQL on small tables of our own, ``(rows, columns)`` each."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    frame = registry.queries()[name](spark, str(folder))
    want = con.sql(registry.oracle_sql()[name])
    at = [want.columns.index(c) for c in frame.columns]
    return sorted(map(tuple, frame.collect())), sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_only_a_pages_best_chunks_meet_its_parents(spark):
    members = "page_url string, page_title string, source_name string, chunk_index int, text string, score double"
    base = spark.createDataFrame([], members)
    found = spark.createDataFrame([("http://n/1", "t", "s", i, "x", float(i % 7)) for i in range(50)] + [("http://n/2", "t", "s", 0, "y", 5.5)], members)
    edges = spark.createDataFrame([(f"http://p/{p}", f"http://n/{n}") for p in range(3) for n in (1, 2)], "parent string, url string")
    got = modelruns.with_follow_ups(base, found, edges, 2)
    assert sorted((r["page_url"], r["score"]) for r in got.collect()) == [(f"http://p/{p}", 6.0) for p in range(3) for _ in range(2)]
    # Ranked once by page before the join and once by parent after it.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2


def test_years_of_addresses_do_not_date_a_result(spark, tmp_path):
    rows = [(6, "http://blog.a.org/fr/2075#x"), (7, "http://a.org/phd-position/2001"), (8, "http://a.org/2015/"), (9, "http://www.b.example.net/2030")]
    got, want = compared(spark, tmp_path, "discovery_reasons", pages=(rows, "page_id long, url string"))
    assert got == want


def test_lines_before_parts_whatever_the_part(spark, tmp_path):
    day = datetime.datetime(1997, 1, 1)
    lines = [(2, 2_500_000, 3, 5.0), (2, 4, 4, 5.0), (5, 1_000_007, 3, 5.0), (5, 8, 4, 5.0)]
    got, want = compared(
        spark, tmp_path, "missed_items", lineitem=(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"), orders=([(2, day), (5, day)], "o_orderkey long, o_orderdate timestamp")
    )
    assert got == want and len(got) == 2


def test_places_meet_by_equality_and_lose_no_pair(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    places = ["", "europe", "lund", "lund, sweden", "south lund", "oslo", "o", "sweden", "lund"]
    rows = spark.createDataFrame([(i, f"Summer school {'ab'[i % 2]}", p, datetime.date(2026, 8, 1)) for i, p in enumerate(places)], "rid long, title string, location string, start_date date")
    records = resolve.records_of(rows)
    known = [p for p in set(places) if p not in ("", "europe")]
    related = resolve.related_places(records)
    assert sorted(map(tuple, related.collect())) == sorted((x, y) for x in known for y in known if x in y or y in x)
    own = resolve.own_facts(records)
    got = {(r["a"], r["b"]) for r in resolve.possible_matches(records, related, own, own).collect()}
    fit = lambda x, y: {x, y} & {"", "europe"} or x in y or y in x
    assert got == {(a, b) for a, x in enumerate(places) for b, y in enumerate(places) if a != b and fit(x, y)}


def test_dates_in_batches_are_those_of_expressions(spark):
    texts = ["2030-1-2", "2030-02-30", "12th of March, 2026", "Sept. 3, 2031", "March 12 2026 x", "31.04.2030", "04/31/2030", "13-13-2030", "1 Foo 2030", "", " 5  May  2030 ", "2030-01-02T10:00", "29 Feb 2031"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse_date(F.col("t")).alias("day")).collect()
    assert {r["t"]: r["day"] for r in rows} == {t: dates.date_of(t) for t in texts}


def test_lower_case_finds_the_same_deadlines():
    patterns = deadlines.DATED + deadlines.YEARLESS
    slow, quick = spans.compiled(patterns), spans.compiled_lower([(kind, deadlines.STARTS[kind] + p) for kind, p in patterns])
    text = "JUNE 3: Application Deadline, June 13 note. Abstract deadline is 4 May 2036. Registration until 23 Jun. April 14 - May 24: Registration open. Fees Must be paid before July 3. Register by mail no later than on 5 May."
    places = lambda matches: [(kind, m.span(), m.span(m.lastindex or 0)) for kind, m in matches]
    got = places(spans.matches_of(text.lower(), quick, deadlines.SHADOWED))
    assert got == places(spans.matches_of(text, slow, deadlines.SHADOWED)) and {kind for kind, *_ in got} == set(deadlines.STARTS)


def test_nested_json_is_read_in_batches(spark):
    scripts = ['{"@type":"Event","startDate":"2030-05-01","name":1.50}', '{"@type":"Event","startDate":"2030-05-01","name":[1e5,{"z":1,"a":null}]} rest', '{"@type":"Event","@type":"Event","startDate":"2030-05-01"}', r'{"@type":"Event","startDate":"2030-05-01","name":"\ud800x"}', "[" * 1200 + "]" * 1200]
    rows = spark.createDataFrame([(1, scripts)], "page_id long, jsonld array<string>")
    got = structured.page_events(rows)
    assert [r["name"] for r in got.collect()] == ["1.5", '[100000.0,{"a":null,"z":1}]', "?x"]
    values = {'{"a":1.50,"b":-0.0,"c":1e5,"d":"0","e":{}}': "a: 1.5; c: 100000.0; d: 0", '{"a":1} x': "a: 1", "1 2": "1 2", "1x": "1x", "0": "", '{"a":1,"a":2}': '{"a":1,"a":2}', '{"a":NaN}': '{"a":NaN}', "[" * 1200 + "]" * 1200: "[" * 1200 + "]" * 1200, "[" * 900 + "7" + "]" * 900: "7"}
    texts = spark.createDataFrame([(v,) for v in values], "j string").select("j", structured.compact_value(F.col("j")).alias("t"))
    assert {r["j"]: r["t"] for r in texts.collect()} == values
    # No expression walks the values level by level.
    assert all("lambda" not in frame._jdf.queryExecution().optimizedPlan().toString() for frame in (got, texts))


@pytest.mark.parametrize("name", ["discovery_repeats", "notice_facts", "page_records", "claims_validated"])
def test_narrow_rows_are_dealt_to_all_cores(spark, sf_dir, name):
    assert "RepartitionByExpression" in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_an_address_is_read_once_a_result(spark):
    results = spark.createDataFrame([(1, "Summer school 2027", "official", "http://a.edu:70000/x"), (2, "Summer school 2027", "", " http://a.edu:80/x ")], "ord long, title string, snippet string, url string")
    got = filters.filter_discovery(results, 2026)
    assert sorted((r["ord"], r["reason"]) for r in got.collect()) == [(1, "invalid_url"), (2, "")]
    # Once where the first of each address is found and once where it meets all: the check of ports stood there 22 times.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("65535") == 2


def test_an_item_is_judged_by_its_own_snippets(spark):
    """Two items of one page, of which one cites a snippet that there is not; a page meets its snippets in one join."""
    items = "page_url string, page_title string, page_type string, confidence string, fields map<string,struct<value:string,ids:array<string>>>"
    rows = spark.createDataFrame([("p", "A", "page", "high", {"title": ("T", ["E1"])}), ("p", "B", "page", "high", {"title": ("T", ["E9", " "])}), ("q", "C", "page", "low", None)], items)
    snippets = spark.createDataFrame([("p", "E1", "text"), ("p", "E2", None), ("r", "E1", "x")], "page_url string, id string, text string")
    got = validation.validate(rows, snippets, F.lit("2030-01-01").cast("date"))
    assert {r["page_title"]: (r["confidence"], r["warnings"]) for r in got.collect()} == {"A": ("high", []), "B": ("medium", ["evidence_id_not_found:title"]), "C": ("low", [])}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


@pytest.mark.parametrize("name", ["whole_page_records", "page_records"])
def test_pages_are_parsed_once_and_after_they_are_dealt_out(spark, sf_dir, name):
    """A filter over the parsed page stood below the shuffle with a second reading of each page; and a number of parts that is not stated is cut down to few."""
    plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    tree = plan.toString()
    assert tree.count("parse(") == 1 and tree.index("parse(") < tree.index("RepartitionByExpression")
    assert "RepartitionByExpression [o_orderkey" in tree and ", 4" in tree[tree.index("RepartitionByExpression") :].split("\n")[0]


def _sentences(seed, n):
    """Texts put together at random out of what dates, spans and deadlines are made of."""
    pick = random.Random(seed).choice
    parts = ["3 May 2031", "May 3", "9 June", "June 12, 2031", "3", "12th", "May", "Oct", "September", "2031", "2031-05-01", "2031-05-09", " to ", "-", " - ", "until", "Monday", ",", ".", ":", "\n", " ", " ", " ", "  ", "application deadline", "applications open", "registration open", "Application", "Deadline", "deadline for applications", "hotel", "fee", "st", "paid by", "x"]
    return ["".join(pick(parts) + pick(["", " "]) for _ in range(pick([4, 12, 30]))) for _ in range(n)]


def test_spans_and_deadlines_lose_none_where_patterns_are_left_out(monkeypatch):
    patterns = deadlines.DATED + deadlines.YEARLESS
    named = spans.compiled_lower([(kind, deadlines.STARTS[kind] + p) for kind, p in patterns])
    texts = [*_sentences(1, 3000), "3 May 2031 to 9 May 2031", "May 3 - 9, 2031 and 2031-05-01 until 2031-05-09", "1st" + " " * 12 + "to Monday, 4 June 2031", "x" * 300 + " June 3: " + "y " * 40 + "application deadline"]
    got = [(extract.spans(t), [(k, m.span()) for k, m in spans.matches_of(t.lower(), named, deadlines.SHADOWED, deadlines.begins(t.lower()))]) for t in texts]
    monkeypatch.setattr(extract, "_may_stand", lambda _: range(len(extract._SPANS)))
    assert got == [(extract.spans(t), [(k, m.span()) for k, m in spans.matches_of(t.lower(), named, deadlines.SHADOWED)]) for t in texts]
    assert sum(bool(s) for s, _ in got) > 20 and {k for _, ms in got for k, _ in ms} >= {"dated", "date first", "date after"}


def test_patterns_are_left_out_only_without_their_words(spark):
    kinds = [p for _, p in extract.FUNDING + extract.LEVELS] + extract.IN_PERSON + extract.ONLINE + extract.STRONG_CLOSED + extract.WEAK_CLOSED + extract.NOT_OPEN + extract.OPEN
    assert {*kinds, "hybrid", extract.OWN_COST, extract.FUNDING_WORDS} == set(extract.NEEDS)
    said = [
        "Covers your airfare.", "Bursaries", "A FELLOWSHIP to attend", "Tuition waiver", "waived tuition fee", "Stipends", "meals are provided", "covers subsistence", "all costs are covered", "fully funded", "MASTER level", "Doctoral", "post-doc", "Postdoc",
        "early career", "In person", "onsite", "Residential", "Field school", "the VENUE", "hosted in", "will be held in Lund", "course at EMBL", "Webinar", "no longer accepting applications", "Selection results were sent", "application period is over", "Registration is  closed",
        "the application has passed", "applications closed", "registration is not yet open", "Apply  today", "applications welcome", "Call for applications", "Students should pay their own travel", "applicants are responsible for fees", "",
    ]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    t = F.col("t")
    flags = F.array(*[extract.says(t, [p]) for p in extract.NEEDS])
    plain = F.array(*[t.rlike(f"(?i){p}") for p in extract.NEEDS])
    seen = rows.select(flags.alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in seen) and sum(any(r["a"]) for r in seen) >= len(said) - 3


def test_records_meet_in_as_few_joins_as_they_need(spark, tmp_path):
    """Facts carry what tells of a match, titles join the pairs, and legs without rows are left out: this took ten joins."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = spark.createDataFrame([(i, f"Summer school {'ab'[i % 2]}", ["lund", "oslo"][i // 3], datetime.date(2026, 8, 1)) for i in range(6)], "rid long, title string, location string, start_date date")
    records = resolve.records_of(rows)
    own = resolve.own_facts(records).checkpoint()
    got = resolve.possible_matches(records, resolve.related_places(records).checkpoint(), own, own)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a in range(6) for b in range(6) if a != b and a // 3 == b // 3}


def test_fees_and_places_are_found_with_their_words_alone(spark):
    texts = ["FREE of charge", "There are no course fees", "no Tuition fee", "Participation is free", "Fees: EUR 20", "Venue : Lund", "Hosted in Oslo", "It will take place in Rome, from May", "be held in Bonn.", "nothing", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    patterns = [([f"(?i){p}" for p in fees.FREE], fees.FREE_NEEDS), ([f"(?i){p}" for p in fees.PAID], fees.PAID_NEEDS), (validation.PLACE_PATTERNS, validation.PLACE_NEEDS)]
    got = rows.orderBy("i").select(*[F.struct(tx.first_match(F.col("t"), p, needs), tx.first_match(F.col("t"), p)) for p, needs in patterns]).collect()
    assert all(gated == plain for row in got for gated, plain in row) and [any(x[0] for x in row) for row in got] == [True] * 9 + [False] * 2


def test_a_listing_is_cut_into_cards_once(spark):
    """The join of the cards to their own firsts cut every page twice."""
    card = lambda n, day: f'<div class="card"><a href="/e/{n}">School {n}</a> {day}/05/40 - {day}/06/40</div>'
    rows = spark.createDataFrame([("http://c/l", card(2, "03") + card(1, "02") + card(2, "01") + '<div class="card">none</div>'), ("http://c/m", None)], "page_url string, html string")
    got = catalogues.listed_events(rows, ["card"], "/e/")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("cut(") == 1
    assert [(r["ord"], r["url"], r["title"], r["start"].day, r["text"]) for r in got.orderBy("ord").collect()] == [(0, "http://c/e/2", "School 2", 3, "School 2 03/05/40 - 03/06/40"), (1, "http://c/e/1", "School 1", 2, "School 1 02/05/40 - 02/06/40")]

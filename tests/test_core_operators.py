"""Operators on small fixtures."""

from __future__ import annotations

import random
import tempfile
from datetime import date

from pyspark.sql import functions as F

from scoutflow.operators import compare, evidence, extract, filters, pagerecords, resolve, scoring, semantic, state, topk
from scoutflow.sinks import writers
from scoutflow.sources import readers

AS_OF = date(2026, 7, 14)


def today():
    return F.lit(AS_OF)

CAND = "rid long, identity_key string, source_url string, title string, organizer string, location string, start_date date, end_date date, duration_days int, deadline date, deadline_status string, funding_available boolean, fee string, fee_eur double, score double, ord long"


def cand(rid, **more):
    base = {"rid": rid, "identity_key": "", "source_url": f"http://h/{rid}", "title": "", "organizer": "", "location": "", "start_date": None, "end_date": None, "duration_days": None, "deadline": None, "deadline_status": "uncertain", "funding_available": None, "fee": "", "fee_eur": None, "score": float(100 - rid), "ord": rid}
    return tuple((base | more).values())


def resolved(spark, *rows):
    got = resolve.resolve(spark.createDataFrame(list(rows), CAND), AS_OF).collect()
    return sorted((r.asDict() for r in got), key=lambda r: r["rid"])


def test_resolution_pairs(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scoutflow-test-"))
    s, e = date(2026, 8, 1), date(2026, 8, 10)
    assert len(resolved(spark, cand(1, source_url="http://www.a.org/x/?utm_source=q"), cand(2, source_url="http://a.org/x#top"))) == 1
    title = {"title": "Summer School on Graph Data 2026", "start_date": s, "end_date": e}
    near = title | {"title": "Summer School on Graph Data Methods"}
    assert len(resolved(spark, cand(1, **title), cand(2, **near, organizer="other"))) == 1
    assert len(resolved(spark, cand(1, **title), cand(2, **near | {"start_date": date(2026, 8, 2)}))) == 2
    assert len(resolved(spark, cand(1, **title, location="Berlin"), cand(2, **title, location="Paris"))) == 2
    one = resolved(spark, cand(1, **title, deadline_status="closed"), cand(2, **title, deadline_status="open", deadline=date(2026, 12, 1)))
    assert [(r["rid"], r["deadline_status"]) for r in one] == [(1, "closed")]
    one = resolved(spark, cand(1, **title), cand(2, **title, deadline=date(2026, 7, 30), deadline_status="open", fee="50 EUR", fee_eur=50.0))
    assert (one[0]["deadline"], one[0]["deadline_status"], one[0]["fee_eur"]) == (date(2026, 7, 30), "open", 50.0)
    one = resolved(spark, cand(1, **title, funding_available=True), cand(2, **title, funding_available=False))
    assert one[0]["funding_available"] is False


def test_resolution_identities_in_any_order(spark):
    s, e = date(2026, 8, 1), date(2026, 8, 10)
    kinds = [{"identity_key": "A"}, {}, {"identity_key": "B"}]
    for order in ((0, 1, 2), (1, 0, 2), (2, 1, 0)):
        rows = [cand(i + 1, title="School of Data", start_date=s, end_date=e, **kinds[k]) for i, k in enumerate(order)]
        assert {r["identity_key"] for r in resolved(spark, *rows)} == {"A", "B"}


def greedy(rows):
    """All records in score order against all kept ones, by the stated rules, for dates and places."""
    import re
    from difflib import SequenceMatcher

    def key(title):
        return " ".join(re.findall("[a-z0-9]+", re.sub(r"\b\d{4}\b", "", title.lower())))

    def belongs(r, k):
        x, y = key(r["title"]), key(k["title"])
        like = 0 if "" in (x, y) else 1 if x in y or y in x else SequenceMatcher(None, x, y).ratio()
        start, end, due = (r[f] is not None and r[f] == k[f] for f in ("start_date", "end_date", "deadline"))
        if None not in (r["start_date"], k["start_date"]) and not start or "" not in (r["location"], k["location"]) and r["location"] != k["location"]:
            return False
        return start and end and like >= 0.75 or (start or due) and like >= 0.85 or like >= 0.92 and r["organizer"] == k["organizer"]

    kept = []
    for r in sorted(rows, key=lambda r: (-r["score"], r["ord"])):
        k = next((k for k in kept if belongs(r, k)), None)
        if k is None:
            kept.append(dict(r))
        else:
            k |= {f: k[f] or r[f] for f in ("start_date", "end_date", "deadline", "location")}
    return kept


def test_resolution_against_all_pairs(spark):
    """Near-spelt, contained and short titles, unknown organisers, and dates that come by merging, against one greedy pass over all pairs."""
    titles = ["Bioinformatics", "Bioinformatic", "Summerschool", "Summerschools", "AI", "AI summer school", "", "Graph data school", "Graph data schools Rome"]
    rnd = random.Random(4)
    days = [None, date(2026, 8, 1), date(2026, 8, 9)]
    names = [c.split()[0] for c in CAND.split(", ")]
    for _ in range(2):
        rows = [cand(i, title=rnd.choice(titles), organizer=rnd.choice(["", "", "O", "P"]), location=rnd.choice(["", "", "Rome", "Paris"]), start_date=rnd.choice(days), end_date=rnd.choice(days), deadline=rnd.choice(days)) for i in range(40)]
        want = greedy([dict(zip(names, x)) for x in rows])
        got = resolved(spark, *rows)
        assert [(r["rid"], r["start_date"], r["deadline"], r["location"]) for r in got] == sorted((r["rid"], r["start_date"], r["deadline"], r["location"]) for r in want)


def test_resolution_merges_every_field(spark):
    s, e = date(2026, 8, 1), date(2026, 8, 10)
    more = "funding_type array<string>, funding_evidence string, deadline_evidence string, sessions array<struct<name:string,start:date,end:date,deadline:date>>"
    same = {"title": "School of Data", "start_date": s, "end_date": e}
    one, two = ("S1", s, date(2026, 8, 4), None), ("S2", date(2026, 8, 5), e, date(2026, 7, 20))
    rows = [
        cand(1, **same, funding_available=True) + (["stipend"], "we pay", "", [one]),
        cand(2, **same, funding_available=False, deadline_status="closed", fee_eur=9.0, fee="9 EUR") + ([], "you pay", "it closed", [two, one[:3] + (date(2026, 7, 1),)]),
        cand(3, **same | {"title": "Another thing"}) + (None, None, None, None),
    ]
    got = resolve.resolve(spark.createDataFrame(rows, f"{CAND}, {more}"), AS_OF).orderBy("rid").collect()
    r = got[0]
    assert [x["rid"] for x in got] == [1, 3] and (r["funding_available"], r["funding_type"], r["funding_evidence"]) == (False, [], "you pay")
    assert (r["deadline_status"], r["deadline_evidence"], r["fee"], r["fee_eur"], r["duration_days"]) == ("closed", "it closed", "9 EUR", 9.0, 6)
    assert [tuple(x) for x in r["sessions"]] == [("S1", s, date(2026, 8, 4), date(2026, 7, 1)), two]
    assert got[1]["sessions"] == [] and got[1]["funding_type"] == []


def test_labels_of_a_long_chain(spark):
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scoutflow-test-"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(120)], "a long, b long")
    assert {r["component"] for r in resolve.labels(edges, spark.range(121).withColumnRenamed("id", "rid")).collect()} == {0}


def test_filters_and_scores(spark):
    schema = "deadline_status string, deadline date, start_date date, duration_days int, funding_available boolean, funding_type array<string>, fee string, fee_eur double, mode string, topic_keywords array<string>, region_priority string, source_layer string, target_level string"
    rows = [
        ("open", date(2026, 8, 1), date(2026, 9, 1), 11, True, ["travel grant"], "", 300.0, "in-person", ["a", "b"], "priority", "1", "PhD"),
        ("uncertain", None, date(2026, 7, 20), 4, None, [], "x", 900.0, "online", [], "global", "2", "uncertain"),
    ]
    got = scoring.scored(filters.apply_hard_filters(spark.createDataFrame(rows, schema), today())).orderBy(F.desc("score")).collect()
    assert got[0]["failed_hard_conditions"] == [] and got[0]["score"] == 12 + 25 + 15 + 11 + 12 + 10 + 10 + 8
    assert got[1]["failed_hard_conditions"] == ["application deadline has passed", "duration is below 5 days", "fee exceeds EUR 400 without explicit funding", "online-only", "topic relevance is uncertain"]
    assert got[1]["score"] == 0.0 and got[1]["financial_access_status"] == "unresolved"


def test_discovery(spark):
    rows = [
        (1, "Summer school", "apply now 2026", "https://u.edu/s"), (2, "Summer school", "2026", "https://u.edu/s"), (3, "x", "summer school 2026", "https://www.facebook.com/p"), (4, "x", "summer school", "https://youthop.com/p"),
        (5, "news", "2026", "https://a.org"), (6, "summer school", "2020", "https://a.org"), (7, "phd position", "summer school", "https://a.org"), (8, "summer school", "fun", "https://a.org"), (9, "t", "s", "javascript:x"),
    ]
    got = {r["ord"]: r["reason"] for r in filters.filter_discovery(spark.createDataFrame(rows, "ord int, title string, snippet string, url string"), 2026).collect()}
    assert got == {1: "", 2: "duplicate_url", 3: "social_domain", 4: "aggregator_domain", 5: "missing_programme_signal", 6: "past_year", 7: "excluded_programme_type", 8: "missing_official_signal", 9: "invalid_url"}


def test_caps_equal_the_greedy_scan(spark):
    import random

    rnd = random.Random(1)
    rows = [(i, rnd.choice("abc"), rnd.randint(0, 9)) for i in range(60)]
    kept, per = [], {}
    for i, s, q in sorted(rows, key=lambda r: (-r[2], r[0])):
        if per.get(s, 0) < 5 and len(kept) < 12:
            per[s] = per.get(s, 0) + 1
            kept.append(i)
    got = topk.capped_top(spark.createDataFrame(rows, "i int, s string, q int"), "s", [F.desc("q"), F.asc("i")], 5, 12)
    assert [r["i"] for r in got.collect()] == kept


def test_state(spark):
    prev = spark.createDataFrame([("http://a", date(2026, 1, 1), date(2026, 7, 1), "t", "open"), ("k2", None, date(2026, 7, 1), "t", "open")], "state_key string, first_seen date, last_seen date, title string, status string")
    cur = spark.createDataFrame([("id:1", "http://a", "t2", "closed"), ("id:9", "http://z", "t", "open")], "state_key string, url string, title string, status string")
    got = {r["state_key"]: (r["first_seen"], r["last_seen"]) for r in state.upsert_seen(prev, cur, today()).collect()}
    assert got == {"id:1": (date(2026, 1, 1), AS_OF), "id:9": (AS_OF, AS_OF), "k2": (AS_OF, date(2026, 7, 1))}


def test_gates(spark):
    rows = spark.createDataFrame([(0, 0), (10, 7), (10, 6), (20, 7), (20, 6), (5, 1)], "a int, b int")
    got = rows.select(compare.coverage_gate(F.col("a"), F.col("b")).alias("c"), compare.retention_gate(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x["c"] for x in got] == ["error: nothing attempted", "ok", "error: low coverage", "error: low coverage", "error: low coverage", "error: low coverage"]
    assert [x["r"] for x in got] == ["error: empty", "ok", "ok", "ok", "error: low retention", "ok"]


PAGE = """<html><head><title>Graph School - Home</title><script type="application/ld+json">{"@type":"Event","name":"Graph summer school","startDate":"2026-08-01","endDate":"2026-08-11","location":{"name":"Lund"}}</script></head>
<body><h1>Graph summer school</h1><p>Application deadline: 20 July 2026. Hotel booking 1 June 2026 to 5 June 2026.</p><ul><li>Course <a href="/apply">Apply</a></li></ul>
<p>Travel grants are available. No stipends. Registration fee: EUR 300. The venue is the campus. For PhD students in AI.</p></body></html>"""


def test_page_to_candidate(spark):
    pages = spark.createDataFrame([(1, "http://h/x", PAGE), (2, "http://h/y", "<p>nothing</p>"), (3, "http://h/z", None)], "page_id long, url string, html string")
    got = pagerecords.page_candidates(pages, ["AI", "graph"], {"EUR": 1.0}, today()).collect()
    assert [r["page_id"] for r in got] == [1]
    r = got[0]
    assert (r["title"], r["start_date"], r["duration_days"], r["deadline"], r["deadline_status"]) == ("Graph summer school", date(2026, 8, 1), 11, date(2026, 7, 20), "open")
    assert r["funding_type"] == ["travel grant"] and r["fee_eur"] == 300.0 and r["mode"] == "in-person" and r["target_level"] == "PhD" and r["topic_keywords"] == ["AI", "graph"]
    links = pages.select(extract.parsed_page(F.col("html")).alias("p")).first()["p"]["links"]
    assert (links[0]["href"], links[0]["label"], links[0]["card"]) == ("/apply", "Apply", "Course Apply")


def test_spans():
    text = "9-14 June 2025; June 9 – June 14, 2025; 1 July 2025 to 3 July 2025; hotel booking 1 May 2025 - 9 May 2025; 2025-01-01 to 2026-01-01"
    assert [(a, b) for a, b, _ in extract.spans(text)] == [(date(2025, 7, 1), date(2025, 7, 3)), (date(2025, 6, 9), date(2025, 6, 14))]


def test_evidence(spark):
    chunks = spark.createDataFrame([("u", 0, "The deadline is 1 May 2026. Accept our cookie policy today. The fee is EUR 200 per person. the fee is EUR 200 per person.")], "page_url string, chunk_index int, chunk string")
    found = evidence.snippets(chunks)
    rows = found.orderBy("id").collect()
    assert [r["id"] for r in rows] == ["E1", "E2"]
    assert [r["id"] for r in rows if "fee" in r["signals"]]
    replies = spark.createDataFrame([('{"a": "1"}',), ('```json\n{"a": "2"}\n```',), ("<think>{}</think> so {\"a\": \"3\"} end",), ("none",)], "r string")
    assert [r["x"] for r in replies.select(evidence.field(evidence.model_json(F.col("r")), "a").alias("x")).collect()] == ["1", "2", "3", "unknown"]


def test_semantic_ranking(spark):
    text = "Application deadline for the summer school is soon and funding is available. " * 5
    pages = spark.createDataFrame([("u", "t", text), ("v", "archive", text), ("w", "t", "nothing of use")], "url string, title string, text string")
    query = semantic.hashing_model()()([text])[0].tolist()
    got = semantic.rank_pages(pages, query, semantic.embedder(semantic.hashing_model()), top=2, least=0.3, size=200, overlap=20).collect()
    assert {r["url"] for r in got} == {"u"} and [r["rank"] for r in got] == [1, 2]


def test_sources_and_sinks(spark, tmp_path):
    body = '{"products":[{"id":"p","name":"n","plannedproducts":[{"executionstartdate":"2026-08-01","cancelled":true},{"executionstartdate":"2026-09-01","executionenddate":"2026-09-09","price":5.0},{"executionstartdate":"2026-10-01"}]}]}'
    got = readers.catalogue_editions(spark.createDataFrame([(body,)], "body string"), today()).collect()
    assert [(r["identity_key"], r["start_date"], r["price"]) for r in got] == [("catalogue:p", date(2026, 9, 1), 5.0)]
    course = '{"@type":"Course","name":"c","hasCourseInstance":[{"startDate":"2026-09-01","endDate":"2026-09-09","courseMode":["Online","Onsite"],"offers":[{"name":"industry","price":9},{"name":"Academic","price":3,"priceCurrency":"EUR"}]},{"startDate":"2026-09-01","endDate":"2026-09-02"}]}'
    got = readers.course_instances(spark.createDataFrame([(course,)], "body string")).collect()
    assert [(r["mode"], r["price"], r["duration_days"]) for r in got] == [("hybrid", 3.0, 9)]

    def client():
        def get(url):
            if "bad" in url:
                raise OSError("no")
            return 200, "<p>x</p>"

        return get

    got = {r["url"]: (r["status"], r["error"]) for r in readers.fetched(spark.createDataFrame([("http://a",), ("http://bad",)], "url string"), client).collect()}
    assert got == {"http://a": (200, None), "http://bad": (None, "OSError: no")}
    text = spark.createDataFrame([("KrakÃ³w",), ("plain",)], "t string").select(readers.repaired(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in text] == ["Kraków", "plain"]
    items = spark.createDataFrame([(1, "A & b", "http://a", "G", "d"), (2, "x", "http://b", "g", "d")], "ord int, title string, link string, guid string, description string")
    feed = writers.rss(writers.feed_items(items.limit(1), items), "t", "http://t")
    assert feed.count("<item>") == 1 and "A &amp; b" in feed
    assert writers.spliced("a<s>old</e>b", "new", "<s>", "</e>") == "a<s>\nnew\n</e>b" and writers.spliced("x", "n", "<s>", "</e>") is None
    (tmp_path / "s.yaml").write_text("sources:\n- {name: a, url: u}\n")
    assert readers.yaml_rows(spark, str(tmp_path / "s.yaml"), "sources", "name string, url string").collect() == [("a", "u")]

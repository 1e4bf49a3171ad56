"""Catalogues with hops, and the extraction loop over recorded replies."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from scoutflow.operators import catalogues, replies


def test_cards_nested_and_odd(spark):
    page = '<div class="b card x">One <a href="/e/1">A  b</a><div class="card b">Two <script>no</script><a href="http://o/e/2">C</a></div></div><div class="card">no</div><div class="b card"><a href="/e/3">'
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "i int, html string").select("i", catalogues.cards(F.col("html"), F.lit("http://h/l"), ["card", "b"]).alias("c")).orderBy("i").collect()
    assert [[(c["text"], [tuple(x) for x in c["links"]]) for c in r["c"]] for r in rows] == [
        [("One A b Two C", [("http://h/e/1", "A b"), ("http://o/e/2", "C")]), ("Two C", [("http://o/e/2", "C")]), ("", [])], [], [],
    ]


def test_listed_events(spark):
    card = lambda href, label, when: f'<p class="card"><a href="/e/{href}">x</a><a href="/e/{href}">{label}</a><a href="/other">much longer label</a> {when}</p>'
    page = card(1, "Title one", "03/05/27 - 09/05/27") + card(2, "No date", "soon") + card(1, "Again", "03/06/27-09/06/27") + card(3, "Bad", "33/05/27 - 09/05/27") + card(4, "Four", "01/01/27 - 02/01/27")
    rows = spark.createDataFrame([("http://h/l", page)], "page_url string, html string")
    got = [(r["url"], r["title"], r["start"], r["end"]) for r in catalogues.listed_events(rows, ["card"], "/e/").orderBy("ord").collect()]
    assert got == [("http://h/e/1", "Title one", date(2027, 5, 3), date(2027, 5, 9)), ("http://h/e/4", "Four", date(2027, 1, 1), date(2027, 1, 2))]


def test_hops_keep_order_origin_and_limit(spark):
    web = {
        "a": '<p>A</p><a href="r1">register</a><a href="n">news</a><a href="r2">Registration</a><a href="r3">register</a><a href="r4">register</a>', "b": '<a href="r1">register</a>B', "r1": 'R1<a href="registration/z">x</a>',
        "r2": "R2", "r3": None, "registration/z": "Z",
    }
    asked = []

    def fetch(urls):
        wanted = [r["url"] for r in urls.collect()]
        asked.extend(wanted)
        return spark.createDataFrame([(u, web.get(u)) for u in wanted], "url string, html string")

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir") + "-checks")
    hops = [catalogues.Hop("follow-up", catalogues.is_registration), catalogues.Hop("registration", catalogues.is_registration)]
    origins = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "missing")], "origin string, url string")
    rows = catalogues.chained(origins, fetch, hops).orderBy("origin", "path").collect()
    assert [(r["origin"], r["hop"], r["text"]) for r in rows] == [
        ("a", "first", "A register news Registration register register"), ("a", "follow-up", "R1 x"), ("a", "registration", "Z"), ("a", "follow-up", "R2"),
        ("b", "first", "register B"), ("b", "follow-up", "R1 x"), ("b", "registration", "Z"),
    ]
    assert sorted(asked) == ["a", "b", "missing", "r1", "r2", "r3", "registration/z"]


@pytest.fixture
def snippets(spark):
    return spark.createDataFrame([(f"http://p/{i % 40}", f"E{i // 40 + 1}", f"text {i}") for i in range(480)] + [("http://odd", "E1", None)], "page_url string, id string, text string")


def test_requests_are_keyed_by_what_they_ask(spark, snippets):
    one = {r["page_url"]: r for r in replies.requests(snippets, "m", "1", "Read.").collect()}
    assert len(one) == 41 and one["http://p/3"]["prompt"].split("\n")[2:4] == ["[E1] text 3", "[E2] text 43"] and one["http://p/3"]["prompt"].index("[E9]") < one["http://p/3"]["prompt"].index("[E10]")
    keys = {m: replies.requests(snippets.orderBy(F.rand(3)), *m).filter("page_url = 'http://p/3'").first()["request_key"] for m in [("m", "1", "Read."), ("n", "1", "Read."), ("m", "2", "Read."), ("m", "1", "Look.")]}
    assert len(set(keys.values())) == 4 and keys["m", "1", "Read."] == one["http://p/3"]["request_key"]


def test_a_run_that_ends_is_taken_up_again(spark, snippets, tmp_path):
    wanted, log, calls = replies.requests(snippets, "m", "1", "Read."), str(tmp_path / "log"), str(tmp_path / "calls")

    def client(end_after):
        def open_():
            def complete(prompt):
                with open(calls, "a+") as f:  # one process reads all local tasks' calls
                    f.write(prompt.split("\n")[1] + "\n")
                    f.seek(0)
                    if end_after and len(f.readlines()) > end_after:
                        raise SystemExit("the run ends")
                if prompt.split("\n")[1] == "Page: http://odd":
                    raise ValueError("no model")
                return '{"title": "T"}'

            return complete

        return open_

    with pytest.raises(Exception):
        replies.answer(wanted, log, client(20), rounds=6)
    kept = {r["page_url"] for r in replies.read_log(spark, log).collect()}
    assert kept and len(kept) < 41
    done = replies.answer(wanted, log, client(0), rounds=6).collect()
    assert len(done) == 41 and len({r["request_key"] for r in done}) == 41
    with open(calls) as f:
        after = f.read().splitlines()
    for url in kept:
        assert after.count(f"Page: {url}") == 1
    again = replies.answer(wanted, log, client(0), rounds=3)
    assert again.count() == 41
    with open(calls) as f:
        assert f.read().splitlines() == after  # nothing is asked twice
    replies.answer(wanted, log, client(0), retry_failures=True)
    got = {r["page_url"]: r["warnings"] for r in replies.items(wanted, replies.read_log(spark, log)).collect()}
    assert got.pop("http://odd") == ["llm_unavailable:no model"] and set(map(tuple, got.values())) == {()}
    with open(calls) as f:
        assert len(f.read().splitlines()) == len(after) + 1


def test_items_of_odd_replies(spark):
    wanted = spark.createDataFrame([(f"u{i}", f"k{i}", "p") for i in range(5)], "page_url string, request_key string, prompt string")
    log = spark.createDataFrame([("k0", "u0", '{"fee": {"value": 3, "evidence_ids": ["e2", "x"]}, "title": "A", "none": null}', None, 1), ("k1", "u1", "[]", None, 1), ("k2", "u2", "", None, 1), ("k3", "u3", None, "e1", 1), ("k3", "u3", None, "e2", 2), ("k0", "u0", None, "late", 9)], "request_key string, page_url string, reply string, error string, t int")
    log = log.select("request_key", "page_url", "reply", "error", F.timestamp_seconds("t").alias("asked_at"))
    got = {r["page_url"]: r for r in replies.items(wanted, log).select("page_url", "warnings", replies.fields_of(F.col("extraction"), ["fee", "title", "none", "other"]).alias("f")).collect()}
    assert {u: r["warnings"] for u, r in got.items()} == {"u0": [], "u1": ["llm_json_parse_failed"], "u2": [], "u3": ["llm_unavailable:e2"], "u4": ["llm_unavailable:not asked"]}
    assert {k: (v["value"], v["ids"]) for k, v in got["u0"]["f"].items()} == {"fee": ("3", ["E2"]), "title": ("A", [])}

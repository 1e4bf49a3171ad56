"""Deadlines, places, titles, fees, status and adapters of pages."""

from datetime import date

from pyspark.sql import functions as F

from scoutflow.functions import spans
from scoutflow.operators import deadlines, extract, fees, pagerecords, places, validation

def as_of():
    return F.lit("2027-01-01").cast("date")


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_spans_outside_others():
    assert spans.outside([0, 5, 10, 11, 30], [(3, 10), (20, 25)]) == [True, False, False, True, True]
    assert spans.outside([1], []) == [True]


def test_spans_found(spark):
    got = column(spark, ["aXbb a", "", None], lambda v: spans.found(v, [("one", "a(x)?"), ("two", "b+")], 1, 1, {"two": "one"}))
    assert [[(m["kind"], m["start"], m["value"], m["context"]) for m in row] for row in got] == [[("one", 0, "X", "aXb"), ("one", 5, "a", " a")], [], []]


def test_deadlines_without_a_year(spark):
    texts = [
        "15 May: application deadline, 20 May notification.",
        "Apply by June 3. Apply by 4 March 2027.",
        "1 March - 2 April: applications open. Registration until 30 Sep. Payment is due before 5 June.",
        "Deadline: 29 February",
        "Application deadline: 14 May 2027",
        None,
    ]
    start = F.lit("2027-08-01").cast("date")
    got = column(spark, texts, lambda v: deadlines.deadlines(v, start))
    assert [[(d["day"], d["category"]) for d in row] for row in got] == [
        [(date(2027, 5, 15), 0)],
        [(date(2027, 3, 4), 0), (date(2027, 6, 3), 0)],
        [(date(2026, 9, 30), 1), (date(2027, 4, 2), 0), (date(2027, 6, 5), 2)],
        [],
        [(date(2027, 5, 14), 0)],
        [],
    ]
    assert column(spark, texts, lambda v: F.size(deadlines.deadlines(v))) == [0, 1, 0, 0, 1, 0]


def test_deadline_evidence(spark):
    texts = ["Poster deadline: 9 May 2027. Registration deadline 1 April 2027. registration deadline 1 March 2027.", "none"]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", deadlines.deadlines(F.col("v")).alias("due"))
    rows = rows.select("i", "due", deadlines.chosen_deadline(F.col("due")).alias("c"))
    got = [(r[0], r[1]) for r in rows.orderBy("i").select("c.day", deadlines.deadline_evidence(F.col("due"), F.col("c"))).collect()]
    assert got == [(date(2027, 4, 1), "Registration deadline 1 April 2027 (other dates listed: 2027-03-01, 2027-05-09)"), (None, "")]


def test_label_values(spark):
    lines = [
        ["Dates", "May", "VENUE:", "Hall", "Lund", "Sweden"], ["Place", "Dates", "May"], ["Location", "Upsala town", "x"], ["venue"], ["a venue", "b"], [],
    ]
    assert column(spark, lines, lambda v: places.label_value(v, places.PLACE_LABELS), "array<string>") == ["Hall Lund", "", "Upsala town", "", "", ""]


def test_titles_and_places_of_headings(spark):
    heads = [[["Home"], ["Winter school", "3 May 2027", "Lund", "Sweden", "x"]], [["The 48", "th", "meeting"]], [["3 May 2027", "x" * 101]], []]
    kind = "array<array<string>>"
    assert column(spark, heads, places.heading_place, kind) == ["Lund, Sweden", "", "", ""]
    assert column(spark, heads, lambda v: places.page_title(v, F.lit("Shared name"), F.lit(None).cast("string")), kind) == ["Winter school", "The 48th meeting", "3 May 2027 " + "x" * 101, "Shared name"]
    bad = ["Home of all", "WELCOME TO ALL", "www.a-b.org", "events: here", "Site archive 3", "Menu", "short", "https://x y z"]
    assert column(spark, bad, places.names_something) == [False] * len(bad)
    assert column(spark, ["ICVSS 2027", "Data summer school"], places.names_something) == [True, True]


def test_clean_places(spark):
    values = ["Uni, ul. Kraków 3, Krakow, KRAKÓW, Poland", "Venue Preview", ": Mila, Montreal;", "online room", "EEML2022", "[x]", "the hall", None]
    assert column(spark, values, validation.clean_place) == ["Uni, ul. Kraków 3, Krakow, Poland", "", "Mila, Montreal", "Online", "", "", "", None]


def test_fees(spark):
    texts = [
        "Participation is free for all. Fee: EUR 20", "You are required to pay a contribution of 50 € in cash", "Course fees: EUR 900 industry, EUR 300 students, EUR 5 lunch. Application here",
        "PhD students pay 120 EUR in all, and that covers everything that is on offer. Student rooms for doctoral candidates are 25 EUR", "Fees: to be announced", "Costs: about 70 EUR", "", None,
    ]
    assert column(spark, texts, fees.fee_of) == ["Participation is free", "50 €", "EUR 300", "120 EUR", "", "about 70 EUR", "", ""]


def test_status(spark):
    texts = ["We are no longer accepting applications. Apply now!", "The abstract deadline has passed. Apply now!", "The application deadline has passed.", "Applications will open soon", "x", None]
    assert column(spark, texts, lambda v: extract.application_status(v, F.lit("2027-02-01").cast("date"), as_of())) == ["closed", "open", "closed", "not_open", "open", "open"]
    assert column(spark, ["x"], lambda v: extract.application_status(v, F.lit(None).cast("date"), as_of())) == ["uncertain"]


def test_adapters_recognisers_and_origins(spark):
    head = "<h1>Data summer school</h1><p>Apply now. Application deadline: 1 March 2027. Hosted in Lund.</p>"
    marks = '<abbr class="x dtstart" title="2027-05-01">1</abbr><div class="tribe-venue">Hall<br>+ Google Map</div><div class="tribe-events-event-url"><b><a href="https://a.b/c">go</a></b></div>'
    pages = [
        (1, "http://a.example/1", head + marks), (2, "http://b.a.example/2", head + marks + '<abbr class="dtstart" title="2027-06-01">2</abbr>'),
        (3, "http://c.example/3", head + '<script type="application/ld+json">[{"@graph":[{"@type":"Event","startDate":"2027-07-01","name":"N","location":"Oslo"}]}]</script>'),
        (4, "http://c.example/4", "<h1>Data summer school</h1><p>Apply. 1 May 2027 to 3 May 2027; 1 June 2027 to 3 June 2027; 1 July 2027 to 3 July 2027. Deadline: 1 March 2027</p>"), (5, "http://c.example/5", None),
    ]
    adapter = {"a.example": lambda p: {"title": F.lit("Given"), "start": F.when(F.size(p["marked"]) > 3, F.lit("2027-09-09"))}}
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in pagerecords.page_candidates(rows, [], {"EUR": 1.0}, as_of(), adapter).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["title"], got[1]["start_date"], got[1]["location"], got[1]["application_link"]) == ("Given", date(2027, 5, 1), "Hall", "https://a.b/c")
    assert got[1]["origins"]["start"] == "events calendar" and got[1]["origins"]["title"] == "a.example" and got[1]["origins"]["deadline"] == "text"
    assert (got[2]["start_date"], got[2]["location"], got[2]["origins"]["start"]) == (date(2027, 9, 9), "Lund", "a.example")
    assert (got[3]["title"], got[3]["start_date"], got[3]["location"], got[3]["origins"]["place"]) == ("Data summer school", date(2027, 7, 1), "Oslo", "structured data")
    assert got[3]["mode"] == "in-person" and got[3]["deadline_status"] == "open"
    none = pagerecords.page_candidates(rows.limit(0), [], {"EUR": 1.0}, as_of())
    assert none.count() == 0

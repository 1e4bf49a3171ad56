"""Queries that read facts out of pages and structured data made of the driver tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutflow.operators import deadlines, extract, pagerecords, places, structured
from scoutflow.plans.candidates import LATER, spread, table

SHIFT = 14600  # days that bring the orders of the nineties to times to come


def _text(day):
    return F.date_format(day, "d MMMM yyyy")


def _short(day):
    return F.date_format(day, "MMMM d")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_clerk", F.concat(F.lit("Clerk#"), F.col("o_custkey").cast("string")))


def _spread(spark, sf_dir):
    """Orders dealt to all cores while they are narrow: a file has few row groups, and reading a page takes long."""
    return spread(_orders(spark, sf_dir), "o_orderkey")


def structured_events(spark, sf_dir):
    """Orders with their lines as JSON-LD events, alone, in a graph, in lists of lists, as one of a list's types; lines are sub-events. Broken scripts and other nodes stand beside them."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").cast("int").alias("q")))).alias("lines"))  # noqa: E741
    o = _orders(spark, sf_dir).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    sub = F.transform("lines", lambda x: F.struct(F.concat(F.lit("Line "), x["n"].cast("string")).alias("name"), F.concat(iso(x["d"]), F.lit("T09:00:00")).alias("startDate"), iso(F.date_add(x["d"], x["q"])).alias("endDate")))
    fields = lambda kind, start, place: F.struct(kind.alias("@type"), F.col("o_clerk").alias("name"), start.alias("startDate"), place.alias("location"), F.col("subs").alias("subEvent"))
    day = F.to_date("o_orderdate")
    address = F.struct(F.col("o_orderpriority").alias("name"), F.struct(F.lit("SE").alias("addressCountry"), F.concat(F.lit(" City  "), F.col("o_custkey").cast("string")).alias("addressLocality")).alias("address"))
    plain = F.to_json(fields(F.lit("EducationEvent"), iso(day), address))
    listed = F.to_json(fields(F.array(F.lit("Thing"), F.lit("course")), F.array(_text(day)), F.array(address)))
    other = F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.col("o_clerk").alias("name"), iso(day).alias("startDate")))
    k = F.col("o_orderkey")
    script = F.when(k % 4 == 0, F.col("plain")).when(k % 4 == 1, F.concat(F.lit('{"@context":"x","@graph":['), "other", F.lit(","), listed, F.lit("]}"))).when(k % 4 == 2, F.concat(F.lit("[["), "other", F.lit(',{"@graph":[['), "plain", F.lit("]]}]]"))).otherwise(F.concat(F.lit("["), listed, F.lit(",7,null]")))
    # Lines and texts that stand in several scripts are made once a page.
    o = pagerecords.staged(pagerecords.staged(o, subs=sub), plain=plain, other=other)
    pages = o.select(k.alias("page_id"), F.array("other", F.substring("plain", 1, 40), script).alias("jsonld"))
    spans = F.array_join(F.transform("sessions", lambda s: F.concat_ws(" ", s["name"], s["start"].cast("string"), s["end"].cast("string"))), "; ")
    return structured.page_events(pages).select("page_id", "ord", F.col("start").alias("start_date"), F.col("end").alias("end_date"), "name", "location", spans.alias("sessions"))


def nested_values(spark, sf_dir):
    """Orders with customer and lines as nested values, put into text."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("mode"), F.col("l_quantity").cast("int").alias("n"), F.array("l_returnflag", "l_linestatus").alias("flags")))).alias("lines"))  # noqa: E741
    o = _orders(spark, sf_dir).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    value = F.struct(
        F.col("o_clerk").alias("clerk"), F.struct(F.struct(F.col("o_custkey").alias("id")).alias("customer"), F.lit("").alias("note"), (F.col("o_orderkey") % 2 == 0).alias("even")).alias("who"),
        F.array().cast("array<string>").alias("none"), F.lit(0).alias("zero"), F.col("lines"),
    )
    return o.select("o_orderkey", structured.compact_value(F.to_json(value)).alias("text"))


def page_deadlines(spark, sf_dir):
    """Orders as notices with dates of all forms: with a year, without one before and after its words, ranges and payments; and which of them governs."""
    start = F.date_add(F.to_date("o_orderdate"), SHIFT)
    d = lambda n: F.date_add(start, -n)
    text = F.concat(
        F.lit("The school of "), "o_clerk", F.lit(". "), _short(d(40)), F.lit(": application deadline, "), _short(d(30)), F.lit(" notification. "),
        F.lit("Abstract deadline is "), _text(d(70)), F.lit(". Registration until "), F.date_format(d(20), "d MMM"), F.lit(". "), _short(d(90)), F.lit(" - "), _short(d(50)), F.lit(": registration open. "),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Fees must be paid before "), _short(d(10)), F.lit(". "))).otherwise(""),
        F.when(F.col("o_orderpriority") < "3", F.concat(F.lit("Application deadline: "), _short(d(60)), F.lit(". "))).otherwise(""),
    )
    rows = _spread(spark, sf_dir).select("o_orderkey", start.alias("start"), text.alias("text"))
    rows = rows.select("o_orderkey", deadlines.deadlines(F.col("text"), F.col("start")).alias("due"))
    chosen = deadlines.chosen_deadline(F.col("due"))
    return rows.select(
        "o_orderkey", F.array_join(F.transform("due", lambda x: F.concat(x["day"].cast("string"), F.lit(" "), x["category"].cast("string"))), "; ").alias("found"), chosen["day"].alias("deadline"),
        deadlines.deadline_evidence(F.col("due"), chosen).alias("evidence"),
    )


def page_places(spark, sf_dir):
    """Suppliers' pages that give title and place by label, below a heading's date, in prose or not at all."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k, town = F.col("s_suppkey"), F.concat(F.lit("Town "), F.col("s_suppkey").cast("string"))
    land = F.initcap("n_name")
    head = F.concat(F.lit("<html><head><title>Winter school "), "s_name", F.lit(" | Site</title></head><body><h1>"), F.when(k % 3 == 0, "Home").otherwise(F.concat(F.lit("The 4<sup>th</sup> school of "), "s_name", F.lit("<br>3 May 2027<br>"), F.when(k % 3 == 1, F.concat(town, F.lit("<br>"), land)).otherwise(""))), F.lit("</h1>"))
    label = F.when(k % 4 == 0, F.concat(F.lit("<dl><dt><b>Venue:</b></dt><dd>"), town, F.lit("</dd><dd>, "), land, F.lit(" , "), F.upper(town), F.lit("</dd><dt>Dates</dt><dd>May</dd></dl>"))).when(k % 4 == 1, F.concat(F.lit("<p>It will take place in "), town, F.lit(" from May on.</p>"))).otherwise("<p>Nothing.</p>")
    page = extract.parsed_page(F.concat(head, label, F.lit("</body></html>")))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", page.alias("p"))
    place = places.page_place(F.col("p.pieces"), F.col("p.heads"), F.col("p.text"), F.lit("continental europe"))
    return rows.select("s_suppkey", places.page_title(F.col("p.heads"), F.col("p.shared_title"), F.col("p.title")).alias("title"), place.alias("place"), places.is_specific(place, F.lit("Europe")).alias("specific"))


def page_status(spark, sf_dir):
    """Orders' pages that say in many ways whether applications are open; what is said beats the date, weak signs yield to open ones."""
    said = [
        "We are no longer accepting applications.", "The application period is over.", "The abstract deadline has passed. Apply now!", "Applications are closed.", "Applications are closed for talks. Apply online!",
        "Early registration is closed.", "Registration is closed.", "Applications will open in May.", "Registration is not yet open.", "The deadline has passed.",
    ]
    day = F.date_add(F.to_date("o_orderdate"), SHIFT)
    o = _orders(spark, sf_dir)
    rows = o.select("o_orderkey", F.explode(F.array(*map(F.lit, [*said, ""]))).alias("said"), F.when(F.col("o_orderstatus") != "P", day).alias("day"), "o_clerk")
    return rows.select("o_orderkey", "said", extract.application_status(F.concat_ws(" ", "o_clerk", "said"), F.col("day"), F.lit(LATER).cast("date")).alias("status"))


def whole_page_records(spark, sf_dir):
    """Orders as pages with every kind of fact: structured data for a third, sessions for a third, a host with an adapter and calendar marks for some; read with their origins."""
    k = F.col("o_orderkey")
    start = F.date_add(F.to_date("o_orderdate"), SHIFT)
    day = lambda n: F.date_add(start, n)
    span = lambda a, b: F.concat(_text(day(a)), F.lit(" to "), _text(day(b)))
    iso = lambda n: F.date_format(day(n), "yyyy-MM-dd")
    price = (k % 300 + 50).cast("string")
    town = F.concat(F.lit("Town "), F.col("o_custkey").cast("string"))
    data = F.to_json(F.struct(F.array(F.struct(F.lit("Course").alias("@type"), F.col("o_clerk").alias("name"), iso(1).alias("startDate"), iso(9).alias("endDate"), F.struct(F.concat(F.lit("Hall "), town).alias("name")).alias("location"))).alias("@graph")))
    script = F.when(k % 3 == 0, F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))).otherwise("")
    marks = F.when(k % 5 == 0, F.concat(F.lit('<abbr class="tribe-events-start-date" title="'), iso(2), F.lit('">x</abbr><abbr class="dtend" title="'), iso(7), F.lit('T10:00">y</abbr><div class="tribe-venue">Mark , '), town, F.lit('</div><div class="tribe-events-event-url"><a href="https://apply.example/'), k.cast("string"), F.lit('">go</a></div>'))).otherwise("")
    runs = F.when(k % 3 == 1, F.concat(F.lit("Session 1: "), span(0, 6), F.lit(". Session 2: "), span(20, 29), F.lit(". "))).otherwise(F.concat(F.lit("It runs from "), span(0, 9), F.lit(". ")))
    money = F.when(k % 2 == 0, F.concat(F.lit("Students pay EUR "), price, F.lit(" each. All of it goes to the teachers, who come from far away. Hotel rooms for students cost EUR 30. "))).otherwise(F.concat(F.lit("Course fees: EUR 900 professionals, EUR "), price, F.lit(" academics. ")))
    html = F.concat(
        F.lit("<html><head>"), script, F.lit("<title>Site</title></head><body><h1>Summer school "), "o_clerk", F.lit("</h1>"), marks, F.lit("<p>Dates. "), _short(day(-30)), F.lit(": application deadline. Abstract deadline: "), _text(day(-80)), F.lit(". "),
        runs, money, F.lit("</p><dl><dt>Location:</dt><dd>"), town, F.lit("</dd><dt>Language</dt><dd>English</dd></dl><p>For PhD students of AI in many fields.</p></body></html>"),
    )
    url = F.concat(F.when(k % 7 == 0, "http://www.special.example/").otherwise("http://o.example/"), k.cast("string"))
    pages = _spread(spark, sf_dir).select(k.alias("page_id"), url.alias("url"), html.alias("html"), F.lit("Europe").alias("region"))
    special = lambda p: {"title": F.concat(F.lit("Special school "), F.split_part(F.get(p["headings"], F.lit(0)), F.lit("#"), F.lit(2))), "deadline": F.lit("2030-01-01")}
    got = pagerecords.page_candidates(pages, ["AI", "graph"], {"EUR": 1.0}, F.lit(LATER).cast("date"), adapters={"special.example": special})
    origin = F.array_join(F.array_sort(F.transform(F.map_entries("origins"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return got.select(
        "page_id", "application_link", "title", "location", "start_date", "end_date", "duration_days", F.coalesce(F.size("sessions"), F.lit(0)).alias("n_sessions"), "deadline", "deadline_status", "deadline_evidence", "fee", "fee_eur", "mode", "extraction_confidence", origin.alias("origins"),
    )


_ADJ = f"o_orderdate::DATE + {SHIFT}"
QUERIES = {
    "structured_events": (
        structured_events,
        """WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'd': l_shipdate::DATE, 'q': l_quantity::INT} ORDER BY l_linenumber, l_shipdate, l_quantity) AS s FROM lineitem GROUP BY 1),
        t AS (SELECT l_orderkey, list_filter(s, lambda x: x.q BETWEEN 0 AND 60) AS s FROM l)
        SELECT o_orderkey AS page_id, 0 AS ord, o_orderdate::DATE AS start_date, o_orderdate::DATE AS end_date, o_clerk AS name, o_orderpriority || ', City ' || o_custkey || ', SE' AS location,
          CASE WHEN len(s) >= 2 THEN list_aggregate(list_transform(s, lambda x: 'Line ' || x.n || ' ' || strftime(x.d, '%Y-%m-%d') || ' ' || strftime(x.d + x.q, '%Y-%m-%d')), 'string_agg', '; ') ELSE '' END AS sessions
        FROM (SELECT *, 'Clerk#' || o_custkey AS o_clerk FROM orders) JOIN t ON o_orderkey = l_orderkey""",
    ),
    "nested_values": (
        nested_values,
        """WITH l AS (SELECT l_orderkey, string_agg('line: ' || l_linenumber || '; mode: ' || 'S' || l_suppkey || '; n: ' || l_quantity::INT || '; flags: ' || l_returnflag || '; ' || l_linestatus, '; ' ORDER BY l_linenumber, 'S' || l_suppkey, l_quantity::INT, l_returnflag, l_linestatus) AS t FROM lineitem GROUP BY 1)
        SELECT o_orderkey, 'clerk: ' || o_clerk || CASE WHEN o_custkey <> 0 OR o_orderkey % 2 = 0 THEN '; who: ' || concat_ws('; ', CASE WHEN o_custkey <> 0 THEN 'customer: id: ' || o_custkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'even: True' END) ELSE '' END || '; lines: ' || t AS text
        FROM (SELECT *, 'Clerk#' || o_custkey AS o_clerk FROM orders) JOIN l ON o_orderkey = l_orderkey""",
    ),
    "page_deadlines": (
        page_deadlines,
        f"""WITH a AS (SELECT *, {_ADJ} AS s, 'Clerk#' || o_custkey AS o_clerk FROM orders),
        r AS (SELECT o_orderkey, s, unnest([0, 0, 1, 2, 1, 1, 2]) AS c, unnest([40, 60, 20, 70, 50, -1, 10]) AS n, unnest([true, o_orderpriority < '3', true, true, true, false, o_orderstatus = 'O']) AS there, o_clerk FROM a),
        f AS (SELECT o_orderkey, s - n AS day, c, n FROM r WHERE there),
        -- 29 February is no date in the years that the text leaves out, where the event's own is no leap year
        g AS (SELECT f.* FROM f JOIN a USING (o_orderkey) WHERE n = 70 OR NOT (strftime(day, '%m-%d') = '02-29' AND year(day) <> year(a.s))),
        x AS (SELECT o_orderkey, string_agg(strftime(day, '%Y-%m-%d') || ' ' || c, '; ' ORDER BY day) AS found, max(day) FILTER (c = 0) AS d0, max(day) FILTER (c = 1) AS d1, max(day) AS d2, list(day ORDER BY day) AS days FROM g GROUP BY 1),
        y AS (SELECT x.*, coalesce(d0, d1, d2) AS deadline, list_filter(days, lambda v: v <> coalesce(d0, d1, d2)) AS others FROM x)
        SELECT o_orderkey, found, deadline, CASE WHEN d0 = a.s - 40 THEN strftime(deadline, '%B %-d') || ': application deadline' WHEN d0 IS NOT NULL THEN 'Application deadline: ' || strftime(deadline, '%B %-d')
            ELSE 'Registration until ' || strftime(deadline, '%-d %b') END
          || CASE WHEN len(others) > 0 THEN ' (other dates listed: ' || list_aggregate(list_transform(others[:3], lambda v: strftime(v, '%Y-%m-%d')), 'string_agg', ', ') || ')' ELSE '' END AS evidence
        FROM y JOIN a USING (o_orderkey)""",
    ),
    "page_places": (
        page_places,
        """WITH a AS (SELECT s_suppkey AS k, s_name, 'Town ' || s_suppkey AS town, list_aggregate(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS land FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        b AS (SELECT *, CASE WHEN k % 4 = 0 THEN CASE WHEN len(town) >= 8 THEN town ELSE town || ' , ' || land || ' , ' || upper(town) END WHEN k % 3 = 1 THEN town || ', ' || land WHEN k % 4 = 1 THEN town ELSE '' END AS v FROM a)
        SELECT k AS s_suppkey, CASE WHEN k % 3 = 0 THEN 'Winter school ' || s_name ELSE 'The 4th school of ' || s_name END AS title,
          CASE WHEN v = '' THEN 'Europe' WHEN k % 4 = 0 AND len(town) < 8 THEN town || ', ' || land ELSE v END AS place, v <> '' AS specific FROM b""",
    ),
    "page_status": (
        page_status,
        f"""WITH s(said, w) AS (VALUES ('We are no longer accepting applications.', 'closed'), ('The application period is over.', 'closed'), ('The abstract deadline has passed. Apply now!', ''), ('Applications are closed.', 'closed'),
          ('Applications are closed for talks. Apply online!', ''), ('Early registration is closed.', 'closed'), ('Registration is closed.', 'closed'), ('Applications will open in May.', 'not_open'), ('Registration is not yet open.', 'not_open'), ('The deadline has passed.', ''), ('', ''))
        SELECT o_orderkey, said, CASE WHEN w <> '' THEN w WHEN o_orderstatus = 'P' THEN 'uncertain' WHEN {_ADJ} >= DATE '{LATER}' THEN 'open' ELSE 'closed' END AS status FROM orders, s""",
    ),
    "whole_page_records": (
        whole_page_records,
        f"""WITH a AS (SELECT *, o_orderkey AS k, {_ADJ} AS s, 'Town ' || o_custkey AS town, 'Clerk#' || o_custkey AS o_clerk FROM orders),
        b AS (SELECT *, CASE WHEN k % 5 = 0 THEN s + 2 WHEN k % 3 = 0 THEN s + 1 ELSE s END AS st, CASE WHEN k % 5 = 0 THEN s + 7 WHEN k % 3 = 0 THEN s + 9 WHEN k % 3 = 1 THEN s + 29 ELSE s + 9 END AS en,
          CASE WHEN k % 5 = 0 THEN 'events calendar' WHEN k % 3 = 0 THEN 'structured data' ELSE 'text' END AS o1 FROM a),
        -- a date without a year gets that of the start, or the year before; on 29 February only where that is its own
        c AS (SELECT *, s - 30 AS d, NOT (strftime(s - 30, '%m-%d') = '02-29' AND year(s - 30) <> year(st)) AS dated FROM b),
        e AS (SELECT *, CASE WHEN k % 7 = 0 THEN DATE '2030-01-01' WHEN dated THEN d ELSE s - 80 END AS due FROM c)
        SELECT k AS page_id, CASE WHEN k % 5 = 0 THEN 'https://apply.example/' || k WHEN k % 7 = 0 THEN 'http://www.special.example/' || k ELSE 'http://o.example/' || k END AS application_link,
          CASE WHEN k % 7 = 0 THEN 'Special school ' || split_part(o_clerk, '#', 2) ELSE 'Summer school ' || o_clerk END AS title, CASE WHEN k % 5 = 0 THEN 'Mark, ' || town WHEN k % 3 = 0 THEN 'Hall ' || town ELSE town END AS location,
          st AS start_date, en AS end_date, CASE WHEN k % 3 = 1 THEN 10 ELSE (en - st + 1)::INT END AS duration_days, CASE WHEN k % 3 = 1 THEN 2 ELSE 0 END AS n_sessions, due AS deadline, CASE WHEN due >= DATE '{LATER}' THEN 'open' ELSE 'closed' END AS deadline_status,
          CASE WHEN k % 7 = 0 THEN '' WHEN dated THEN strftime(d, '%B %-d') || ': application deadline (other dates listed: ' || strftime(s - 80, '%Y-%m-%d') || ')' ELSE 'Abstract deadline: ' || strftime(s - 80, '%-d %B %Y') END AS deadline_evidence,
          'EUR ' || (k % 300 + 50) AS fee, (k % 300 + 50)::DOUBLE AS fee_eur, 'in-person' AS mode, 1.0::DOUBLE AS extraction_confidence,
          'deadline=' || CASE WHEN k % 7 = 0 THEN 'special.example' ELSE 'text' END || ',end=' || o1 || ',fee=text,place=' || o1 || ',start=' || o1 || ',title=' || CASE WHEN k % 7 = 0 THEN 'special.example' ELSE 'text' END AS origins FROM e""",
    ),
}

"""Queries that read records out of catalogues, structured data, pages and model replies made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutflow.operators import enrich, evidence, filters, pagerecords, semantic, sessions
from scoutflow.plans.candidates import LATER, pick, spread, table
from scoutflow.sinks import writers
from scoutflow.sources import readers

TOPICS = ["AI", "graph"]


def _written(day):
    return F.date_format(day, "d MMMM yyyy")


def upcoming_editions(spark, sf_dir):
    """Customers as products and their orders as planned editions, read from JSON; cancelled ones and those before 1996 do not count."""
    o = table(spark, sf_dir, "orders")
    stamp = lambda d: F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T09:00:00"))
    edition = F.struct(
        stamp(F.col("o_orderdate")).alias("executionstartdate"), stamp(F.date_add("o_orderdate", 4)).alias("executionenddate"), F.when(F.col("o_orderkey") % 2 == 0, stamp(F.date_add("o_orderdate", -30))).alias("applicationenddate"),
        F.col("o_totalprice").cast("double").alias("price"), F.when(F.col("o_orderkey") % 3 != 1, F.col("o_orderkey") % 3 == 0).alias("cancelled"),
    )
    product = o.groupBy("o_custkey").agg(F.collect_list(edition).alias("plannedproducts")).select(F.col("o_custkey").cast("string").alias("id"), F.lit("p").alias("name"), "plannedproducts")
    body = product.select(F.to_json(F.struct(F.array(F.struct("id", "name", "plannedproducts")).alias("products"))).alias("body"))
    return readers.catalogue_editions(body, F.lit("1996-01-01").cast("date")).select("identity_key", "start_date", F.datediff("end_date", "start_date").alias("days"))


def course_records(spark, sf_dir):
    """Parts as courses of two instances, one of them always too short."""
    day = F.date_add(F.lit("2026-09-01").cast("date"), F.col("p_size"))
    text = lambda d: F.date_format(d, "yyyy-MM-dd")
    k = F.col("p_partkey")
    modes = F.when(k % 4 == 0, F.array(F.lit("Online"), F.lit("Onsite"))).when(k % 4 == 1, F.array(F.lit("online"))).when(k % 4 == 2, F.array(F.lit("onsite")))
    offers = F.when(k % 3 == 0, F.array(F.struct(F.lit("industry").alias("name"), F.lit(9.0).alias("price")), F.struct(F.lit("Academic rate").alias("name"), F.lit(3.0).alias("price")))).when(k % 3 == 1, F.array(F.struct(F.lit("all").alias("name"), F.lit(7.0).alias("price"))))
    one = lambda name, end, url: F.struct(name.alias("name"), text(day).alias("startDate"), text(end).alias("endDate"), url.alias("url"), modes.alias("courseMode"), offers.alias("offers"))
    long = one(F.when(k % 2 == 0, F.col("p_brand")), F.date_add(day, (k % 12).cast("int")), F.concat(F.lit("u"), k.cast("string")))
    body = F.to_json(F.struct(F.when(k % 10 == 0, "Event").otherwise("Course").alias("@type"), F.col("p_name").alias("name"), F.array(long, one(F.lit("short"), F.date_add(day, 1), F.lit("v"))).alias("hasCourseInstance")))
    return readers.course_instances(table(spark, sf_dir, "part").select(body.alias("body"))).select("identity_key", "name", "url", "start_date", "end_date", "duration_days", "mode", "price")


def session_spans(spark, sf_dir):
    """Suppliers' programmes of two sessions and a third that is cancelled; every fifth has one only."""
    k = F.col("s_suppkey")
    first = F.date_add(F.lit("2027-07-01").cast("date"), (k % 9).cast("int"))
    last = lambda d: F.date_add(d, (k % 7 + 4).cast("int"))
    span = lambda d: F.concat(_written(d), F.lit(" to "), _written(last(d)))
    second = F.date_add(first, 31)
    text = F.concat(F.lit("Session one: "), span(first), F.lit(", deadline "), _written(F.date_add(first, -60)), F.lit(". "), F.when(k % 5 != 0, F.concat(F.lit("Session II: "), span(second), F.lit(". "))).otherwise(""), F.lit("Session 3: 1 October 2027 to 5 October 2027 (cancelled)"))
    found = table(spark, sf_dir, "supplier").select(k, sessions.programme_sessions(text).alias("s"))
    p = sessions.programme_span(F.col("s"))
    names = F.array_join(F.transform("s", lambda s: F.concat_ws(" due ", s["name"], s["deadline"].cast("string"))), "; ")
    return found.select(k, names.alias("names"), p["start_date"].alias("start_date"), p["end_date"].alias("end_date"), p["duration_days"].alias("days"), p["reference_start"].alias("latest_start"))


def page_records(spark, sf_dir):
    """Orders as pages of a school, a quarter without an application and a fifth of workshops, read as candidates."""
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 14600)
    words = F.concat(
        F.when(k % 4 == 0, "Hello. ").otherwise(F.concat(F.lit("Application deadline: "), _written(day), F.lit(". "))), F.lit("It runs from "), _written(F.date_add(day, 30)), F.lit(" to "), _written(F.date_add(day, 39)), F.lit(". Tuition fee: "),
        F.when(k % 2 == 0, "EUR ").otherwise("USD "), (k % 300 * 2 + 50).cast("string"), F.lit(". "), F.when(k % 3 == 0, "It is an online course. ").otherwise("The venue is in town. "), pick(k, ["For PhD students of AI.", "Master level, graph theory.", "For all."]),
    )
    html = F.concat(F.lit("<html><head><title>"), F.when(k % 5 == 0, "Workshop ").otherwise("Site "), k.cast("string"), F.lit("</title></head><body><h1>"), F.when(k % 5 == 0, "Workshop on data ").otherwise("Data summer school "), k.cast("string"), F.lit(" | Site</h1><p>"), words, F.lit("</p></body></html>"))
    pages = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").select(k.alias("page_id"), F.concat(F.lit("http://o.example/"), k.cast("string")).alias("url"), html.alias("html"))
    got = pagerecords.page_candidates(pages, TOPICS, {"EUR": 1.0, "USD": 0.5}, F.lit(LATER).cast("date"))
    return got.select("page_id", "source_url", "title", "type", "start_date", "end_date", "duration_days", "deadline", "deadline_status", "fee", "fee_eur", "mode", "target_level", F.array_join("topic_keywords", ",").alias("topics"), "extraction_confidence")


def missed_items(spark, sf_dir):
    """The best line of each order that no candidate has, and what would be searched for it."""
    url = lambda x: F.concat(F.lit("http://o/"), x.cast("string"))
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")  # noqa: E741
    line, none = F.col("l_linenumber"), F.array().cast("array<string>")
    items = l.select(url(F.col("l_orderkey")).alias("page_url"), F.struct(line, "l_partkey").alias("ord"), (F.col("l_orderkey") * 10000000 + line * 1000000 + F.col("l_partkey")).alias("id"), F.when(line == 2, "high").when(line == 1, "medium").otherwise("low").alias("confidence"), F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("event_past"))).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("x"))).otherwise(none).alias("warnings"), F.col("l_quantity").cast("double").alias("score"))
    k = F.col("o_orderkey")
    known = o.filter(k % 3 != 2).select(F.when(k % 3 == 0, url(k)).otherwise("").alias("source_url"), F.when(k % 3 == 1, url(k)).otherwise("").alias("application_link"))
    gap = F.struct(F.lit("unknown").alias("application_deadline"), F.lit("1").alias("start_date"), F.lit("2").alias("end_date"), F.lit(" ").alias("fee"), F.when(F.col("id") % 2 == 0, "Lund").alias("location"))
    missing = enrich.missing_fields(gap)
    return enrich.unmatched_items(items, known).select("page_url", F.col("id").alias("ord"), enrich.wants_follow_up(F.col("warnings"), F.lit("T"), F.when(F.col("id") % 5 == 0, "closed"), missing).alias("follow"), F.array_join(enrich.refinement_queries(F.lit(" A  b "), F.lit("o.org"), missing), "; ").alias("queries"))


def model_replies(spark, sf_dir):
    """Replies that are JSON, fenced, after thinking, inside prose, cut off, or empty."""
    k = F.col("p_partkey")
    obj = F.to_json(F.struct(F.col("p_name").alias("title"), F.struct(F.col("p_size").alias("value")).alias("fee")))
    reply = F.element_at(F.array(obj, F.concat(F.lit("Sure:\n```json\n"), obj, F.lit("\n```")), F.concat(F.lit("<think>{no}</think> "), obj), F.concat(F.lit("Here "), obj, F.lit(" there")), F.substring(obj, 1, 9), F.lit("")), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(k, evidence.model_json(reply).alias("v"))
    return rows.select(k, evidence.field(F.col("v"), "title").alias("title"), evidence.field(F.col("v"), "fee.value", "").alias("fee"))


def ranked_chunks(spark, sf_dir):
    """Parts as pages of one chunk, useful ones likened to a query by an injected model."""
    k = F.col("p_partkey")
    text = F.concat(pick(k, ["The summer school: apply now. ", "Nothing here. ", "A field school with a fee. "]), "p_name")
    pages = table(spark, sf_dir, "part").select(F.concat(F.lit("http://p/"), k.cast("string")).alias("url"), F.lit("T").alias("title"), text.alias("text"))
    model = lambda c: F.array((F.length(c) % 5).cast("double"), F.lit(3.0))
    return semantic.rank_pages(pages, [1.0, 0.0], model).select("url", "chunk_index", "chunk", "score", "rank")


def discovery_repeats(spark, sf_dir):
    """Customers as search results that share twenty addresses: the first accepted row of each stays."""
    k = F.col("c_custkey")
    title = F.when(k % 4 == 0, "Archive 2027").when(k % 7 == 0, "Summer school 2019").otherwise("Summer school 2027")
    results = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(k.alias("ord"), title.alias("title"), F.lit("official").alias("snippet"), F.concat(F.lit("http://uni"), (k % 20).cast("string"), F.lit(".edu/x")).alias("url"))
    return filters.filter_discovery(results, 2026).select("ord", "reason")


def calendar_entries(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    return rows.select(k, writers.calendar_event(F.concat("o_orderpriority", F.lit("; a, b")), F.to_date("o_orderdate"), F.concat(F.lit("http://o/"), k.cast("string"))).alias("ics"), writers.xml_escape(F.concat(F.lit("<a & \""), "o_orderpriority", F.lit("\">"))).alias("xml"))


QUERIES = {
    "upcoming_editions": (
        upcoming_editions,
        "SELECT 'catalogue:' || o_custkey AS identity_key, min(o_orderdate::DATE) AS start_date, 4 AS days FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate::DATE >= DATE '1996-01-01' GROUP BY o_custkey",
    ),
    "course_records": (
        course_records,
        """WITH a AS (SELECT p_partkey AS k, p_name, p_brand, DATE '2026-09-01' + p_size::INT AS d FROM part WHERE p_partkey % 10 <> 0)
        SELECT 'course:' || sha256(p_name || '|u' || k || '|' || strftime(d, '%Y-%m-%d')) AS identity_key, CASE WHEN k % 2 = 0 THEN p_brand ELSE p_name END AS name, 'u' || k AS url, d AS start_date, d + (k % 12)::INT AS end_date, (k % 12 + 1)::INT AS duration_days,
          ['hybrid', 'online', 'in-person', 'uncertain'][k % 4 + 1] AS mode, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 7.0 END::DOUBLE AS price FROM a WHERE k % 12 >= 4""",
    ),
    "session_spans": (
        session_spans,
        """WITH a AS (SELECT s_suppkey AS k, DATE '2027-07-01' + (s_suppkey % 9)::INT AS d, (s_suppkey % 7 + 4)::INT AS n FROM supplier)
        SELECT k AS s_suppkey, CASE WHEN k % 5 <> 0 THEN 'Session 1 due ' || strftime(d - 60, '%Y-%m-%d') || '; Session 2' ELSE '' END AS names, CASE WHEN k % 5 <> 0 THEN d END AS start_date, CASE WHEN k % 5 <> 0 THEN d + 31 + n END AS end_date,
          CASE WHEN k % 5 <> 0 THEN n + 1 END AS days, CASE WHEN k % 5 <> 0 THEN d + 31 END AS latest_start FROM a""",
    ),
    "page_records": (
        page_records,
        f"""WITH a AS (SELECT o_orderkey AS k, o_orderdate::DATE + 14600 AS d, k % 300 * 2 + 50 AS n FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0)
        SELECT k AS page_id, 'http://o.example/' || k AS source_url, 'Data summer school ' || k AS title, 'summer school' AS type, d + 30 AS start_date, d + 39 AS end_date, 10 AS duration_days, d AS deadline, CASE WHEN d >= DATE '{LATER}' THEN 'open' ELSE 'closed' END AS deadline_status,
          CASE WHEN k % 2 = 0 THEN 'EUR ' ELSE 'USD ' END || n AS fee, CASE WHEN k % 2 = 0 THEN n ELSE n / 2 END::DOUBLE AS fee_eur, CASE WHEN k % 3 = 0 THEN 'online' ELSE 'in-person' END AS mode, ['PhD', 'MSc', 'uncertain'][k % 3 + 1] AS target_level, ['AI', 'graph', ''][k % 3 + 1] AS topics, 1.0::DOUBLE AS extraction_confidence FROM a""",
    ),
    "missed_items": (
        missed_items,
        """WITH a AS (SELECT l_orderkey * 10000000 + l_linenumber * 1000000 + l_partkey AS ord, l_orderkey, l_partkey % 3 AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_linenumber WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END DESC, CASE WHEN l_partkey % 3 = 2 THEN 0 ELSE 1 END, l_quantity DESC, l_linenumber, l_partkey) AS r FROM lineitem WHERE l_orderkey % 3 = 2)
        SELECT 'http://o/' || l_orderkey AS page_url, ord, ord % 5 <> 0 AS follow, 'A b application deadline site:o.org; A b fee site:o.org' || CASE WHEN ord % 2 = 0 THEN '' ELSE '; A b location site:o.org' END AS queries FROM a WHERE r = 1 AND w <> 0""",
    ),
    "model_replies": (
        model_replies,
        "SELECT p_partkey, CASE WHEN p_partkey % 6 < 4 THEN p_name ELSE 'unknown' END AS title, CASE WHEN p_partkey % 6 < 4 THEN p_size::VARCHAR ELSE '' END AS fee FROM part",
    ),
    "ranked_chunks": (
        ranked_chunks,
        """WITH a AS (SELECT p_partkey AS k, ['The summer school: apply now. ', '', 'A field school with a fee. '][p_partkey % 3 + 1] || p_name AS t FROM part WHERE p_partkey % 3 <> 1), b AS (SELECT *, length(t) % 5 AS n FROM a)
        SELECT 'http://p/' || k AS url, 0 AS chunk_index, t AS chunk, round(n / sqrt(n * n + 9.0), 6) AS score, 1 AS rank FROM b WHERE n > 0""",
    ),
    "discovery_repeats": (
        discovery_repeats,
        """WITH a AS (SELECT c_custkey AS k, c_custkey % 20 AS u, CASE WHEN c_custkey % 4 = 0 THEN 'missing_programme_signal' WHEN c_custkey % 7 = 0 THEN 'past_year' ELSE '' END AS r FROM customer)
        SELECT k AS ord, CASE WHEN r = '' AND k > min(k) FILTER (r = '') OVER (PARTITION BY u) THEN 'duplicate_url' ELSE r END AS reason FROM a""",
    ),
    "calendar_entries": (
        calendar_entries,
        r"""SELECT o_orderkey, replace('BEGIN:VCALENDAR~VERSION:2.0~BEGIN:VEVENT~UID:' || sha1('http://o/' || o_orderkey) || '~DTSTART;VALUE=DATE:' || strftime(o_orderdate::DATE, '%Y%m%d') || '~DTEND;VALUE=DATE:' || strftime(o_orderdate::DATE + 1, '%Y%m%d') || '~SUMMARY:' || o_orderpriority || '\; a\, b~END:VEVENT~END:VCALENDAR~', '~', chr(13) || chr(10)) AS ics,
          '&lt;a &amp; &quot;' || o_orderpriority || '&quot;&gt;' AS xml FROM orders""",
    ),
}

"""Queries over catalogues with pages behind them and over recorded model replies, made of the driver tables' own values."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutflow.operators import catalogues, fees, filters, replies, validation
from scoutflow.plans.candidates import LATER, table
from scoutflow.plans.pagefacts import SHIFT

ROOT = "https://cat.example"


def _text(day):
    return F.date_format(day, "d MMMM yyyy")


def catalogue_events(spark, sf_dir):
    """Customers' listings with their orders as cards; behind a card a detail page, a registration page and an event's own site, read from a table of stored pages."""
    o = table(spark, sf_dir, "orders")
    k, key, start = F.col("o_orderkey"), F.col("o_orderkey").cast("string"), F.date_add(F.to_date("o_orderdate"), SHIFT)
    short = lambda d: F.date_format(d, "dd/MM/yy")
    link = lambda href, label: F.concat(F.lit('<a href="'), href, F.lit('">'), label, F.lit("</a>"))
    here = F.concat(F.lit("/events/"), key)
    card = F.concat(F.lit('<div class="x grid border-b"><div>'), link(here, F.lit("")), link(here, F.lit("AI")), F.lit("</div>"), link(here, F.concat(F.lit("School "), "o_orderpriority", F.lit(" "), key)), F.lit(" "), short(start), F.lit(" - "), short(F.date_add(start, 5)), F.lit("</div>"))
    listing = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"), F.max(card).alias("again"))
    pages = listing.select(F.concat(F.lit(f"{ROOT}/list/"), F.col("o_custkey").cast("string")).alias("page_url"), F.concat(F.lit('<div class="grid">No card 01/01/40 - 02/01/40</div>'), "cards", "again").alias("html"))
    own = F.concat(F.lit("http://own.example/"), key)
    desk = F.concat(F.lit(f"{ROOT}/registration/"), key)
    detail = F.concat(F.lit("<p>Details.</p>"), link(F.lit("https://x.com/us"), F.lit("News")), F.when(k % 2 == 0, link(desk, F.lit("Here"))).otherwise(""), F.when(k % 3 == 0, link(own, F.lit("Site"))).otherwise(""))
    site = F.concat(F.lit("<p>Early Bird 100 EUR 200 EUR Regular "), F.col("o_totalprice").cast("int").cast("string"), F.lit(" EUR 900 EUR</p>"), link(F.concat(own, F.lit("/go")), F.lit("Register")))
    stored = o.select(F.inline(F.array(
        F.struct(F.concat(F.lit(ROOT), here).alias("url"), detail.alias("html")), F.struct(desk.alias("url"), F.concat(F.lit("<p>Registration deadline: "), F.date_format(F.date_sub(start, 30), "MMMM d"), F.lit(".</p>")).alias("html")),
        F.struct(own.alias("url"), site.alias("html")), F.struct(F.concat(own, F.lit("/go")).alias("url"), F.concat(F.lit("<p>Registration deadline: "), _text(F.date_sub(start, 20)), F.lit(".</p>")).alias("html")),
    )))
    got = catalogues.catalogue_records(pages, lambda urls: urls.join(stored, "url", "left"), ["grid", "border-b"], "/events/", ["cat.example"], F.lit(LATER).cast("date"))
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "title", "start_date", "end_date", "deadline", "fee", "fee_eur", "n_pages")


def recorded_replies(spark, sf_dir):
    """Orders as pages whose snippets were sent to a model: replies of a log, some failed, some unreadable; validated against the snippets."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), SHIFT)
    url = F.concat(F.lit("http://o/"), k.cast("string"))
    texts = F.array(F.struct(F.lit("E1").alias("id"), F.concat(F.lit("Application deadline: "), _text(day), F.lit(".")).alias("text")), F.struct(F.lit("E2").alias("id"), F.concat(F.lit("Fee: EUR "), F.col("o_totalprice").cast("int").cast("string"), F.lit(".")).alias("text")))
    snippets = o.filter("o_orderstatus <> 'P'").select(url.alias("page_url"), F.inline(texts))
    wanted = replies.requests(snippets, "m", "1", "Read.")
    claim = lambda value, *ids: F.struct(value.alias("value"), F.array(*map(F.lit, ids)).alias("evidence_ids"))
    due = F.when(F.col("o_orderpriority") < "3", day).otherwise(F.date_add(day, 1))
    said = F.to_json(F.struct(claim(F.date_format(due, "yyyy-MM-dd"), "E1").alias("application_deadline"), claim(F.concat(F.lit("EUR "), F.col("o_totalprice").cast("int").cast("string")), "e2", " ").alias("fee"), F.col("o_orderpriority").alias("title")))
    reply = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).when(F.col("o_orderpriority").startswith("4"), F.lit("Sorry, { no")).otherwise(F.concat(F.lit("```json\n"), said, F.lit("\n```")))
    log = wanted.join(o.withColumn("page_url", url), "page_url").select("request_key", "page_url", reply.alias("reply"), F.when(F.col("o_orderpriority") == "5-LOW", "timed out").alias("error"), F.current_timestamp().alias("asked_at"))
    got = replies.items(wanted, log, o.select(url.alias("page_url")))
    names = ["title", "application_deadline", "fee"]
    rows = got.select("page_url", F.lit("T").alias("page_title"), F.lit("opportunity").alias("page_type"), F.lit("high").alias("confidence"), replies.fields_of(F.col("extraction"), names).alias("fields"), F.col("warnings").alias("before"))
    judged = validation.validate(rows, snippets, F.lit(LATER).cast("date"))
    value = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f))["value"], F.lit(""))
    return judged.select("page_url", value("title").alias("title"), value("application_deadline").alias("deadline"), value("fee").alias("fee"), F.array_join(F.concat("before", "warnings"), ", ").alias("warnings"), "confidence")


def listing_labels(spark, sf_dir):
    """Orders as candidates: what is told of money, how the tier is shown, and which pages are a provider's courses."""
    o = table(spark, sf_dir, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    types = F.when(k % 4 == 0, F.array(F.lit("stipend"), F.lit("travel grant"))).otherwise(F.array().cast("array<string>"))
    evidence = F.when(k % 2 == 0, F.concat(F.lit("A grant of EUR "), price.cast("int").cast("string"), F.lit(" is paid"))).otherwise("Support may be given")
    tier = F.when(F.col("o_orderpriority") < "2", "qualified").when(F.col("o_orderpriority") < "3", "high").otherwise("found")
    page = F.concat(F.lit("An intensive  Course of "), "o_orderpriority", F.when(k % 2 == 0, " with registration").otherwise(""), F.when(k % 7 == 0, ". Course overview").otherwise(""))
    source = F.when(F.col("o_orderstatus") == "O", "research_training_provider").when(F.col("o_orderstatus") == "F", "university")
    money = fees.financial_summary(k % 3 == 0, types, evidence, F.when(k % 5 != 0, price))
    return o.select(k, money.alias("money"), filters.tier_label(tier).alias("label"), filters.provider_course(page, source).alias("course"))


QUERIES = {
    "listing_labels": (
        listing_labels,
        """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'stipend, travel grant' ELSE 'Funding available' END || ' · ' || CASE WHEN o_orderkey % 2 = 0 THEN 'EUR ' || trunc(o_totalprice)::BIGINT ELSE 'amount not stated' END || ' · Apply on official page'
          WHEN o_orderkey % 5 <> 0 THEN 'Fee about EUR ' || round_even(o_totalprice, 0)::BIGINT || ' · Apply on official page' ELSE 'Funding or fee not stated' END AS money,
          CASE left(o_orderpriority, 1) WHEN '1' THEN 'Fully qualified' WHEN '2' THEN 'High quality' ELSE 'Listed' END AS label, o_orderstatus = 'O' AND (o_orderkey % 2 = 0 OR o_orderkey % 7 = 0) AS course FROM orders""",
    ),
    "catalogue_events": (
        catalogue_events,
        f"""WITH a AS (SELECT o_orderkey AS k, o_orderdate::DATE + {SHIFT} AS s, * FROM orders), b AS (SELECT *, s - 30 AS d, NOT (strftime(s - 30, '%m-%d') = '02-29' AND year(s - 30) <> year(s)) AS dated FROM a WHERE s + 5 >= DATE '{LATER}')
        SELECT k AS o_orderkey, 'School ' || o_orderpriority || ' ' || k AS title, s AS start_date, s + 5 AS end_date, CASE WHEN k % 3 = 0 THEN s - 20 WHEN k % 2 = 0 AND dated THEN d END AS deadline,
          CASE WHEN k % 3 <> 0 THEN '' ELSE 'Academia EUR ' || least(100, trunc(o_totalprice)::BIGINT) || '-' || greatest(100, trunc(o_totalprice)::BIGINT) || '; non-academia up to EUR 900' END AS fee,
          CASE WHEN k % 3 = 0 THEN greatest(100, trunc(o_totalprice))::DOUBLE END AS fee_eur, 1 + (k % 2 = 0)::INT + 2 * (k % 3 = 0)::INT AS n_pages FROM b""",
    ),
    "recorded_replies": (
        recorded_replies,
        f"""WITH a AS (SELECT *, o_orderdate::DATE + {SHIFT} AS s, o_orderstatus = 'P' AS none, left(o_orderpriority, 1)::INT AS p, trunc(o_totalprice)::BIGINT AS n FROM orders), b AS (SELECT *, NOT none AND p <= 3 AS said, CASE WHEN p < 3 THEN s ELSE s + 1 END AS due FROM a),
        c AS (SELECT *, concat_ws(', ', CASE WHEN none THEN 'no_evidence_snippets' END, CASE WHEN NOT none AND p = 5 THEN 'llm_unavailable:timed out' END, CASE WHEN NOT none AND p = 4 THEN 'llm_json_parse_failed' END,
          CASE WHEN said THEN 'missing_evidence_id:title' END, CASE WHEN said AND p = 3 THEN 'application_deadline_value_not_in_evidence' END, CASE WHEN said AND due < DATE '{LATER}' THEN 'deadline_past' END) AS w FROM b)
        SELECT 'http://o/' || o_orderkey AS page_url, CASE WHEN said THEN o_orderpriority ELSE '' END AS title, CASE WHEN said THEN strftime(due, '%Y-%m-%d') ELSE '' END AS deadline, CASE WHEN said THEN 'EUR ' || n ELSE '' END AS fee, w AS warnings,
          CASE WHEN said THEN 'medium' ELSE 'high' END AS confidence FROM c""",
    ),
}

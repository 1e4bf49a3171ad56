"""Queries that send the tables through the text, URL, override, extraction and validation operators themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.functions import dates, money, urls
from scoutflow.functions import text as tx
from scoutflow.operators import deadlines, enrich, evidence, extract, fees, filters, semantic, validation

AS_OF, LATER = "1997-01-01", "2036-06-01"
PAGES = ["Join our summer school; the application is open", "PhD position and summer school funding", "Workshop notes", "Language course, deadline soon", "Degree programme with a summer school scholarship", "Winter school only"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores while they are narrow: a file has few row groups, and what follows takes long for each row. The number of parts is stated, or few bytes would be put into few tasks again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def pick(n: Column, options: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (n % len(options) + 1).cast("int"))


def text_forms(spark, sf_dir):
    """Slugs, file names, cuts and escapes of part names."""
    both = F.concat_ws("; ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        "p_partkey", tx.slug(both, 30).alias("slug"), tx.stable_filename(F.col("p_name"), F.col("p_brand")).alias("file"), tx.shorten(both, 25).alias("short"), tx.normalise_name(F.concat_ws("|", F.upper("p_name"), "p_brand")).alias("name"),
        tx.markdown_escape(F.concat(F.lit("*"), "p_brand", F.lit("*"))).alias("markdown"), tx.ics_escape(both).alias("ics"), tx.first_term(both, ["steel", "brass", "tin"], "none").alias("metal"), tx.first_match(both, [r"(?i)large (\w+)", r"(?i)small \w+"]).alias("after"),
        tx.evidence_window(both, r"(?i)\b(brushed|polished)\b", 8).alias("window"),
    )


def opportunity_terms(spark, sf_dir):
    """What the predicates and the link score say of six kinds of page."""
    text = pick(F.col("p_partkey"), PAGES)
    return table(spark, sf_dir, "part").select(
        "p_partkey", filters.looks_like_opportunity(text).alias("looks"), filters.excluded_programme(text).alias("excluded"), filters.workshop_title(text).alias("workshop"),
        filters.link_score(text).alias("score"), filters.link_score(F.concat(text, F.lit(" on statistics")), F.col("p_size") > 25).alias("provider_score"),
    )


def useful_chunks(spark, sf_dir):
    """The operator's own rule on six kinds of chunk, four of them with filler around."""
    text = F.concat_ws(" ", pick(F.col("p_partkey"), PAGES), F.when(F.col("p_size") % 3 == 0, "Privacy policy, newsletter, follow us").otherwise("Bring a laptop"))
    title = F.when(F.col("p_size") % 5 == 0, "Archive").otherwise("School")
    return table(spark, sf_dir, "part").select("p_partkey", semantic.useful_chunk(text, title, F.lit("http://a/b")).alias("useful"))


def follow_links(spark, sf_dir):
    """Of each page's links to its host's forms, files, elsewhere and nowhere, those that may answer what is missing."""
    origin = F.concat(F.lit("https://"), urls.host(F.col("url")))
    links = [(F.concat(origin, F.lit("/apply/"), F.col("page_id").cast("string")), "Apply now"), (F.concat(origin, F.lit("/fees.pdf")), "Fees"), (F.lit("https://facebook.com/x"), "Apply"), (F.concat(origin, F.lit("/about#top")), "About us"), (F.concat(origin, F.lit("/money")), "Costs")]
    made = F.array(*[F.struct(h.alias("href"), F.lit(t).alias("label")) for h, t in links])
    rows = table(spark, sf_dir, "pages").select(F.concat("url", F.lit("~"), F.col("page_id").cast("string")).alias("url"), made.alias("links"), F.array(F.lit("fee")).alias("missing"))
    return enrich.follow_up_links(rows).select("url", "href", F.col("score").cast("int").alias("score"), "rank")


def override_apply(spark, sf_dir):
    """Hand-made entries by URL, by title and by part of it: one leaves out, the others note and set."""
    over = spark.createDataFrame(
        [(1, "http://shop.example/c/7/?utm_source=x", "", "", "", "by url", {"fee_eur": "7"}), (2, "", "Customer#000000009", "", "", "by title", {"fee_eur": None}), (3, "", "", "0001", "", "by part", {"fee_eur": "1"}), (4, "", "customer#000000005", "", "exclude", "", None)], enrich.OVERRIDE
    )
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://www.shop.example/c/"), F.col("c_custkey").cast("string")).alias("source_url"), F.col("c_name").alias("title"), F.lit("r").alias("risk_points"), F.col("c_acctbal").cast("double").alias("fee_eur"))
    # The first entry's scheme is http: its key differs from https ones, and matches none of them.
    return enrich.apply_overrides(rows, over)


def model_facts(spark, sf_dir):
    """Orders as candidates and their first lines as a model's items: what is unknown is taken from the best item of the page."""
    url = lambda k: F.concat(F.lit("http://o/"), k.cast("string"))
    k = F.col("o_orderkey")
    cands = table(spark, sf_dir, "orders").select(
        url(k).alias("source_url"), F.lit("").alias("application_link"), F.when(k % 2 == 0, "Europe").otherwise("Lund").alias("location"), F.when(k % 3 == 0, "uncertain").otherwise("online").alias("mode"),
        F.to_date("o_orderdate").alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("int").alias("duration_days"), F.lit(None).cast("date").alias("deadline"), F.lit("uncertain").alias("deadline_status"),
    )
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    items = l.select(
        url(F.col("l_orderkey")).alias("page_url"), (F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000).cast("int").alias("ord"), F.when(F.col("l_linenumber") == 2, "high").otherwise("low").alias("confidence"), F.array().cast("array<string>").alias("warnings"), F.col("l_quantity").cast("double").alias("score"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("location"), F.lit("hybrid").alias("mode"), F.lit(None).cast("date").alias("start_date"), F.to_date("l_shipdate").alias("end_date"), F.date_add(F.to_date("l_shipdate"), 5).alias("deadline"), F.lit("open").alias("status"),
    )
    return enrich.enrich_unresolved(cands, items, as_of()).select("source_url", "location", "mode", "end_date", "duration_days", "deadline", "deadline_status")


def _notices(spark, sf_dir) -> DataFrame:
    """Orders as notices in prose, with dates, fees, places and funding that follow from the key."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 14600)
    cents = F.floor(F.col("o_totalprice")).cast("long")
    place = F.when(k % 3 == 0, F.concat(F.lit("Venue: Port of "), F.initcap("n_name"), F.lit(", Contact the office. "))).when(k % 3 == 1, F.concat(F.lit("The school will take place in Port of "), F.initcap("n_name"), F.lit(", from Monday. "))).otherwise("Location: virtual room. ")
    due = F.concat(F.lit("Application deadline: "), F.date_format(day, "d MMMM yyyy"), F.lit(". "))
    fee = F.when(k % 4 == 0, "Attendance is free of charge. ").otherwise(F.concat(F.lit("Tuition fee: EUR "), cents.cast("string"), F.lit(". Students pay 150 EUR and doctoral candidates 95 EUR. ")))
    money_ = pick(k, ["Fellowships are available. ", "No scholarships. ", "Travel costs are covered. ", "Meals are included and stipends paid. ", ""])
    span = F.concat(F.lit("It runs from "), F.date_format(F.date_add(day, 30), "d MMMM yyyy"), F.lit(" to "), F.date_format(F.date_add(day, 39), "d MMMM yyyy"), F.lit(". "))
    named = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select("o_orderkey", "o_orderdate", "o_totalprice", "n_name")
    return tx.staged(spread(named, "o_orderkey"), text=F.concat(place, due, fee, money_, span)).select("o_orderkey", "text")


def notice_facts(spark, sf_dir):
    """Place, deadline, dates, fee and funding read back from notices."""
    t = F.col("text")
    # What several columns, or several steps of one, are made of is read once a notice.
    rows = tx.staged(_notices(spark, sf_dir), due=deadlines.deadlines(t), range=F.get(extract.date_ranges(t), F.lit(0)), fee=F.coalesce(fees.stated_fee(t), F.lit("")), student=fees.participant_fee(t))
    fee = F.col("fee")
    return rows.select(
        "o_orderkey", validation.place_of(t, F.lit("Continental Europe")).alias("place"), deadlines.chosen_deadline(F.col("due"))["day"].alias("deadline"), F.col("range.start").alias("start_date"), F.col("range.end").alias("end_date"),
        money.fee_to_eur(fee, F.lit(1.0)).alias("fee_eur"), money.currency(fee).alias("currency"), F.array_max(money.amounts(F.col("student"))).alias("student_fee"), F.array_join(extract.funding_types(t), ", ").alias("funding"),
    )


def _claims(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    k, day = F.col("o_orderkey"), F.date_add(F.to_date("o_orderdate"), 14600)
    iso = F.date_format(day, "yyyy-MM-dd")
    url = F.concat(F.lit("http://o/"), k.cast("string")).alias("page_url")
    entry = lambda value, *ids: F.struct(F.lit(value).alias("value") if isinstance(value, str) else value.alias("value"), F.array(*[F.lit(i) for i in ids]).cast("array<string>").alias("ids"))
    fields = F.create_map(
        F.lit("title"), F.when(k % 2 == 0, entry("A school", "E1")).otherwise(entry("unknown", "E1")),
        F.lit("application_deadline"), F.when(k % 3 == 0, entry(iso, "E1")).when(k % 3 == 1, entry(F.date_format(F.date_add(day, 1), "yyyy-MM-dd"), "E1")).otherwise(entry(iso)),
        F.lit("fee"), F.when(k % 4 == 0, entry("EUR 100", "E2")).when(k % 4 == 1, entry("EUR 300", "E2")).when(k % 4 == 2, entry("EUR 100 or 200 EUR", "E2")).otherwise(entry("free of charge", "E9")),
        F.lit("location"), F.when(k % 5 == 0, entry("Rome", "E2")).otherwise(entry("unknown")),
        F.lit("registration_status"), F.when(k % 7 == 0, entry("closed", "E3")).otherwise(entry("open", "E3")),
    )
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    items = o.select(url, F.when(k % 6 == 0, "All events").otherwise("School").alias("page_title"), F.lit("unknown").alias("page_type"), F.when(k % 2 == 0, "high").otherwise("low").alias("confidence"), fields.alias("fields"))
    texts = [F.concat(F.lit("Application deadline: "), F.date_format(day, "d MMMM yyyy"), F.lit(".")), F.lit("Fees: EUR 100, 200 EUR or EUR 250."), F.lit("Registration is now open.")]
    snippets = o.select(url, F.inline(F.array(*[F.struct(F.lit(f"E{i}").alias("id"), t.alias("text")) for i, t in enumerate(texts, 1)])))
    return items, snippets


def claims_validated(spark, sf_dir):
    """A model's claims against its snippets: every rule that these rows can break, and a registration that a past deadline closes."""
    items, snippets = _claims(spark, sf_dir)
    today = F.lit(LATER).cast("date")
    got = validation.reconciled(validation.validate(items, snippets, today), today)
    return got.select("page_url", F.array_join("warnings", ",").alias("warnings"), "confidence", F.try_element_at("fields", F.lit("registration_status"))["value"].alias("status"))


def _page_reasons(spark, sf_dir) -> DataFrame:
    p = F.col("p_partkey")
    url = F.concat(F.when(p % 7 == 0, "http://h/events/").otherwise("http://h/p/"), p.cast("string")).alias("page_url")
    parts = table(spark, sf_dir, "part")
    text = F.concat_ws(" ", pick(p, PAGES), F.when(p % 5 == 0, "in 1995 and 2001").otherwise("in 2031"))
    chunks = parts.select(url, F.when(p % 11 == 0, "Home").otherwise("Title").alias("page_title"), F.lit(0).alias("chunk_index"), text.alias("chunk"))
    cands = parts.filter(p % 3 == 0).select(url.alias("source_url"), F.lit("").alias("application_link"), F.lit("open").alias("deadline_status"), F.when(p % 6 == 0, F.lit("2001-01-01").cast("date")).otherwise(F.lit("2040-01-01").cast("date")).alias("deadline"), F.lit(None).cast("date").alias("start_date"))
    return validation.filter_pages(chunks, cands, F.lit("2026-07-14").cast("date"))


def page_filter(spark, sf_dir):
    return _page_reasons(spark, sf_dir)


def page_filter_stats(spark, sf_dir):
    return validation.filter_stats(_page_reasons(spark, sf_dir))


def evidence_ids(spark, sf_dir):
    """Ids as a model writes them, and the amounts that a claim and its evidence share."""
    k = F.col("p_partkey")
    ids = F.array(F.concat(F.lit(" e"), (k % 5).cast("string")), F.lit("note"), F.lit("E9"))
    claim, proof = F.concat(F.lit("EUR "), (k % 4 * 100 + 50).cast("string")), F.lit("50 EUR, 150 EUR")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(evidence.evidence_ids(ids), ",").alias("ids"), evidence.money_supported(claim, proof).alias("supported"))


_PLACE = "CASE o_orderkey % 3 WHEN 2 THEN 'Online' ELSE 'Port of ' || list_reduce(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), lambda a, b: a || ' ' || b) END"
_PAGES = "[" + ", ".join(f"'{p}'" for p in PAGES) + "]"

QUERIES = {
    "text_forms": (
        text_forms,
        r"""WITH p AS (SELECT *, p_name || '; ' || p_type AS b FROM part)
        SELECT p_partkey, left(trim(regexp_replace(lower(b), '[^a-z0-9]+', '-', 'g'), '-'), 30) AS slug, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 70) || '-' || left(sha1(p_brand), 8) || '.html' AS file,
          CASE WHEN length(b) <= 25 THEN b ELSE coalesce(nullif(regexp_extract(left(b, 25), '^(.*\S)\s+\S*$', 1), ''), left(b, 25)) END AS short, lower(p_name || ' ' || p_brand) AS name, '\*' || replace(p_brand, '#', '\#') || '\*' AS markdown,
          replace(b, ';', '\;') AS ics, CASE WHEN contains(lower(b), 'steel') THEN 'steel' WHEN contains(lower(b), 'brass') THEN 'brass' WHEN contains(lower(b), 'tin') THEN 'tin' ELSE 'none' END AS metal,
          CASE WHEN regexp_matches(b, '(?i)large (\w+)') THEN regexp_extract(b, '(?i)large (\w+)', 1) ELSE regexp_extract(b, '(?i)small \w+', 0) END AS after,
          trim(regexp_extract(b, '(?i)\b(?:brushed|polished)\b.{0,8}', 0)) AS window FROM p""",
    ),
    "opportunity_terms": (
        opportunity_terms,
        """SELECT p_partkey, k IN (0, 4) AS looks, k IN (1, 3) AS excluded, k = 2 AS workshop, [3, 3, 0, 1, 3, 2][k + 1]::INT AS score, ([3, 3, 0, 1, 3, 2][k + 1] + CASE WHEN p_size > 25 THEN 3 ELSE 0 END)::INT AS provider_score
        FROM (SELECT p_partkey, p_size, p_partkey % 6 AS k FROM part)""",
    ),
    "useful_chunks": (
        useful_chunks,
        # Two core words: 'funding' and the like stand alone in kinds 1 and 4, so that filler outweighs them.
        """SELECT p_partkey, p_partkey % 6 IN (1, 4) AND p_size % 3 <> 0 AND p_size % 5 <> 0 OR p_partkey % 6 = 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AS useful FROM part""",
    ),
    "follow_links": (
        follow_links,
        """WITH p AS (SELECT page_id, url || '~' || page_id AS url, 'https://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS origin FROM pages),
        l AS (SELECT url, origin || '/apply/' || page_id AS href, 5 AS score FROM p UNION ALL SELECT url, origin || '/money', 4 FROM p)
        SELECT url, href, score::INT AS score, (row_number() OVER (PARTITION BY url ORDER BY score DESC, href))::INT AS rank FROM l""",
    ),
    "override_apply": (
        override_apply,
        """SELECT 'https://www.shop.example/c/' || c_custkey AS source_url, c_name AS title, 'r' || CASE WHEN c_name = 'Customer#000000009' THEN '; by title' ELSE '' END || CASE WHEN contains(c_name, '0001') THEN '; by part' ELSE '' END AS risk_points,
          CASE WHEN contains(c_name, '0001') THEN 1.0 WHEN c_name = 'Customer#000000009' THEN NULL ELSE c_acctbal::DOUBLE END AS fee_eur FROM customer WHERE c_name <> 'Customer#000000005'""",
    ),
    "model_facts": (
        model_facts,
        f"""WITH b AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber = 2) DESC, l_quantity DESC, l_linenumber * 100000 + l_partkey % 100000) = 1)
        SELECT 'http://o/' || o_orderkey AS source_url, CASE WHEN o_orderkey % 2 <> 0 THEN 'Lund' ELSE coalesce('S' || l_suppkey, 'Europe') END AS location, CASE WHEN o_orderkey % 3 <> 0 THEN 'online' WHEN l_orderkey IS NULL THEN 'uncertain' ELSE 'hybrid' END AS mode,
          l_shipdate::DATE AS end_date, CASE WHEN l_orderkey IS NOT NULL THEN greatest(l_shipdate::DATE - o_orderdate::DATE + 1, 1)::INT END AS duration_days, l_shipdate::DATE + 5 AS deadline,
          CASE WHEN l_orderkey IS NULL THEN 'uncertain' ELSE 'open' END AS deadline_status FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""",
    ),
    "notice_facts": (
        notice_facts,
        f"""SELECT o_orderkey, {_PLACE} AS place, o_orderdate::DATE + 14600 AS deadline, o_orderdate::DATE + 14630 AS start_date, o_orderdate::DATE + 14639 AS end_date,
          CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE floor(o_totalprice)::DOUBLE END AS fee_eur, CASE WHEN o_orderkey % 4 <> 0 THEN 'EUR' END AS currency, CASE WHEN o_orderkey % 4 <> 0 THEN 95.0::DOUBLE END AS student_fee,
          ['fellowship', '', 'travel grant', 'stipend, accommodation support', ''][o_orderkey % 5 + 1] AS funding FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "claims_validated": (
        claims_validated,
        f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE + 14600 + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS due FROM orders),
        w AS (SELECT k, due, list_filter([
          CASE WHEN k % 2 <> 0 THEN 'unknown_field_has_evidence_id:title' END, CASE WHEN k % 5 = 0 THEN 'location_context_weak' END, CASE WHEN k % 3 = 2 THEN 'missing_evidence_id:application_deadline' END,
          CASE WHEN k % 4 = 3 THEN 'evidence_id_not_found:fee' END, CASE WHEN k % 3 = 1 THEN 'application_deadline_value_not_in_evidence' END,
          CASE k % 4 WHEN 1 THEN 'fee_value_not_in_evidence' WHEN 2 THEN 'fee_tiers_incomplete' END, CASE WHEN k % 7 = 0 THEN 'registration_status_conflict' END,
          CASE WHEN due < DATE '{LATER}' THEN 'deadline_past' END, CASE WHEN k % 6 = 0 AND k % 5 = 0 THEN 'index_page_specific_field_risk' END], lambda x: x IS NOT NULL) AS w FROM o)
        SELECT 'http://o/' || k AS page_url, array_to_string(CASE WHEN due < DATE '{LATER}' AND k % 7 <> 0 THEN list_append(w, 'registration_status_corrected_from_past_deadline') ELSE w END, ',') AS warnings,
          CASE WHEN len(w) = 0 THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END WHEN k % 2 = 0 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN k % 7 = 0 OR due < DATE '{LATER}' THEN 'closed' ELSE 'open' END AS status FROM w""",
    ),
    "page_filter": (
        page_filter,
        """SELECT CASE WHEN p % 7 = 0 THEN 'http://h/events/' ELSE 'http://h/p/' END || p AS page_url, CASE WHEN p % 11 = 0 OR p % 7 = 0 THEN 'listing_or_generic_page' WHEN p % 5 = 0 THEN 'past_explicit_year' WHEN p % 6 = 0 THEN 'past_candidate'
          WHEN p % 6 IN (2, 3) THEN 'weak_programme_signal' WHEN p % 6 = 5 THEN 'weak_detail_signal' ELSE '' END AS reason FROM (SELECT p_partkey AS p FROM part)""",
    ),
    "page_filter_stats": (
        page_filter_stats,
        """SELECT count(*) AS pages_before, count(*) FILTER (ok) AS pages_after, count(*) FILTER (NOT ok) AS pages_rejected FROM (SELECT p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 6 IN (1, 4) AS ok FROM part)""",
    ),
    "evidence_ids": (evidence_ids, "SELECT p_partkey, 'E' || p_partkey % 5 || ',E9' AS ids, p_partkey % 4 <= 1 AS supported FROM part"),
}

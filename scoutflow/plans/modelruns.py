"""Queries on fetches, model runs and scan coverage, on rows made of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutflow.operators import coverage, fetching, modelruns
from scoutflow.plans.candidates import pick, table

NOW = "2026-01-20 00:00:00"
SETTINGS = {"model": "m", "size": 1800}
TITLES = ["Summer school", "www.school.example", "https://a.example/x", "school.org", "Data week 2.0"]
REGIONS = ["UK", "Africa", "Global", "East Asia", "Mars"]
PLACES = ["Lund", " Europe ", "uk", "", "Mars"]


def _responses(spark, sf_dir):
    """Customers as addresses: what the cache knows of two in three of them, and what a request gives now."""
    k = F.col("c_custkey")
    url = F.concat(F.lit("http://c/"), k.cast("string"))
    rows = table(spark, sf_dir, "customer")
    day = F.lit(NOW).cast("timestamp")
    cache = rows.filter(k % 3 != 0).select(url.alias("url"), F.concat(url, F.lit("#old")).alias("final_url"), F.when(k % 2 == 0, F.concat(F.lit("e"), k)).otherwise("").alias("etag"), F.lit(" ").alias("last_modified"), F.when(k % 7 != 0, F.col("c_name")).alias("text"), (day - F.make_dt_interval((k % 30).cast("int"))).alias("validated_at"))
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 304, 503, 429, 404, None)]), (k % 6 + 1).cast("int"))
    responses = rows.filter(k % 5 != 0).select(url.alias("url"), status.alias("status"), url.alias("final_url"), F.lit("new").alias("etag"), F.lit("").alias("last_modified"), F.col("c_mktsegment").alias("text"), (k % 6 == 5).alias("raised"))
    return responses, cache, day


def fetch_outcomes(spark, sf_dir):
    responses, cache, now = _responses(spark, sf_dir)
    sent = fetching.conditional(responses.select("url"), cache)
    return fetching.settled(responses, cache, now).join(sent, "url")


def fetch_cache(spark, sf_dir):
    responses, cache, now = _responses(spark, sf_dir)
    return fetching.next_cache(responses, cache, now).select("url", "final_url", "etag", "text", F.date_format("validated_at", "yyyy-MM-dd").alias("validated"))


def refresh_targets(spark, sf_dir):
    """Suppliers' landing pages, four kinds of refresh tag among them."""
    k = F.col("s_suppkey")
    tag = pick(k, ["<META content='0; url=/2026/' HTTP-EQUIV=refresh>", '<meta http-equiv="Refresh" content="5;URL=next.html"/>', "<meta http-equiv='refresh' content='3'>", "<meta name=x content='url=/no'>", '<meta http-equiv=refresh content="0;url=\'https://b.example/y\'">'])
    page = F.concat(F.lit("<html><head>"), tag, F.lit("</head></html>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", fetching.meta_refresh(page, F.concat(F.lit("http://a.example/"), k.cast("string"), F.lit("/index"))).alias("target"))


def ranking_cache(spark, sf_dir):
    """Parts as pages: every second one is in the cache, half of these in a broken entry; every fifth has no useful chunk."""
    k = F.col("p_partkey")
    pages = table(spark, sf_dir, "part").select(k, F.concat(F.lit("http://p/"), k.cast("string")).alias("url"), F.concat(F.lit("  "), "p_name").alias("text"))
    chunk = F.struct(F.col("url").alias("page_url"), F.when(k % 4 != 0, "t").alias("page_title"), F.lit("s").alias("source_name"), F.lit(0).alias("chunk_index"), F.lit("old").alias("text"), F.lit(0.5).alias("score"))
    cache = pages.filter(k % 2 == 0).select(modelruns.cache_key(F.col("url"), F.col("text"), SETTINGS).alias("key"), F.array(chunk, chunk).alias("chunks"))

    def rank(rows):
        """Three chunks a page, the later ones better."""
        each = rows.filter("p_partkey % 5 <> 0").withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        return each.select(F.col("url").alias("page_url"), F.lit("t").alias("page_title"), F.lit("s").alias("source_name"), "chunk_index", F.concat("text", F.col("chunk_index").cast("string")).alias("text"), (F.col("chunk_index") / 2).alias("score"))

    got = modelruns.ranked_through_cache(pages, cache, SETTINGS, rank)
    return got.select("key", "page_url", "cached", F.size("chunks").alias("n"), F.array_join(F.transform("chunks", lambda c: c["text"]), "|").alias("texts"))


def batches_for_model(spark, sf_dir):
    """The two dearest lines of the fifty orders with the dearest line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_url"), F.col("l_linenumber").alias("chunk_index"), F.col("l_extendedprice").cast("double").alias("score"))
    return modelruns.page_batches(lines, 50, 2).select("page_url", "chunk_index", "rank")


def follow_up_reading(spark, sf_dir):
    """Suppliers' own chunks with the best two of their nation's customers."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    own, nation = F.concat(F.lit("http://S/"), F.col("s_suppkey").cast("string")), lambda x: F.concat(F.lit("http://n/"), F.col(x).cast("string"))
    base = s.filter("s_suppkey % 2 = 0").select(own.alias("page_url"), F.col("s_name").alias("page_title"), F.lit("src").alias("source_name"), F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"), F.col("s_name").alias("text"), F.col("s_acctbal").cast("double").alias("score"))
    found = c.select(nation("c_nationkey").alias("page_url"), F.col("c_name").alias("page_title"), F.lit("nat").alias("source_name"), F.col("c_custkey").cast("int").alias("chunk_index"), F.col("c_mktsegment").alias("text"), F.col("c_acctbal").cast("double").alias("score"))
    edges = s.select(own.alias("parent"), F.concat(nation("s_nationkey"), F.lit("#part")).alias("url"))
    return modelruns.with_follow_ups(base, found, edges, 2)


def first_candidates(spark, sf_dir):
    """Orders as pages; their lines and those that name them as an application link are the candidates."""
    url = lambda x: F.concat(F.lit("http://o/"), x.cast("string"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), url(F.col("l_orderkey")).alias("source_url"), F.when(F.col("l_linenumber") == 1, url(F.col("l_partkey"))).otherwise("").alias("application_link"))
    return modelruns.first_by_page(table(spark, sf_dir, "orders").select(url(F.col("o_orderkey")).alias("page_url")), lines, "ord")


def trusted_values(spark, sf_dir):
    """Orders as items: some values unknown, some without evidence, some that warnings take the trust from."""
    k = F.col("o_orderkey")
    texts = F.when(k % 3 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("seen "), F.lit(""), F.lit("there")))
    field = lambda v: F.struct(v.alias("value"), texts.alias("texts"))
    due = F.when(k % 11 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    fields = F.map_from_arrays(F.array(*map(F.lit, ["application_deadline", "fee", "registration_status", "title"])), F.array(field(due), field(F.lit(" EUR  5 ")), field(pick(k, ["unknown", "Open", "not_yet_open", "maybe", ""])), field(F.lit("T"))))
    warnings = F.array(pick(k, ["fee_context_weak", "missing_evidence_id:application_deadline", "index_or_listing_page", "deepseek_x", " ", "deadline_context_weak", "llm_json_parse_failed"]))
    rows = table(spark, sf_dir, "orders").select(k, fields.alias("f"), warnings.alias("w"))
    f, w = F.col("f"), F.col("w")
    return rows.select(
        k, modelruns.trusted(f, "fee", w).alias("fee"), modelruns.trusted(f, "location", w).alias("place"), modelruns.trusted_day(f, "application_deadline", w).alias("deadline"), modelruns.trusted_status(f, w, F.lit("1995-01-01").cast("date")).alias("status"),
        F.array_join(modelruns.model_warnings(w, F.when(k % 2 == 0, "Fees").otherwise("listing")), ",").alias("own"), F.array_join(modelruns.operational_warnings(w), ",").alias("kept"), modelruns.worth_a_look(k % 4 == 0, F.when(k % 5 == 0, w), f).alias("look"),
    )


def text_previews(spark, sf_dir):
    """Previews and public snippets of long texts; one in three speaks of a deadline late, one of a school."""
    k = F.col("p_partkey")
    text = F.concat(F.repeat(F.lit("filler "), 90), pick(k, ["the deadline is near ", "a summer school ", "nothing "]), F.repeat(F.col("p_brand"), 90))
    snippets = F.array(F.struct(F.lit("E1").alias("id"), F.lit(None).cast("string").alias("page_url"), text.alias("text"), F.lit(None).cast("array<string>").alias("signals"), F.lit(1).alias("hidden")))
    shown = modelruns.public_snippets(snippets)[0]
    return table(spark, sf_dir, "part").select(k, modelruns.preview(text).alias("preview"), modelruns.preview(F.col("p_name"), 10).alias("short"), shown["page_url"].alias("page"), F.length(shown["text"]).alias("n_text"), F.size(shown["signals"]).alias("n_signals"))


def collection_notes(spark, sf_dir):
    k = F.col("s_suppkey")
    said = pick(k, ["403 Client Error: x", "Playwright: Executable doesn't exist", "Not Found", "", "Read timed out after a very long while "])
    error = F.when(k % 5 == 4, F.concat("s_name", F.lit(": "), F.repeat(said, 6))).when(said != "", F.concat((k % 40).cast("string"), F.lit(": "), said)).otherwise("")
    return coverage.collection_notes(table(spark, sf_dir, "supplier").select(k, error.alias("error")), "s_suppkey")


def source_health(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    health = rows.filter(k % 4 != 0).select(F.col("s_name").alias("name"), pick(k, ["healthy", "failed", "odd"]).alias("status"), F.when(k % 5 != 0, F.lit("2026-01-02").cast("date")).alias("last_success"), F.when(k % 2 == 0, (k % 9).cast("int")).alias("consecutive_failures"))
    return coverage.with_health(rows.select(F.col("s_name").alias("name")), health)


def discovery_funnel(spark, sf_dir):
    k = F.col("c_custkey")
    results = table(spark, sf_dir, "customer").select(F.when(k % 10 != 0, F.concat(F.lit("u"), F.floor(k / 2).cast("string"))).otherwise("").alias("url"), pick(k, ["", "old", "", "login", ""]).alias("reason"))
    ranked = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "discovery").otherwise("base").alias("layer"), (F.col("o_orderstatus") == "F").alias("fully_qualified"))
    return coverage.funnel(results, ranked)


def earlier_notes(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    note = lambda m: F.when(k % m == 0, "changed").otherwise(F.col("s_name"))
    earlier = rows.filter(k % 3 != 0).select(F.col("s_name").alias("name"), F.lit("u").alias("url"), F.col("s_name").alias("notes"), F.when(k % 5 != 0, F.concat(F.lit("zh "), "s_name")).otherwise(" ").alias("notes_zh"))
    return coverage.with_earlier_notes(rows.select(F.col("s_name").alias("name"), F.lit("u").alias("url"), note(4).alias("notes"), F.when(k % 7 == 0, "mine").alias("notes_zh")), earlier)


def record_facts(spark, sf_dir):
    k = F.col("p_partkey")
    size = F.col("p_size")
    fee = F.when(k % 4 == 0, F.concat(F.lit("Early Bird "), size.cast("string"), F.lit(" EUR 200 EUR Regular "), (size + 60).cast("string"), F.lit(",5 EUR 310.4 EUR"))).when(k % 4 == 1, F.concat(F.lit("PhD students pay "), size.cast("string"), F.lit(" EUR, others 99 EUR"))).when(k % 4 == 2, F.concat(F.lit("From 12 € to "), (size + 20).cast("string"), F.lit(" €"))).otherwise("free")
    dates = F.when(k % 3 == 0, "05/07/26 - 12/07/26").when(k % 3 == 1, "31/02/26-03/03/26").otherwise("5/7/26")
    table_ = coverage.fee_table(fee)
    span = coverage.listing_range(dates)
    return table(spark, sf_dir, "part").select(
        k, coverage.region_class(pick(k, REGIONS)).alias("region"), coverage.specific_place(pick(size, PLACES), pick(k, REGIONS)).alias("place"), coverage.looks_like_url(pick(k, TITLES)).alias("address"), coverage.too_short(F.when(size != 9, size)).alias("short"),
        F.array_join(coverage.listed(F.concat(F.lit(" a,, "), "p_brand", F.lit(" ,"))), "|").alias("parts"), coverage.transient(pick(k, ["Read TIMED OUT", "404", "Connection reset"])).alias("transient"), coverage.keeps_page(k % 2 == 0, F.when(k % 3 == 0, "research_training_provider")).alias("keep"),
        table_["label"].alias("fee"), table_["amount"].alias("amount"), span["start"].alias("start"), span["end"].alias("end"), coverage.status_line(k % 2, k % 3, k % 2 + size % 2, size).alias("line"),
    )


_C = """c AS (SELECT c_custkey AS k, 'http://c/' || c_custkey AS url, c_name, c_mktsegment FROM customer),
      r AS (SELECT *, [200, 304, 503, 429, 404, NULL][k % 6 + 1] AS status, k % 3 <> 0 AS stored, k % 3 <> 0 AND k % 7 <> 0 AS has, k % 30 AS age FROM c)"""

QUERIES = {
    "fetch_outcomes": (
        fetch_outcomes,
        f"""WITH {_C}, o AS (SELECT *, CASE WHEN status = 200 THEN 'fresh' WHEN status = 304 AND has THEN 'revalidated' WHEN (status IS NULL OR status IN (429, 503)) AND has AND age <= 14 THEN 'stale' ELSE 'error' END AS outcome FROM r WHERE k % 5 <> 0)
        SELECT url, outcome, CASE WHEN outcome = 'fresh' THEN url WHEN outcome <> 'error' THEN url || '#old' END AS final_url, CASE WHEN outcome = 'fresh' THEN c_mktsegment WHEN outcome <> 'error' THEN c_name END AS text,
          CASE WHEN outcome = 'stale' THEN age * 86400 END AS age_seconds, CASE WHEN stored AND k % 2 = 0 THEN 'e' || k END AS if_none_match, NULL::VARCHAR AS if_modified_since FROM o""",
    ),
    "fetch_cache": (
        fetch_cache,
        f"""WITH {_C}, o AS (SELECT *, k % 5 <> 0 AND coalesce(status = 200, false) AS f FROM r)
        SELECT url, CASE WHEN f THEN url ELSE url || '#old' END AS final_url, CASE WHEN f THEN 'new' WHEN k % 2 = 0 THEN 'e' || k ELSE '' END AS etag, CASE WHEN f THEN c_mktsegment WHEN has THEN c_name END AS text,
          strftime(CASE WHEN f OR (k % 5 <> 0 AND status = 304 AND has) THEN DATE '2026-01-20' ELSE DATE '2026-01-20' - age::INT END, '%Y-%m-%d') AS validated FROM o WHERE f OR stored""",
    ),
    "refresh_targets": (
        refresh_targets,
        "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'http://a.example/2026/' WHEN 1 THEN 'http://a.example/' || s_suppkey || '/next.html' WHEN 4 THEN 'https://b.example/y' END AS target FROM supplier",
    ),
    "ranking_cache": (
        ranking_cache,
        """SELECT sha256('http://p/' || k || chr(10) || sha256(p_name) || chr(10) || '{"model": "m", "size": 1800}') AS key, 'http://p/' || k AS page_url, k % 4 = 2 AS cached,
          CASE WHEN k % 4 = 2 THEN 2 WHEN k % 5 <> 0 THEN 3 ELSE 0 END AS n, CASE WHEN k % 4 = 2 THEN 'old|old' WHEN k % 5 <> 0 THEN '  ' || p_name || '2|  ' || p_name || '1|  ' || p_name || '0' ELSE '' END AS texts FROM (SELECT p_partkey AS k, p_name FROM part)""",
    ),
    "batches_for_model": (
        batches_for_model,
        """WITH best AS (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1 ORDER BY m DESC, l_orderkey LIMIT 50)
        SELECT l_orderkey AS page_url, l_linenumber AS chunk_index, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank FROM lineitem JOIN best USING (l_orderkey)) WHERE rank <= 2""",
    ),
    "follow_up_reading": (
        follow_up_reading,
        """WITH e AS (SELECT 'http://S/' || s_suppkey AS parent, s_nationkey FROM supplier),
        own AS (SELECT 'http://S/' || s_suppkey AS parent, 'http://S/' || s_suppkey AS u, s_name AS title, 'src' AS src, i AS ix, s_name AS text, s_acctbal::DOUBLE AS score, 0 AS kind FROM supplier, (VALUES (0), (1)) v(i) WHERE s_suppkey % 2 = 0),
        found AS (SELECT * FROM (SELECT parent, 'http://n/' || c_nationkey AS u, c_name AS title, 'nat' AS src, c_custkey AS ix, c_mktsegment AS text, c_acctbal::DOUBLE AS score, 1 AS kind,
          row_number() OVER (PARTITION BY parent ORDER BY c_acctbal DESC, c_custkey) AS r FROM e JOIN customer ON c_nationkey = s_nationkey) WHERE r <= 2),
        b AS (SELECT * FROM own UNION ALL SELECT * EXCLUDE (r) FROM found)
        SELECT parent AS page_url, first(title) OVER w AS page_title, first(src) OVER w AS source_name, row_number() OVER w - 1 AS chunk_index, '[Official source page: ' || u || '] ' || text AS text, score FROM b WINDOW w AS (PARTITION BY parent ORDER BY kind, score DESC, u, ix)""",
    ),
    "first_candidates": (
        first_candidates,
        """WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_orderkey AS page FROM lineitem UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_partkey FROM lineitem WHERE l_linenumber = 1)
        SELECT 'http://o/' || o_orderkey AS page_url, f AS first FROM orders LEFT JOIN (SELECT page, min(ord) AS f FROM k GROUP BY 1) ON page = o_orderkey""",
    ),
    "trusted_values": (
        trusted_values,
        """WITH a AS (SELECT o_orderkey AS k, o_orderdate::DATE AS d, k % 3 <> 0 AS seen, k % 7 AS w FROM orders),
        b AS (SELECT *, CASE WHEN seen AND k % 11 <> 0 AND w NOT IN (1, 5) THEN d END AS due, CASE WHEN seen THEN ['', 'open', 'not_open', '', ''][k % 5 + 1] ELSE '' END AS said FROM a)
        SELECT k AS o_orderkey, CASE WHEN seen AND w <> 0 THEN 'EUR 5' ELSE '' END AS fee, '' AS place, due AS deadline, CASE WHEN said <> '' THEN said WHEN due >= DATE '1995-01-01' THEN 'open' WHEN due IS NOT NULL THEN 'closed' ELSE 'uncertain' END AS status,
          CASE WHEN w = 4 OR (w = 2 AND k % 2 = 0) THEN '' ELSE ['fee_context_weak', 'missing_evidence_id:application_deadline', 'index_or_listing_page', 'deepseek_x', ' ', 'deadline_context_weak', 'llm_json_parse_failed'][w + 1] END AS own,
          CASE w WHEN 3 THEN 'deepseek_x' WHEN 6 THEN 'llm_json_parse_failed' ELSE '' END AS kept, k % 4 <> 0 AND (k % 5 = 0 OR seen) AS look FROM b""",
    ),
    "text_previews": (
        text_previews,
        """WITH a AS (SELECT p_partkey AS k, p_name, repeat('filler ', 90) || ['the deadline is near ', 'a summer school ', 'nothing '][p_partkey % 3 + 1] || repeat(p_brand, 90) AS t FROM part)
        SELECT k AS p_partkey, CASE k % 3 WHEN 0 THEN '...' || left(trim(substr(t, 635 - 120, 500)), 497) WHEN 1 THEN '...' || left(trim(substr(t, 633 - 120, 500)), 497) ELSE left(t, 500) END AS preview, CASE WHEN length(p_name) <= 10 THEN p_name ELSE trim(left(p_name, 10)) END AS short, '' AS page, 500 AS n_text, 0 AS n_signals FROM a""",
    ),
    "collection_notes": (
        collection_notes,
        """WITH a AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN (s_suppkey % 40) || ': access was blocked by the source website during this scan.' WHEN 1 THEN (s_suppkey % 40) || ': browser rendering unavailable; install Playwright browsers or disable rendered scan for this source.'
          WHEN 2 THEN (s_suppkey % 40) || ': configured page was not found during this scan.' WHEN 4 THEN rtrim(left(s_name || ': ' || repeat('Read timed out after a very long while ', 6), 177)) || '...' END AS note FROM supplier)
        SELECT min(s_suppkey) AS s_suppkey, note FROM a WHERE note IS NOT NULL GROUP BY note""",
    ),
    "source_health": (
        source_health,
        """SELECT s_name AS name, CASE WHEN k % 4 = 0 THEN 'Not scanned yet' ELSE CASE k % 3 WHEN 0 THEN 'Healthy' WHEN 1 THEN 'Failed · ' || CASE WHEN k % 2 = 0 THEN k % 9 ELSE 0 END || ' consecutive' ELSE 'Unknown' END || ' · Last success: ' || CASE WHEN k % 5 <> 0 THEN '2026-01-02' ELSE 'never' END END AS health
        FROM (SELECT s_name, s_suppkey AS k FROM supplier)""",
    ),
    "discovery_funnel": (
        discovery_funnel,
        """WITH r AS (SELECT c_custkey AS k, CASE WHEN k % 10 <> 0 THEN k // 2 END AS url, ['', 'old', '', 'login', ''][k % 5 + 1] AS reason FROM customer), d AS (SELECT o_orderstatus = 'F' AS q FROM orders WHERE o_orderkey % 3 = 0)
        SELECT 'results' AS counter, count(*) AS n FROM r UNION ALL SELECT 'unique_results', count(DISTINCT url) FROM r UNION ALL SELECT 'results_accepted', count(*) FROM r WHERE reason = '' UNION ALL SELECT 'results_rejected', count(*) FROM r WHERE reason <> ''
        UNION ALL SELECT 'rejected_' || reason, count(*) FROM r WHERE reason <> '' GROUP BY reason UNION ALL SELECT 'candidates_ranked', count(*) FROM d UNION ALL SELECT 'candidates_fully_qualified', count(*) FROM d WHERE q""",
    ),
    "earlier_notes": (
        earlier_notes,
        """SELECT s_name AS name, 'u' AS url, CASE WHEN k % 4 = 0 THEN 'changed' ELSE s_name END AS notes, CASE WHEN k % 7 = 0 THEN 'mine' WHEN k % 3 <> 0 AND k % 5 <> 0 AND k % 4 <> 0 THEN 'zh ' || s_name END AS notes_zh FROM (SELECT *, s_suppkey AS k FROM supplier)""",
    ),
    "record_facts": (
        record_facts,
        f"""WITH a AS (SELECT p_partkey AS k, p_size AS s, p_brand, {REGIONS}[p_partkey % 5 + 1] AS region, {PLACES}[p_size % 5 + 1] AS place, p_partkey % 2 + p_size % 2 AS n FROM part)
        SELECT k AS p_partkey, ['priority', 'supplementary', 'global', 'priority', 'unclassified'][k % 5 + 1] AS region, lower(trim(place)) NOT IN ('', 'europe', lower(region)) AS place, k % 5 BETWEEN 1 AND 3 AS address, s < 5 AS short, 'a|' || p_brand AS parts,
          k % 3 <> 1 AS transient, k % 2 = 0 OR k % 3 = 0 AS keep,
          CASE k % 4 WHEN 0 THEN 'Academia EUR ' || s || '-' || CASE WHEN s % 2 = 0 THEN s + 60 ELSE s + 61 END || '; non-academia up to EUR 310' WHEN 1 THEN 'Student/PhD EUR ' || s WHEN 2 THEN 'EUR 12-' || (s + 20) ELSE '' END AS fee,
          CASE k % 4 WHEN 0 THEN s + 60.5 WHEN 1 THEN s WHEN 2 THEN s + 20 END::DOUBLE AS amount, CASE WHEN k % 3 = 0 THEN DATE '2026-07-05' END AS start, CASE k % 3 WHEN 0 THEN DATE '2026-07-12' WHEN 1 THEN DATE '2026-03-03' END AS "end",
          CASE WHEN k % 2 > 0 THEN '1 fully qualified opportunity in the latest scan. ' WHEN k % 3 > 0 THEN 'No fully qualified matches in the latest scan. ' ELSE 'No open opportunities matched every rule in the latest scan. ' END
            || 'Tracking ' || n || CASE WHEN n = 1 THEN ' opportunity' ELSE ' opportunities' END || ' across ' || s || ' trusted sources.'
            || CASE WHEN k % 2 > 0 THEN '' WHEN k % 3 > 0 THEN ' Additional opportunities from official sources are shown below.' ELSE ' New schools surface as their deadlines open, typically December to April.' END AS line FROM a""",
    ),
}

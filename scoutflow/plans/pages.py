"""Queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.functions import urls
from scoutflow.operators import filters
from scoutflow.operators.topk import capped_top, top_per_group

BLOCKED = ["example.org"]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def url_canonicalize(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


def url_dedupe_keep_first(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return filters.keep_first(rows, ["canonical"], ["page_id"])


def host_suffix_block(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"), urls.host_matches(urls.host(F.col("url")), BLOCKED).alias("blocked"))


def url_reject_reason(spark, sf_dir):
    u = F.col("url")
    reason = F.when(urls.safe_external(u) == "", "invalid_url").when(urls.host_matches(urls.host(u), BLOCKED), "blocked_domain").when(F.contains(u, F.lit("utm_")), "tracking").otherwise("")
    return pages(spark, sf_dir).select("page_id", reason.alias("reason"))


def reject_histogram(spark, sf_dir):
    return filters.reject_histogram(url_reject_reason(spark, sf_dir))


def page_title_clean(spark, sf_dir):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return pages(spark, sf_dir).select("page_id", tx.clean_title(title).alias("title"))


def _links(spark, sf_dir) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages(spark, sf_dir).select("page_id", "url", F.posexplode(found).alias("pos", "href"))


def page_links_explode(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href")


def link_score_topk(spark, sf_dir):
    """Links by how many letters of a term list they hold, three a page."""
    scored = _links(spark, sf_dir).withColumn("score", 2 * tx.count_terms(F.col("href"), ["the", "er", "ion"]) + tx.count_terms(F.col("href"), ["th", "en"])).filter("score > 0")
    best = scored.groupBy("page_id", "href").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return top_per_group(best, ["page_id"], [F.desc("score"), F.asc("pos")], 3).select("page_id", "href", "score", "rank")


def pages_ranked_host_cap(spark, sf_dir):
    """The flagship: canonical pages, scored by their title's words, forty in all and five of a host."""
    title = tx.clean_title(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    score = 2 * tx.count_terms(title, ["the", "er", "ion"]) + tx.count_terms(title, ["th", "en"])
    rows = pages(spark, sf_dir).select("page_id", urls.canonical_url(F.col("url")).alias("canonical"), urls.host(F.col("url")).alias("host"), title.alias("title"), score.alias("score"))
    first = filters.keep_first(rows, ["canonical"], ["page_id"])
    return capped_top(first, "host", [F.desc("score"), F.asc("page_id")], 5, 40)


def same_domain_pairs(spark, sf_dir):
    """Pages whose host is the same as, or below, that of the page with the next id."""
    rows = pages(spark, sf_dir).select("page_id", "url")
    nxt = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return rows.join(nxt, "page_id").select("page_id", urls.same_domain(F.col("url"), F.col("other")).alias("same"))


_HOST = r"lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), ':\d*$', ''))"
_TITLE = "left(trim(string_split(string_split(string_split(string_split(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), ' | ')[1], ' - ')[1], ' • ')[1], ' :: ')[1]), 140)"
_PATH = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
_TRACK = ", ".join(f"'{t}'" for t in urls.TRACKING)
_CANON = f"""regexp_extract(url, '^([A-Za-z]+):', 1) || '://' || regexp_replace({_HOST}, '^www\\.', '') || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END
 || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split({_QUERY}, '&'), lambda p: contains(p, '=') AND string_split(p, '=')[2] <> ''
 AND NOT starts_with(lower(p), 'utm_') AND string_split(lower(p), '=')[1] NOT IN ({_TRACK}))), '&'), ''), '')"""
_REASON = f"CASE WHEN NOT regexp_matches(url, '^https?://[^/?#]+') THEN 'invalid_url' WHEN {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' THEN 'blocked_domain' WHEN contains(url, 'utm_') THEN 'tracking' ELSE '' END"
_LINKS = """links AS (SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages))"""


def _score(x: str) -> str:
    return f"(2 * (contains(lower({x}), 'the')::INT + contains(lower({x}), 'er')::INT + contains(lower({x}), 'ion')::INT) + contains(lower({x}), 'th')::INT + contains(lower({x}), 'en')::INT)"


QUERIES = {
    "url_canonicalize": (url_canonicalize, f"SELECT page_id, {_CANON} AS canonical FROM pages"),
    "url_dedupe_keep_first": (url_dedupe_keep_first, f"SELECT min(page_id) AS page_id, {_CANON} AS canonical FROM pages GROUP BY 2"),
    "host_suffix_block": (host_suffix_block, f"SELECT page_id, {_HOST} AS host, {_HOST} = 'example.org' OR {_HOST} LIKE '%.example.org' AS blocked FROM pages"),
    "url_reject_reason": (url_reject_reason, f"SELECT page_id, {_REASON} AS reason FROM pages"),
    "reject_histogram": (reject_histogram, f"SELECT {_REASON} AS reason, count(*) AS n FROM pages WHERE {_REASON} <> '' GROUP BY 1"),
    "page_title_clean": (page_title_clean, f"SELECT page_id, {_TITLE} AS title FROM pages"),
    "page_links_explode": (page_links_explode, f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, href FROM links"),
    "link_score_topk": (
        link_score_topk,
        f"""WITH {_LINKS}, best AS (SELECT page_id, href, max({_score("href")}) AS score, min(pos) AS pos FROM links WHERE {_score("href")} > 0 GROUP BY 1, 2)
        SELECT page_id, href, score::INT AS score, (row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos))::INT AS rank FROM best QUALIFY rank <= 3""",
    ),
    "pages_ranked_host_cap": (
        pages_ranked_host_cap,
        f"""WITH p AS (SELECT page_id, {_CANON} AS canonical, {_HOST} AS host, {_TITLE} AS title FROM pages),
        s AS (SELECT *, {_score("title")}::INT AS score FROM p QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY page_id) = 1),
        c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) <= 5)
        SELECT page_id, canonical, host, title, score FROM c ORDER BY score DESC, page_id LIMIT 40""",
    ),
    "same_domain_pairs": (
        same_domain_pairs,
        f"""WITH h AS (SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS h FROM pages)
        SELECT a.page_id, a.h = b.h OR a.h LIKE '%.' || b.h OR b.h LIKE '%.' || a.h AS same FROM h a JOIN h b ON b.page_id = a.page_id + 1""",
    ),
}

"""Bringing further facts to candidates: hand-made overrides, model output, and pages found by following links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.functions import urls
from scoutflow.operators.topk import top_per_group

OVERRIDE = "ord int, url string, title string, title_contains string, status string, note string, fields map<string,string>"
COARSE_PLACES = ["", "uncertain", "europe", "continental europe", "global"]
# Warnings that end a follow-up or forbid a new record, fields that matter, and words that lead to them.
FINAL_WARNINGS = ["index_or_listing_page", "deadline_past", "event_past", "llm_json_parse_failed", "no_evidence_snippets"]
CRITICAL = ["application_deadline", "start_date", "end_date", "fee", "location"]
FIELD_WORDS = {"application_deadline": ["deadline", "apply", "dates"], "start_date": ["dates", "programme", "schedule"], "end_date": ["dates", "programme", "schedule"], "fee": ["fee", "cost", "tuition"], "location": ["venue", "location", "travel"]}
LINK_WORDS = {"apply": 5, "application": 5, "registration": 4, "fee": 4, "deadline": 4, "programme": 2, "venue": 2, "faq": 1}


def apply_overrides(candidates: DataFrame, overrides: DataFrame, key: str = "source_url") -> DataFrame:
    """Candidates with the overrides that name them by canonical URL, title or part of it.

    One ``exclude`` drops the row. The others apply in their order: the last to name a field sets it, and an
    entry with a null value clears it; statuses and notes gather in ``risk_points``. ``overrides`` is a hand-kept list.
    """
    typed = dict(candidates.dtypes)
    rows = candidates.withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    o = overrides.select(*[F.col(c).alias(f"__o_{c}") for c in overrides.columns])
    by_url = (F.col("__o_url") != "") & (urls.canonical_url(F.col(key)) == urls.canonical_url(F.col("__o_url")))
    by_title = (F.col("__o_title") != "") & (F.lower(F.trim("title")) == F.lower(F.trim("__o_title")))
    by_part = (F.col("__o_title_contains") != "") & F.contains(F.lower("title"), F.lower("__o_title_contains"))
    hits = rows.select("__id", key, "title").join(F.broadcast(o), F.coalesce(by_url, F.lit(False)) | F.coalesce(by_title, F.lit(False)) | F.coalesce(by_part, F.lit(False)))
    inner = F.array_sort(F.collect_list(F.struct("__o_ord", "__o_status", "__o_note", F.map_entries(F.coalesce("__o_fields", F.create_map().cast("map<string,string>"))).alias("f"))))
    got = hits.groupBy("__id").agg(F.max(F.lower("__o_status") == "exclude").alias("__out"), inner.alias("__all"))
    joined = rows.join(got, "__id", "left").filter(~F.coalesce("__out", F.lit(False)))
    entries = F.flatten(F.transform(F.coalesce("__all", F.array().cast(dict(got.dtypes)["__all"])), lambda s: s["f"]))
    last = lambda name: F.try_element_at(F.filter(entries, lambda e: e["key"] == name), F.lit(-1))["value"]
    named = lambda name: F.exists(entries, lambda e: e["key"] == name)
    notes = F.array_join(F.filter(F.transform("__all", lambda s: s["__o_note"]), lambda n: n != ""), "; ")
    out = []
    for c, kind in typed.items():
        if c == "risk_points":
            value = F.when(F.coalesce(notes, F.lit("")) != "", F.concat_ws("; ", F.nullif(F.col(c), F.lit("")), notes)).otherwise(F.col(c))
        else:
            given = F.split(last(c), r",\s*").cast(kind) if kind.startswith("array") else last(c).try_cast(kind)
            value = F.when(named(c), given).otherwise(F.col(c))
        out.append(value.alias(c))
    return joined.select(*out)


def best_items(items: DataFrame) -> DataFrame:
    """Each page's best model item: by confidence, then fewer warnings, then score; of equals the first by ``ord``, which may be a struct."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    order = [F.desc("__worth"), F.asc_nulls_last("__warned"), F.desc("score"), F.asc_nulls_last("ord")]
    keyed = items.select(urls.canonical_url(F.col("page_url")).alias("__key"), F.struct(*items.columns).alias("__item"), rank.alias("__worth"), F.size("warnings").alias("__warned"), "score", "ord")
    return top_per_group(keyed, ["__key"], order, 1).select("__key", "__item")


def enrich_unresolved(candidates: DataFrame, items: DataFrame, as_of: Column) -> DataFrame:
    """Candidates whose open questions an item of the same page answers: place, mode, dates, deadline and status. What is known stays.

    ``items`` has ``page_url, ord, confidence, warnings, score`` and ``location, mode, start_date, end_date,
    deadline, status``. A candidate meets an item by its source, else by its application link.
    """
    best = best_items(items)
    direct = candidates.withColumn("__key", urls.canonical_url(F.col("source_url"))).join(best, "__key", "left").drop("__key")
    other = best.select(F.col("__key"), F.col("__item").alias("__via"))
    rows = direct.withColumn("__key", urls.canonical_url(F.col("application_link"))).join(other, "__key", "left").drop("__key")
    i = F.coalesce("__item", "__via")
    start, end = F.coalesce("start_date", i["start_date"]), F.coalesce("end_date", i["end_date"])
    take_deadline = i["deadline"].isNotNull() & (F.col("deadline").isNull() | (F.col("deadline_status") == "uncertain"))
    deadline = F.when(take_deadline, i["deadline"]).otherwise(F.col("deadline"))
    said = F.coalesce(i["status"], F.lit(""))
    status = F.when(said.isin("closed", "not_open"), said).when((F.col("deadline_status") == "uncertain") & (said == "open"), "open").when(i.isNotNull() & (deadline < as_of), "closed").otherwise(F.col("deadline_status"))
    new = {
        "location": F.when(F.lower(F.trim("location")).isin(COARSE_PLACES) & (F.coalesce(i["location"], F.lit("")) != ""), i["location"]).otherwise(F.col("location")),
        "mode": F.when((F.col("mode") == "uncertain") & i["mode"].isin("in-person", "hybrid", "online"), i["mode"]).otherwise(F.col("mode")),
        "start_date": start, "end_date": end, "duration_days": F.when(i.isNotNull() & start.isNotNull() & end.isNotNull(), F.greatest(F.datediff(end, start) + 1, F.lit(1))).otherwise(F.col("duration_days")),
        "deadline": deadline, "deadline_status": status,
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in candidates.columns])


def unmatched_items(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best items whose page no candidate has as source or application link: possible new records."""
    known = candidates.select(F.explode(F.array(urls.canonical_url(F.col("source_url")), urls.canonical_url(F.col("application_link")))).alias("__key")).filter("__key <> ''").distinct()
    return best_items(items).join(known, "__key", "left_anti").select("__item.*").filter(~F.exists("warnings", lambda w: w.isin(*FINAL_WARNINGS)))


def wants_follow_up(warnings: Column, title: Column, status: Column, missing: Column) -> Column:
    """An item with a title and open questions, not closed, whose warnings do not end the matter."""
    ended = F.exists(warnings, lambda w: w.isin(*FINAL_WARNINGS) | w.startswith("llm_unavailable:"))
    return ~ended & ~F.lower(F.trim(F.coalesce(title, F.lit("")))).isin("", "unknown") & (F.coalesce(status, F.lit("")) != "closed") & (F.size(missing) > 0)


def follow_up_links(pages: DataFrame, limit: int = 4) -> DataFrame:
    """Links of each page (``url, links`` of ``href, label``; ``missing`` fields) on its own domain that may answer: ``url, href, score``, best first and then by address."""
    rows = pages.select("url", "missing", F.explode("links").alias("l")).select("url", "missing", urls.follow_up_url(F.col("l.href")).alias("href"), F.lower(F.concat_ws(" ", "l.label", "l.href")).alias("hay"))
    rows = rows.filter(urls.fetchable(F.col("href"), urls.SOCIAL_HOSTS) & urls.same_domain(F.col("url"), F.col("href")) & (F.col("href") != urls.follow_up_url(F.col("url"))))
    general = sum((F.when(F.contains("hay", F.lit(w)), n).otherwise(0) for w, n in LINK_WORDS.items()), F.lit(0))
    wanted = F.array_distinct(F.flatten(F.transform("missing", lambda f: F.coalesce(F.element_at(F.create_map(*[x for k, v in FIELD_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), f), F.array().cast("array<string>")))))
    scored = rows.withColumn("score", general + 4 * F.size(F.filter(wanted, lambda t: F.contains(F.col("hay"), t)))).filter("score > 0").groupBy("url", "href").agg(F.max("score").alias("score"))
    return top_per_group(scored, ["url"], [F.desc("score"), F.asc("href")], limit)


def crawl(start: DataFrame, fetch: Callable[[DataFrame], DataFrame], rounds: int = 2, per_parent: int = 4, total: int = 60) -> DataFrame:
    """Pages reached from ``start`` (``url, html, missing``) in at most ``rounds`` rounds: ``parent, url, html``.

    ``fetch`` takes distinct ``url`` rows and returns ``url, html``. Each page passes its parent on, no parent gets
    more than ``per_parent`` pages and all together no more than ``total``; a page is fetched once.
    """
    from scoutflow.operators.extract import parsed_page

    frontier = start.select(F.col("url").alias("parent"), "url", "html", "missing")
    seen, found, left = start.select("url").distinct(), None, total
    for _ in range(rounds):
        if left <= 0:
            break
        parsed = frontier.select("parent", "url", "missing", parsed_page(F.col("html"))["links"].alias("links"))
        links = follow_up_links(parsed.select("url", "missing", "links"), per_parent).join(frontier.select("parent", "url", "missing"), "url")
        fresh = links.select("parent", F.col("href").alias("url"), "score", "missing").join(seen, "url", "left_anti")
        once = fresh.groupBy("url").agg(F.min_by(F.struct("parent", "missing", "score"), F.struct(-F.col("score"), "parent")).alias("b")).select("url", "b.*")
        taken = found.groupBy("parent").agg(F.count(F.lit(1)).alias("n")) if found is not None else None
        capped = top_per_group(once, ["parent"], [F.desc("score"), F.asc("url")], per_parent)
        if taken is not None:
            capped = capped.join(taken, "parent", "left").filter(F.col("rank") <= per_parent - F.coalesce("n", F.lit(0)))
        asked = capped.orderBy(F.desc("score"), "url").limit(left).select("parent", "url", "missing").checkpoint()
        got = asked.join(fetch(asked.select("url")).select("url", "html"), "url").filter("html is not null").select("parent", "url", "html", "missing").checkpoint()
        n = got.count()
        found = got if found is None else found.unionByName(got)
        seen, frontier, left = seen.union(asked.select("url")), got, left - n
        if not n:
            break
    return found.select("parent", "url", "html") if found is not None else start.select(F.col("url").alias("parent"), "url", "html").limit(0)


def missing_fields(item: Column) -> Column:
    """Critical fields of an item struct that are unknown."""
    return F.array_compact(F.array(*[F.when(F.lower(F.trim(F.coalesce(item[f].cast("string"), F.lit("")))).isin("", "unknown"), F.lit(f)) for f in CRITICAL]))


def refinement_queries(title: Column, host: Column, missing: Column) -> Column:
    """Search queries for what is missing, one a field."""
    return F.transform(missing, lambda f: F.concat_ws(" ", tx.clean_space(title), F.replace(f, F.lit("_"), F.lit(" ")), F.concat(F.lit("site:"), host)))

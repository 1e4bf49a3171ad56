"""What goes to a model and what may be believed of its replies.

An item's ``fields`` map names to ``value, texts`` (the texts of the evidence that the value names).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.functions import urls
from scoutflow.operators import semantic
from scoutflow.operators.topk import top_per_group
from scoutflow.operators.validation import known

EVIDENCE_CHARS, SNIPPET_CHARS, PREVIEW_CHARS = 1200, 500, 500
MEMBERS = ["page_url", "page_title", "source_name", "chunk_index", "text", "score"]
CHUNK = "struct<page_url:string,page_title:string,source_name:string,chunk_index:int,text:string,score:double>"
# Warnings that take the trust from one field, whatever its evidence.
WEAK = {
    "application_deadline": ["deadline_context_weak", "non_application_deadline_risk"],
    "fee": ["fee_context_weak", "fee_value_not_in_evidence"],
    "funding": ["funding_context_weak"],
    "location": ["location_context_weak"],
    "eligibility": ["eligibility_context_weak"],
}
OPPORTUNITY_TYPES = ["opportunity", "application", "fees", "funding"]
OPERATIONAL = ["llm_unavailable:", "llm_json_parse_failed", "llm_request_truncated:", "llm_chunk_truncated:", "deepseek_"]
SIGNAL_FIELDS = ["title", "event_type", "application_deadline", "start_date", "end_date", "location"]


def cache_key(url: Column, text: Column, settings: dict) -> Column:
    """A key of a page's URL, its cleaned text and all settings of the ranking."""
    return F.sha2(F.concat_ws("\n", F.coalesce(url, F.lit("")), F.sha2(tx.clean_space(F.coalesce(text, F.lit(""))), 256), F.lit(json.dumps(settings, sort_keys=True))), 256)


def ranked_through_cache(pages: DataFrame, cache: DataFrame, settings: dict, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``key, page_url, cached, chunks`` of each page (``url, text`` and what ``rank`` needs).

    ``cache`` is ``key, chunks`` (arrays of ``CHUNK``); an entry that lacks a value of any chunk counts as no entry. Only
    pages without one go through ``rank``, which gives chunks with ``page_url``. Rows with ``cached`` false are the new
    entries; a page without useful chunks has an empty array, so it is not ranked again. Each URL stands once in ``pages``.
    """
    keyed = pages.withColumn("key", cache_key(F.col("url"), F.col("text"), settings))
    whole = F.forall("chunks", lambda c: reduce(Column.__and__, [c[n].isNotNull() for n in MEMBERS]))
    usable = cache.filter(F.coalesce(whole, F.lit(False))).select("key", "chunks")
    hits = keyed.select("key", F.col("url").alias("page_url")).join(usable, "key").select("key", "page_url", F.lit(True).alias("cached"), "chunks")
    misses = keyed.join(usable.select("key"), "key", "left_anti")
    one = F.struct(*MEMBERS[:3], F.col("chunk_index").cast("int").alias("chunk_index"), "text", F.col("score").cast("double").alias("score"))
    fresh = rank(misses.drop("key")).groupBy("page_url").agg(F.collect_list(one).alias("chunks"))
    new = misses.select("key", F.col("url").alias("page_url")).join(fresh, "page_url", "left")
    by_score = lambda c: F.array_sort(c, lambda a, b: F.when(a["score"] != b["score"], F.signum(b["score"] - a["score"]).cast("int")).otherwise(a["chunk_index"] - b["chunk_index"]))
    made = F.coalesce(by_score(F.col("chunks")), F.array().cast(f"array<{CHUNK}>"))
    return hits.unionByName(new.select("key", "page_url", F.lit(False).alias("cached"), made.alias("chunks")))


def page_batches(chunks: DataFrame, pages: int, per_page: int) -> DataFrame:
    """The best ``per_page`` chunks of the ``pages`` pages whose best chunk scores highest (equal ones by URL), with the chunk's ``rank`` in its page."""
    best = chunks.groupBy("page_url").agg(F.max("score").alias("page_score"))
    first = best.orderBy(F.desc("page_score"), "page_url").limit(pages)
    return top_per_group(chunks.join(first, "page_url"), ["page_url"], [F.desc("score"), F.col("chunk_index")], per_page)


def with_follow_ups(base: DataFrame, follow_ups: DataFrame, edges: DataFrame, per_parent: int) -> DataFrame:
    """Chunks to read again: all of each parent's own and the best ``per_parent`` of the pages that ``edges`` (``parent, url``) found for it.

    They carry the parent's URL and title, a new ``chunk_index`` from 0 (own ones first, each kind by score) and the page they come from in the text.
    """
    norm = lambda c: urls.follow_up_url(F.col(c))
    parents = edges.select("parent", norm("parent").alias("__key")).distinct()
    own = base.select(*MEMBERS, norm("page_url").alias("__key")).join(parents, "__key").withColumn("__kind", F.lit(0)).drop("__key")
    links = edges.select("parent", norm("url").alias("__key")).distinct()
    order = [F.desc("score"), F.col("page_url"), F.col("chunk_index")]
    # What is not among a page's best is not among those of a parent either, so no more of a page than that meets the parents.
    best = top_per_group(follow_ups.select(*MEMBERS, norm("page_url").alias("__key")), ["__key"], order, per_parent).drop("rank")
    found = best.join(links, "__key").drop("__key")
    both = own.unionByName(top_per_group(found, ["parent"], order, per_parent).drop("rank").withColumn("__kind", F.lit(1)))
    by = W.partitionBy("parent").orderBy("__kind", *order)
    lead = lambda c: F.first(c).over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.select(
        F.col("parent").alias("page_url"), lead("page_title").alias("page_title"), lead("source_name").alias("source_name"), (F.row_number().over(by) - 1).alias("chunk_index"),
        F.concat(F.lit("[Official source page: "), "page_url", F.lit("] "), "text").alias("text"), "score",
    )


def first_by_page(pages: DataFrame, candidates: DataFrame, order: str) -> DataFrame:
    """``pages`` (``page_url``) with ``first``, the least ``order`` among candidates that have the page as source or application link; null without one."""
    keys = candidates.select(order, F.explode(F.array_distinct(F.array("source_url", "application_link"))).alias("page_url")).filter("page_url <> ''")
    return pages.join(keys.groupBy("page_url").agg(F.min(order).alias("first")), "page_url", "left")


def evidence_text(texts: Column) -> Column:
    return F.substring(tx.clean_space(F.array_join(F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda t: t != ""), " ")), 1, EVIDENCE_CHARS)


def blocked(field: str, warnings: Column) -> Column:
    """Whether warnings say that the field's value lacks support."""
    starts = [f"missing_evidence_id:{field}", f"evidence_id_not_found:{field}", f"{field}_value_not_in_evidence"]
    return F.exists(warnings, lambda w: F.exists(F.array(*map(F.lit, starts)), lambda s: F.startswith(w, s)) | w.isin(*WEAK.get(field, [""])))


def trusted(fields: Column, field: str, warnings: Column) -> Column:
    """A field's value where it is known, has evidence and is not blocked; else empty."""
    entry = F.try_element_at(fields, F.lit(field))
    held = known(entry["value"]) & (evidence_text(entry["texts"]) != "") & ~F.coalesce(blocked(field, warnings), F.lit(False))
    return F.when(held, tx.clean_space(entry["value"])).otherwise("")


def trusted_day(fields: Column, field: str, warnings: Column) -> Column:
    return F.try_to_date(F.regexp_extract(trusted(fields, field, warnings), r"^(\d{4}-\d{2}-\d{2})$", 1), "yyyy-MM-dd")


def trusted_status(fields: Column, warnings: Column, as_of: Column) -> Column:
    """The stated status where it is one of the known ones, else what the deadline says, else ``uncertain``."""
    said = F.lower(trusted(fields, "registration_status", warnings))
    due = trusted_day(fields, "application_deadline", warnings)
    return F.when(said == "not_yet_open", "not_open").when(said.isin("open", "closed", "not_open"), said).when(due >= as_of, "open").when(due < as_of, "closed").otherwise("uncertain")


def model_warnings(warnings: Column, page_type: Column) -> Column:
    """A model's own warnings without blank ones; a page that it calls an opportunity is not also a listing."""
    kind = F.lower(tx.clean_space(F.coalesce(page_type, F.lit(""))))
    return F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: (F.trim(w) != "") & ~(kind.isin(*OPPORTUNITY_TYPES) & (w == "index_or_listing_page")))


def operational_warnings(warnings: Column) -> Column:
    """Warnings about the run, which a cached reply keeps."""
    return F.filter(F.coalesce(warnings, F.array().cast("array<string>")), lambda w: F.exists(F.array(*map(F.lit, OPERATIONAL)), lambda s: F.startswith(w, s)))


def worth_a_look(matched: Column, warnings: Column, fields: Column) -> Column:
    """Whether an item that no candidate matches may be a missed one: it has a warning, or evidence for one of the telling fields."""
    backed = [evidence_text(F.try_element_at(fields, F.lit(f))["texts"]) != "" for f in SIGNAL_FIELDS]
    warned = F.size(F.coalesce(warnings, F.array().cast("array<string>"))) > 0
    return ~F.coalesce(matched, F.lit(False)) & reduce(Column.__or__, backed, warned)


def preview(text: Column, limit: int = PREVIEW_CHARS) -> Column:
    """At most ``limit`` characters of the cleaned text around the first word that speaks of an opportunity, else its beginning."""
    before = min(120, max(0, limit // 3))

    def cut(t: Column) -> Column:
        core, kind = F.regexp_instr(t, F.lit(semantic.CORE_HINTS)), F.regexp_instr(t, F.lit(semantic.TYPE_HINTS))
        start = F.greatest(F.when(core > 0, core).when(kind > 0, kind).otherwise(1) - before, F.lit(1))
        part = F.trim(F.substr(t, start, F.lit(limit)))
        return F.when(F.length(t) <= limit, t).otherwise(F.substring(F.when(start > 1, F.concat(F.lit("..."), part)).otherwise(part), 1, limit))

    return tx.let(tx.clean_space(F.coalesce(text, F.lit(""))), cut)


def public_snippets(snippets: Column) -> Column:
    """Snippets with what may be shown: id, page, cleaned and cut text, signals."""
    blank = F.lit("")
    return F.transform(
        snippets, lambda s: F.struct(F.coalesce(s["id"], blank).alias("id"), F.coalesce(s["page_url"], blank).alias("page_url"), F.substring(tx.clean_space(F.coalesce(s["text"], blank)), 1, SNIPPET_CHARS).alias("text"), F.coalesce(s["signals"], F.array().cast("array<string>")).alias("signals"))
    )

"""Audits of extraction runs: what a run holds, what second looks gained, where two runs differ, and whether output may go out.

Items have ``page_url, page_title, confidence, warnings`` (array) and ``fields``, a map from names to a value and the
ids of its evidence. A null map or array is an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.operators.compare import known

# The fields that an audit counts, and warnings by which a step says that it did not work.
CRITICAL = ["application_deadline", "fee", "funding", "application_url", "start_date", "end_date", "location"]
RANKING_FAILED = ["semantic_ranking_skipped:"]
EXTRACTION_FAILED = ["llm_endpoint_unavailable", "llm_endpoint_unavailable:", "llm_json_parse_failed", "llm_skipped:"]
ITEM_FAILED = ["llm_unavailable:", "llm_json_parse_failed"]
TRANSLATION_FAILED = ["translation_provider_unavailable:", "candidate_translation_failed:", "source_translation_provider_unavailable:", "source_translation_failed:"]
KINDS = ["semantic", "extraction", "translation"]
VERSION, LEGACY_VERSIONS = 2, [1]

NOT_STATED = "not stated"

NO_TEXT = "array<string>"
SESSIONS = "array<struct<name:string,start_date:string,end_date:string,application_deadline:string>>"
DATE_FIELDS = ["start_date", "end_date", "deadline", "first_seen"]
LIST_FIELDS = ["funding_type", "topic_keywords", "failed_hard_conditions", "score_explanation"]
TEXT_FIELDS = ["title", "source_url", "organizer", "location", "mode", "fee", "application_link", "deadline_status", "source_layer"]


def warning_type(warning: Column) -> Column:
    """What stands before the first colon."""
    return F.coalesce(F.nullif(F.trim(F.split_part(warning, F.lit(":"), F.lit(1))), F.lit("")), F.lit("unknown_warning"))


def histograms(items: DataFrame) -> DataFrame:
    """``kind, name, n``: warnings by type and items by confidence (``unknown`` where none is stated)."""
    warned = items.select(F.explode("warnings").alias("w")).select(F.lit("warning").alias("kind"), warning_type(F.col("w")).alias("name"))
    stated = F.coalesce(F.nullif(tx.clean_space(F.col("confidence")), F.lit("")), F.lit("unknown"))
    return warned.unionByName(items.select(F.lit("confidence").alias("kind"), stated.alias("name"))).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def _entries(fields: list[str], column: str = "fields") -> Column:
    """One struct ``field, value, ids`` for each named field; blank ids are none."""

    def entry(name: str) -> Column:
        e = F.try_element_at(column, F.lit(name))
        ids = F.filter(F.coalesce(e["ids"], F.array().cast(NO_TEXT)), lambda i: F.trim(i) != "")
        return F.struct(F.lit(name).alias("field"), tx.clean_space(F.coalesce(e["value"], F.lit(""))).alias("value"), ids.alias("ids"))

    return F.array(*[entry(f) for f in fields])


def field_audit(items: DataFrame, fields: list[str] = CRITICAL) -> DataFrame:
    """One row a field: items that know it (``n_known``), of these without evidence (``n_bare``), their evidence ids (``n_ids``), and what second looks gained (``n_gained``).

    A field is gained where ``missing_before`` (array) names it, the item was looked at again (``re_extracted``) and knows it now.
    """
    rows = items.select(F.explode(_entries(fields)).alias("e"), "missing_before", "re_extracted").select("e.*", "missing_before", "re_extracted")
    some = known(F.col("value")) & (F.lower("value") != NOT_STATED)
    gained = some & F.coalesce("re_extracted", F.lit(False)) & F.coalesce(F.array_contains("missing_before", F.col("field")), F.lit(False))
    return rows.groupBy("field").agg(
        F.count_if(some).alias("n_known"),
        F.count_if(some & (F.size("ids") == 0)).alias("n_bare"),
        F.coalesce(F.sum(F.when(some, F.size("ids"))), F.lit(0)).cast("long").alias("n_ids"),
        F.count_if(gained).alias("n_gained"),
    )


def last_by_page(items: DataFrame, order: str) -> DataFrame:
    """The last item of each page by ``order``; blank addresses are none."""
    named = items.withColumn("page_url", F.trim("page_url")).filter("page_url <> ''")
    rest = [c for c in items.columns if c != "page_url"]
    return named.groupBy("page_url").agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select("page_url", "x.*")


def disagreements(left: DataFrame, right: DataFrame, fields: list[str] = CRITICAL) -> DataFrame:
    """``page_url, page_title, field, left_value, right_value`` of fields in which two runs (one item a page) differ, or that one alone knows."""
    a = left.select("page_url", F.col("page_title").alias("lt"), _entries(fields).alias("l"))
    b = right.select("page_url", F.col("page_title").alias("rt"), _entries(fields).alias("r"))
    title = F.coalesce(F.nullif("lt", F.lit("")), F.nullif("rt", F.lit("")), "page_url")
    both = a.join(b, "page_url").select("page_url", title.alias("page_title"), F.explode(F.arrays_zip("l", "r")).alias("z"))
    rows = both.select("page_url", "page_title", F.col("z.l.field").alias("field"), F.col("z.l.value").alias("left_value"), F.col("z.r.value").alias("right_value"))
    l, r = known(F.col("left_value")), known(F.col("right_value"))
    return rows.filter((l != r) | l & r & (F.lower("left_value") != F.lower("right_value")))


def starts_with_any(warnings: Column, prefixes: list[str]) -> Column:
    """Whether a warning begins with one of the prefixes that end in a colon, or is equal to another."""

    def one(w: Column) -> Column:
        tests = [F.startswith(w, F.lit(p)) if p.endswith(":") else w == p for p in prefixes]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return F.coalesce(F.exists(warnings, one), F.lit(False))


def usable(fields: Column, warnings: Column, names: list[str]) -> Column:
    """Whether an item did not fail and has one named field with a value, an evidence id and a text for it (``value, ids, texts``)."""

    def backed(name: str) -> Column:
        e = F.try_element_at(fields, F.lit(name))
        filled = lambda a: F.exists(a, lambda x: F.trim(x) != "")
        value = F.lower(F.trim(e["value"]))
        return F.coalesce((value != "") & (value != "unknown") & filled(e["ids"]) & filled(e["texts"]), F.lit(False))

    some = F.lit(False)
    for n in names:
        some = some | backed(n)
    failed = F.exists(warnings, lambda w: F.startswith(w, F.lit(ITEM_FAILED[0])) | (w == ITEM_FAILED[1]))
    return some & warnings.isNotNull() & ~F.coalesce(failed, F.lit(False))


def publish_gate(outputs: DataFrame, as_of: Column, provider: str) -> DataFrame:
    """``run, kind, reason`` for each run and each of ``KINDS``: why the run's output of that kind may not go out, empty where it may.

    ``outputs`` has ``run, kind, generated, provider, enabled, warnings, n_items, n_usable``; a run that lacks a kind has it ``missing``.
    """
    asked = outputs.select("run").distinct().select("run", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    rows = asked.join(outputs.withColumn("there", F.lit(True)), ["run", "kind"], "left")
    kind, mine = F.col("kind"), F.lower(F.trim(F.coalesce("provider", F.lit("")))) == provider
    reason = (
        F.when(F.col("there").isNull(), "missing")
        .when(~F.col("generated").eqNullSafe(as_of), "stale")
        .when((kind == "translation") & ~F.coalesce("enabled", F.lit(False)), "disabled")
        .when((kind != "semantic") & ~mine, "wrong_provider")
        .when(F.col("warnings").isNull(), "invalid_warnings")
        .when((kind == "semantic") & ((F.coalesce("n_items", F.lit(0)) == 0) | starts_with_any(F.col("warnings"), RANKING_FAILED)), "operational_failure")
        .when((kind == "extraction") & starts_with_any(F.col("warnings"), EXTRACTION_FAILED), "operational_failure")
        .when((kind == "extraction") & (F.coalesce("n_usable", F.lit(0)) == 0), "nothing_usable")
        .when((kind == "translation") & starts_with_any(F.col("warnings"), TRANSLATION_FAILED), "operational_failure")
        .otherwise("")
    )
    return rows.select("run", "kind", reason.alias("reason"))


def snapshot_reason(version: Column, shown: Column, scanned: Column, legacy: bool = False) -> Column:
    """Why a snapshot with these counts (null: the list is missing) is refused, empty where it is not. Old versions pass only as baselines (``legacy``)."""
    return (
        F.when(~F.coalesce(version.isin(VERSION, *(LEGACY_VERSIONS if legacy else [])), F.lit(False)), "unsupported_version")
        .when(shown.isNull(), "invalid_opportunities")
        .when(shown == 0, "no_opportunities")
        .when(scanned == 0, "no_scanner_opportunities")
        .when(scanned.isNull() & (version == VERSION), "missing_scanner_opportunities")
        .otherwise("")
    )


def decoded(rows: DataFrame, body: str = "body") -> DataFrame:
    """``rows`` with the record in the JSON text ``body``, field by field, and ``bad``: fields whose value could not be read (``record`` for the whole text).

    Missing fields get their defaults: texts are empty, lists without elements, scores 0, the rest null. Sessions
    need a name, a start and an end that is not before it. A value that cannot be read counts as missing.
    """
    # Reading into a map keeps each value's own JSON text, so that one odd value does not void the record.
    raw = rows.withColumn("__m", F.from_json(body, "map<string,string>"))
    at = lambda f: F.try_element_at("__m", F.lit(f))
    filled = lambda f: F.coalesce(F.trim(at(f)) != "", F.lit(False))
    day = lambda v: F.try_to_date(v, "yyyy-MM-dd")
    out: dict[str, Column] = {f: F.coalesce(at(f), F.lit("")) for f in TEXT_FIELDS}
    out |= {f: day(at(f)) for f in DATE_FIELDS}
    out |= {f: F.coalesce(F.from_json(at(f), NO_TEXT), F.array().cast(NO_TEXT)) for f in LIST_FIELDS}
    out["duration_days"], out["fee_eur"] = at("duration_days").try_cast("int"), at("fee_eur").try_cast("double")
    out |= {f: F.coalesce(at(f).try_cast("double"), F.lit(0.0)) for f in ("score", "extraction_confidence")}
    out["funding_available"] = F.when(at("funding_available").isNotNull(), ~at("funding_available").isin("false", "0", "", "[]", "{}"))
    read = F.transform(F.from_json(at("sessions"), SESSIONS), lambda s: F.struct(F.trim(s["name"]).alias("name"), day(s["start_date"]).alias("start_date"), day(s["end_date"]).alias("end_date"), day(s["application_deadline"]).alias("application_deadline")))
    whole = F.filter(read, lambda s: F.coalesce((s["name"] != "") & (s["end_date"] >= s["start_date"]), F.lit(False)))
    out["sessions"] = F.coalesce(whole, F.array().cast("array<struct<name:string,start_date:date,end_date:date,application_deadline:date>>"))
    unread = [F.when(filled(f) & out[f].isNull(), f) for f in [*DATE_FIELDS, "duration_days", "fee_eur"]]
    unread += [F.when(filled(f) & at(f).try_cast("double").isNull(), f) for f in ("score", "extraction_confidence")]
    bad = F.array_compact(F.array(F.when(F.col("__m").isNull() | (F.size("__m") == 0), "record"), *unread))
    return raw.select(*rows.columns, *[c.alias(n) for n, c in out.items()], bad.alias("bad"))


def topics_in(text: Column, topics: list[str]) -> Column:
    """The topics that stand in a text as whole words of any script, in their order."""
    import re

    whole = lambda t: rf"(?iU)(?<!\w){re.escape(t.lower())}(?!\w)"
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(whole(t)), F.lit(t)) for t in topics]))

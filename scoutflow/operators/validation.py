"""Warnings for what a model says of a page, against the snippets that it cites, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import dates, money
from scoutflow.functions import text as tx
from scoutflow.functions.text import let, staged
from scoutflow.operators.extract import ONE_DATE

# Fields that need evidence, words that show a field's evidence is about it, and what closed, listing and payment pages say.
EVIDENCE_FIELDS = [
    "title", "event_type", "location", "mode", "start_date", "end_date", "application_deadline", "application_deadline_type", "other_deadlines", "registration_status", "fee",
    "funding", "eligibility", "application_url", "topics", "chinese_summary",
]
CONTEXT = {
    "application_deadline": r"(?i)\b(deadline|application|apply|registration|submit|closing|closes)\b",
    "fee": r"(?i)\b(fees?|costs?|rates?|tuition|registration|free|charge|contribution|waived)\b",
    "funding": r"(?i)\b(scholarship|bursary|grant|funding|financial support|waiver|stipend|accommodation|travel support)\b",
    "location": r"(?i)\b(location|venue|campus|hosted|takes place|online|hybrid|in-person|city|country)\b",
    "eligibility": r"(?i)\b(eligible|eligibility|applicants|participants|phd|doctoral|master|postdoc|students|researchers)\b",
}
OVER = (
    r"(?i)\b(archive|previous edition|past event|applications closed|registration closed|application is closed|"
    r"registration is closed|closed for applications)\b"
)
INDEX = r"(?i)\b(index|listing|archive|history|past meetings|past events|overview|all events)\b"
PAYMENT = (
    r"(?i)\b(payment|pay(?:ing|ment)?|invoice|room reservations?|accommodation).{0,50}\b(deadline|before|due|by)\b|"
    r"\b(deadline|before|due|by).{0,50}\b(payment|pay(?:ing|ment)?|invoice|room reservations?|accommodation)\b"
)
APPLICATION = (
    r"(?i)\b(application|applications|apply|registration|register).{0,80}\b(deadline|close|closes|until|due|by)\b|"
    r"\b(deadline|close|closes|until|due|by).{0,80}\b(application|applications|apply|registration|register)\b"
)
CLOSED_WORDS, OPEN_WORDS = r"(?i)\b(application|registration).{0,30}\bclosed\b", r"(?i)\b(now open|applications? open|registration open|now accepting)\b"
NO_FEE = ["no registration fee", "no participation fee", "free of charge", "participation is free"]
OTHER_DEADLINES = ["payment", "scholarship", "travel_grant", "abstract"]
DATED = ["start_date", "end_date", "application_deadline"]
CORRECTED = "registration_status_corrected_from_past_deadline"
FIELDS = "map<string,struct<value:string,ids:array<string>>>"


def known(value: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin("", "unknown")


def date_supported(value: Column, evidence: Column) -> Column:
    """Whether the evidence holds the date as it is written, or the same day in another form."""
    days = F.transform(F.regexp_extract_all(evidence, F.lit(rf"(?i)({ONE_DATE})"), F.lit(1)), dates.parse_date)
    return F.contains(F.lower(tx.clean_space(evidence)), F.lower(tx.clean_space(value))) | F.coalesce(F.array_contains(days, F.try_to_date(value, "yyyy-MM-dd")), F.lit(False))


def priced(text: Column) -> Column:
    """Distinct ``CUR amount`` strings, by code or sign before or after the number."""
    code = r"(EUR|USD|GBP|CHF|CNY|RMB|JPY|INR|KRW|SGD|AUD|CAD|€|\$|£)"
    number = rf"({money.AMOUNT})"
    one = lambda t: F.concat_ws(" ", money.currency(t), money.parse_amount(F.regexp_extract(t, number, 1)).cast("string"))
    found = F.concat(F.regexp_extract_all(text, F.lit(rf"(?i){code}\s*{number}"), F.lit(0)), F.regexp_extract_all(text, F.lit(rf"(?i){number}\s*{code}"), F.lit(0)))
    return F.array_distinct(F.transform(found, one))


def fee_supported(value: Column, evidence: Column, asked: Column, offered: Column) -> Column:
    """Whether the evidence holds a fee: free where it says free, else all amounts that are ``asked``, else the words themselves (``priced`` of both texts)."""
    free = tx.any_term(value, NO_FEE)
    written = F.when(F.size(asked) == 0, F.contains(F.lower(evidence), F.lower(value))).otherwise(F.size(F.array_except(asked, offered)) == 0)
    return F.when(free, tx.any_term(evidence, NO_FEE)).otherwise(written)


def tiers_incomplete(evidence: Column, asked: Column, offered: Column) -> Column:
    return (F.size(asked) >= 2) & (F.size(offered) > F.size(asked)) & evidence.rlike(r"(?i)\b(fees?|tuition|rates?)\b")


def cited(fields: Column, snippets: Column) -> Column:
    """Per field ``struct<value, some, text, lost>``: its trimmed value, whether it has ids, the texts that these name among ``snippets`` (by id and text), and whether one names none."""

    def fact(f: Column) -> Column:
        ids = F.filter(F.coalesce(f["ids"], F.array().cast("array<string>")), lambda i: F.trim(i) != "")
        of = lambda i: F.filter(snippets, lambda s: (s["id"] == i) & s["text"].isNotNull())
        text = lambda found: F.array_join(F.transform(F.flatten(found), lambda s: s["text"]), " ")
        return let(F.transform(ids, of), lambda found: F.struct(F.trim(F.coalesce(f["value"], F.lit(""))).alias("value"), (F.size(found) > 0).alias("some"), text(found).alias("text"), F.exists(found, lambda x: F.size(x) == 0).alias("lost")))

    return F.transform_values(fields, lambda _, f: fact(f))


def validate(items: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """``items`` (``page_url, page_title, page_type, confidence, fields``) with ``warnings`` and the ``confidence`` that they leave.

    ``fields`` maps a name to its value and the ids of its snippets; ``evidence`` has ``page_url, id, text``. A field that is
    missing or null is unknown and asks for nothing. Warnings stand in the order of their rules and once each. An item meets all snippets of its page
    at once, and is judged by those that it cites itself.
    """
    snippets = evidence.groupBy("page_url").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("__snippets"))
    none = F.array().cast("array<struct<id:string,text:string>>")
    said = F.lower(tx.clean_space(F.array_join(F.transform("__snippets", lambda s: s["text"]), " ")))
    rows = staged(items.join(snippets, "page_url", "left"), __facts=cited(F.col("fields"), F.coalesce("__snippets", none)), __said=F.coalesce(said, F.lit("")))
    rows = staged(rows, **{f"__{f}": F.try_element_at("__facts", F.lit(f)) for f in EVIDENCE_FIELDS})
    value = lambda f: F.coalesce(F.col(f"__{f}.value"), F.lit(""))
    some, lost = (lambda f, part=part: F.coalesce(F.col(f"__{f}.{part}"), F.lit(False)) for part in ("some", "lost"))
    text = lambda f: F.coalesce(F.col(f"__{f}.text"), F.lit(""))
    fee, fee_text, due_text = value("fee"), text("fee"), text("application_deadline")
    charged = known(fee) & (fee_text != "")
    rows = staged(rows, __asked=F.when(charged, priced(fee)), __offered=F.when(charged, priced(fee_text)))
    checks: list[Column] = []
    for f in EVIDENCE_FIELDS:
        checks += [
            F.when(~known(value(f)) & some(f), f"unknown_field_has_evidence_id:{f}").when(known(value(f)) & ~some(f), f"missing_evidence_id:{f}"),
            F.when(known(value(f)) & lost(f), f"evidence_id_not_found:{f}"),
        ]
        if f in CONTEXT:
            checks.append(F.when(known(value(f)) & (text(f) != "") & ~text(f).rlike(CONTEXT[f]), f"{'deadline' if f == 'application_deadline' else f}_context_weak"))
    for f in DATED:
        checks.append(F.when(known(value(f)) & (text(f) != "") & ~date_supported(value(f), text(f)), f"{f}_value_not_in_evidence"))
    asked, offered = F.col("__asked"), F.col("__offered")
    checks.append(F.when(charged, F.when(~fee_supported(fee, fee_text, asked, offered), "fee_value_not_in_evidence").when(tiers_incomplete(fee_text, asked, offered), "fee_tiers_incomplete")))
    checks.append(F.when((due_text != "") & due_text.rlike(PAYMENT) & ~due_text.rlike(APPLICATION) | F.lower(value("application_deadline_type")).isin(OTHER_DEADLINES), "non_application_deadline_risk"))
    status, about = F.lower(value("registration_status")), text("registration_status")
    checks.append(F.when((status == "open") & about.rlike(CLOSED_WORDS) | (status == "closed") & about.rlike(OPEN_WORDS), "registration_status_conflict"))
    checks.append(F.when(F.col("__said").rlike(OVER), "possibly_past_or_closed"))
    due, start = F.try_to_date(value("application_deadline"), "yyyy-MM-dd"), F.try_to_date(value("start_date"), "yyyy-MM-dd")
    later = F.exists(F.regexp_extract_all("__said", F.lit(r"\b20\d{2}\b"), F.lit(0)), lambda y: y.cast("int") > F.year(as_of))
    checks += [F.when(due < as_of, "deadline_past"), F.when((start < as_of) & ~later, "event_past")]
    kind = F.lower(F.trim(F.coalesce("page_type", F.lit(""))))
    listing = (kind == "index") | kind.isin("", "unknown") & F.concat_ws(" ", value("title"), "page_title").rlike(INDEX)
    checks.append(F.when(listing & (known(value("start_date")) | known(value("end_date")) | known(value("location"))), "index_page_specific_field_risk"))
    judged = staged(rows, warnings=F.array_distinct(F.array_compact(F.array(*checks))))
    return judged.withColumn("confidence", confidence(F.col("confidence"), F.col("warnings"))).select(*items.columns, "warnings")


def confidence(stated: Column, warnings: Column) -> Column:
    """High with warnings is medium; anything else with warnings is low."""
    some = F.size(warnings) > 0
    return F.when(~some, stated).when(stated == "high", "medium").otherwise("low")


def reconciled(validated: DataFrame, as_of: Column) -> DataFrame:
    """A deadline that has passed closes the registration, on the deadline's evidence, with a warning that says so."""
    due = F.try_element_at("fields", F.lit("application_deadline"))
    passed = F.coalesce(F.try_to_date(due["value"], "yyyy-MM-dd") < as_of, F.lit(False)) & (F.lower(F.coalesce(F.try_element_at("fields", F.lit("registration_status"))["value"], F.lit(""))) != "closed")
    closed = F.struct(F.lit("closed").alias("value"), due["ids"].alias("ids"))
    rest = F.map_filter("fields", lambda k, _: k != "registration_status")
    fields = F.when(passed, F.map_concat(rest, F.create_map(F.lit("registration_status"), closed))).otherwise(F.col("fields"))
    warnings = F.when(passed, F.array_distinct(F.concat("warnings", F.array(F.lit(CORRECTED))))).otherwise(F.col("warnings"))
    return validated.withColumn("__passed", passed).withColumn("warnings", F.when(F.col("__passed"), warnings).otherwise(F.col("warnings"))).withColumn("fields", fields).drop("__passed")


# What speaks for a programme page, and titles, paths and words that speak against one.
PROGRAMME = (
    r"(?i)\b(summer|winter|spring|autumn|seasonal|training|field|doctoral|research) school\b|"
    r"\b(short|advanced) course\b"
)
GENERIC_TITLE = (
    r"(?i)^(home|events?|news(?: & events)?|[\w .&-]+(?:university|institute|centre|center))$|"
    r"\b(summer schools|training schools|course catalogue|calendar of events|scientific calendar|"
    r"testimonials|scholarships|funding opportunities|grant opportunities|people|staff directory)\b"
)
GENERIC_PATH = (
    r"(?i)/(?:category|tag|people|staff|news|events|calendar|archive|testimonials|scholarships?)(?:/|$)|"
    r"/(?:summer-schools|training-schools|short-course-catalogue)/?$"
)
DETAIL = (
    r"(?i)\b(application deadline|applications? (?:are|is|open|close|closed)|apply(?: now| by)?|"
    r"registration|register|programme dates|program dates|course dates|fee|tuition|funding|"
    r"scholarship|bursary|eligibility|participants?)\b"
)


def page_reason(url: Column, title: Column, text: Column, all_past: Column, as_of: Column) -> Column:
    """Why a page is not worth a model's time, by the first rule that holds; empty where it may be. ``all_past``: it has candidates, and all are past."""
    from scoutflow.functions import urls

    both = F.concat_ws(" ", tx.clean_space(title), text)
    latest = F.array_max(F.transform(F.regexp_extract_all(both, F.lit(r"\b20\d{2}\b"), F.lit(0)), lambda y: y.cast("int")))
    path = F.coalesce(F.nullif(urls.path(url), F.lit("")), F.lit("/"))
    return (
        F.when(tx.clean_space(title).rlike(GENERIC_TITLE) | path.rlike(GENERIC_PATH), "listing_or_generic_page")
        .when(latest < F.year(as_of), "past_explicit_year")
        .when(F.coalesce(all_past, F.lit(False)), "past_candidate")
        .when(~both.rlike(PROGRAMME), "weak_programme_signal")
        .when(~text.rlike(DETAIL), "weak_detail_signal")
        .otherwise("")
    )


def filter_pages(chunks: DataFrame, candidates: DataFrame, as_of: Column) -> DataFrame:
    """``page_url, reason`` of each page of ``chunks`` (``page_url, page_title, chunk_index, chunk``).

    A page meets the candidates (``source_url, application_link, deadline_status, deadline, start_date``) that have it as source or application link.
    """
    pages = chunks.groupBy("page_url").agg(F.min_by("page_title", "chunk_index").alias("title"), F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("all"))
    past = dates.is_past(F.col("deadline_status"), F.col("deadline"), F.col("start_date"), as_of)
    links = F.array_distinct(F.array_compact(F.array("source_url", F.nullif("application_link", F.lit("")))))
    by_url = candidates.select(F.explode(links).alias("page_url"), past.alias("past")).groupBy("page_url").agg(F.min("past").alias("all_past"))
    text = tx.clean_space(F.array_join(F.transform("all", lambda c: c["chunk"]), " "))
    joined = pages.join(by_url, "page_url", "left")
    return joined.select("page_url", let(text, lambda t: page_reason(F.col("page_url"), F.col("title"), t, F.col("all_past"), as_of)).alias("reason"))


def filter_stats(reasons: DataFrame) -> DataFrame:
    """One row: ``pages_before, pages_after, pages_rejected``."""
    kept = F.count_if(F.col("reason") == "")
    return reasons.agg(F.count(F.lit(1)).alias("pages_before"), kept.alias("pages_after"), (F.count(F.lit(1)) - kept).alias("pages_rejected"))


# What ends a place's value, words that no place begins with, and what only names the field.
PLACE_ENDS = r"(?i)\b(?:Date\s*&\s*Time|Date\s+and\s+Time|Contact|Agenda|Application|Deadline|Funding)\b.*$"
PLACE_PATTERNS = [
    r"(?i)(?:location|venue|place)\s*:\s*([^.;\n]{2,100})",
    r"(?i)hosted in\s+([^.;\n]{2,80})",
    r"(?i)(?:will\s+)?(?:take place|be held)\s+in\s+(.{2,80}?)(?=,?\s+from\b|[.;])",
]
PLACE_NEEDS = [("location", "venue", "place"), ("hosted in",), ("take place", "be held")]  # words of which every match holds one
NO_PLACE_START = ["a", "an", "the", "that", "which"]
PLACE_NAMES = ["host", "hosts", "location", "venue", "place"]


# Words of labels and buttons, which no place has.
NO_PLACE_WORDS = [
    "webinar", "preview", "schedule", "register", "read more", "overview", "agenda", "click here", "learn more", "apply now", "find out", "no location set",
    "no address set",
]


def distinct_parts(value: Column) -> Column:
    """Parts between commas, each once: case and accents make no difference."""
    folded = lambda x: F.collate(x, "UNICODE_CI_AI")

    def once(parts: Column) -> Column:
        return F.array_join(F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, 1, i), lambda y: folded(y) == folded(x))), ", ")

    return F.when(F.contains(value, F.lit(",")), let(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""), once)).otherwise(value)


def clean_place(value: Column) -> Column:
    """A place without what follows it in a block, without marks around it, and with its parts once; empty for fragments, field names and event codes. Virtual ones are ``Online``."""
    cut = F.regexp_replace(F.trim(F.regexp_replace(tx.clean_space(value), PLACE_ENDS, "")), "[ ,;&]+$", "")

    def judged(cut: Column, bare: Column, low: Column) -> Column:
        junk = cut.rlike(r"[\[\]{}|]") | low.isin("", *PLACE_NAMES) | F.split_part(low, F.lit(" "), F.lit(1)).isin(NO_PLACE_START)
        online = F.contains(low, F.lit("virtual")) | F.contains(low, F.lit("online"))
        code = ~F.contains(bare, F.lit(" ")) & bare.rlike(r"\d")
        return F.when(junk, "").when(online, "Online").when(tx.any_term(low, NO_PLACE_WORDS) | code, "").otherwise(distinct_parts(bare))

    trimmed = lambda c: F.trim(F.regexp_replace(c, "^[ :;,.–—-]+|[ :;,.–—-]+$", ""))
    return let(cut, lambda c: let(trimmed(c), lambda bare: let(F.lower(bare), lambda low: judged(c, bare, low))))


def place_of(text: Column, region: Column) -> Column:
    """The place that a text states, else its source's region; Continental Europe is Europe."""
    found = clean_place(tx.first_match(text, PLACE_PATTERNS, PLACE_NEEDS))
    out = F.coalesce(F.nullif(found, F.lit("")), region, F.lit(""))
    return F.when(F.lower(F.trim(out)) == "continental europe", "Europe").otherwise(out)

"""From page to candidate record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import dates, money
from scoutflow.functions import text as tx
from scoutflow.functions.text import staged
from scoutflow.functions.urls import host, host_matches
from scoutflow.operators import extract, fees, filters, places, sessions, structured, validation
from scoutflow.operators.deadlines import chosen_deadline, deadline_evidence, deadlines

# What an adapter may give; other facts always come from the page's text.
GIVEN = {
    "start": "date", "end": "date", "deadline": "date", "deadline_evidence": "string", "fee": "string", "title": "string", "location": "string", "application_link": "string",
    "sessions": sessions.SESSION, "funding_type": "array<string>",
}
# Reads a parsed page (see ``extract.parsed_page``); null where it has nothing to say.
Adapter = Callable[[Column], dict[str, Column]]
# Classes of calendar pages with machine-readable dates.
CALENDAR_STARTS = ["tribe-events-start-date", "dtstart"]
CALENDAR_ENDS = ["tribe-events-end-date", "dtend"]
CALENDAR_PLACES = [["tribe-venue"], ["tribe-venue-location", "tribe-address"]]
CALENDAR_LINK = ["tribe-events-event-url"]
CLASSES = [*CALENDAR_STARTS, *CALENDAR_ENDS, *sum(CALENDAR_PLACES, []), *CALENDAR_LINK]
ELIGIBILITY = [
    r"(?i)(?:eligibility|eligible participants|who should apply)[:\s-]+([^.;\n]{20,220})",
    r"(?i)((?:PhD|doctoral|MSc|master|postdoc|early-career)[^.;\n]{0,160})",
]
LISTING = 3


def events_calendar(page: Column) -> dict[str, Column]:
    """A page of one event whose dates stand in marked elements; a list of several is none."""
    of = lambda classes: F.filter(page["marked"], lambda m: F.arrays_overlap(m["classes"], F.array(*map(F.lit, classes))))
    dated = lambda classes: F.filter(of(classes), lambda m: (m["tag"] == "abbr") & m["title"].isNotNull())
    day = lambda classes: F.try_to_date(F.regexp_extract(F.get(dated(classes), F.lit(0))["title"], r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd")
    one = F.size(dated(CALENDAR_STARTS)) == 1
    start = F.when(one, day(CALENDAR_STARTS))
    text = lambda classes: F.trim(F.replace(F.split_part(F.get(of(classes), F.lit(0))["text"], F.lit("+ Google Map"), F.lit(1)), F.lit(" ,"), F.lit(",")))
    place = F.array_join(F.filter(F.array(*[F.regexp_replace(text(c), "^[ ,]+|[ ,]+$", "") for c in CALENDAR_PLACES]), lambda t: t != ""), ", ")
    link = F.get(of(CALENDAR_LINK), F.lit(0))["href"]
    return {"start": start, "end": F.coalesce(F.when(one, day(CALENDAR_ENDS)), start), "location": F.when(one, F.nullif(place, F.lit(""))), "application_link": F.when(one & link.startswith("http"), link)}


RECOGNISERS: dict[str, Adapter] = {"events calendar": events_calendar}


def given(page: Column, url: Column, recognisers: dict[str, Adapter], adapters: dict[str, Adapter]) -> dict[str, Column]:
    """Per field what the page's adapters give, ``struct<value, origin>``, or null: the first adapter registered for the host, then recognisers of structure, the later before the earlier."""
    tries: dict[str, list[Column]] = {name: [] for name in GIVEN}
    free = F.lit(True)
    for domain, adapter in adapters.items():
        here = free & host_matches(host(url), [domain])
        free = free & ~host_matches(host(url), [domain])
        for name, value in adapter(page).items():
            tries[name].append(F.when(here & value.isNotNull(), F.struct(value.cast(GIVEN[name]).alias("value"), F.lit(domain).alias("origin"))))
    for kind, recognise in reversed(recognisers.items()):
        for name, value in recognise(page).items():
            tries[name].append(F.when(value.isNotNull(), F.struct(value.cast(GIVEN[name]).alias("value"), F.lit(kind).alias("origin"))))
    nothing = {name: F.lit(None).cast(f"struct<value:{kind},origin:string>") for name, kind in GIVEN.items()}
    return {name: F.coalesce(*tries[name], nothing[name]) for name in GIVEN}


def funding(text: Column, given_types: Column) -> Column:
    """``struct<available, types, evidence>``. Where participants pay for themselves, vague support is none."""
    types = F.coalesce(given_types, extract.funding_types(text))
    own_cost = tx.evidence_window(text, f"(?i){extract.OWN_COST}", needs=extract.NEEDS[extract.OWN_COST])
    none = given_types.isNull() & (own_cost != "") & (F.size(F.array_remove(types, extract.VAGUE_FUNDING)) == 0)
    evidence = tx.evidence_window(text, f"(?i){extract.FUNDING_WORDS}", needs=extract.NEEDS[extract.FUNDING_WORDS])
    return F.struct(
        F.when(none, False).when(F.size(types) > 0, True).alias("available"), F.when(none, F.slice(types, 1, 0)).otherwise(types).alias("types"),
        F.when(none, own_cost).otherwise(evidence).alias("evidence"),
    )


def page_candidates(
    pages: DataFrame, topics: list[str], fx: dict[str, float], as_of: Column, adapters: dict[str, Adapter] | None = None, recognisers: dict[str, Adapter] | None = None, classes: tuple[str, ...] = ()
) -> DataFrame:
    """Candidates of pages ``page_id, url, html`` (and ``region``, where sources have one).

    Kept are pages that look like an opportunity, name one, and are no listing: three events and more, or no deadline, no single range of dates and neither
    a fee nor applications to come. Adapters of the host beat recognisers of the page's structure (``RECOGNISERS``, unless others are given), these beat its one JSON-LD event, and
    that its text; ``origins`` says which of them gave a field. ``classes`` are those of elements that further recognisers read.
    """
    region = F.col("region") if "region" in pages.columns else F.lit("")
    # A filter over a projected page would be put before the shuffle that deals the pages out, with a second reading of each page there.
    rows = staged(pages.select("page_id", "url", region.alias("region"), "html"), p=extract.parsed_page(F.col("html"), [*CLASSES, *classes])).drop("html")
    rows = rows.filter(filters.looks_like_opportunity(F.col("p.text")))
    text = F.col("p.text")
    found = given(F.col("p"), F.col("url"), RECOGNISERS if recognisers is None else recognisers, adapters or {})
    rows = staged(rows.select("*", extract.date_ranges(text).alias("ranges"), sessions.programme_sessions(text).alias("said")), g=F.struct(*[c.alias(n) for n, c in found.items()]), events=structured.events(F.col("p.jsonld")))
    event = F.when(F.size("events") == 1, F.get("events", F.lit(0)))
    range_ = F.get("ranges", F.lit(0))
    some = lambda s: F.when(F.size(s) > 0, s)
    held = F.coalesce(F.col("g.sessions.value"), some(event["sessions"]), some(F.col("said")))
    rows = staged(rows, event=event, s=held, range=range_, fee_text=fees.fee_of(text))
    span = sessions.programme_span(F.col("s"))
    pick = lambda *tries: F.coalesce(*[F.when(v.isNotNull(), F.struct(v.alias("value"), o.alias("origin"))) for v, o in tries])
    of = lambda name: (F.col(f"g.{name}.value"), F.col(f"g.{name}.origin"))
    jsonld, prose = F.lit("structured data"), F.lit("text")
    start = pick(of("start"), (F.col("event.start"), jsonld), (span["start_date"], prose), (F.col("range.start"), prose))
    end = pick(of("end"), (F.col("event.end"), jsonld), (span["end_date"], prose), (F.col("range.end"), prose))
    rows = staged(rows, start=start, end=end)
    rows = staged(rows, due=deadlines(text, F.col("start.value")))
    rows = staged(rows, chosen=chosen_deadline(F.col("due")))
    deadline = pick(of("deadline"), (F.col("chosen.day"), prose))
    stated = F.when(F.col("g.deadline").isNotNull(), F.coalesce(F.col("g.deadline_evidence.value"), F.lit(""))).otherwise(deadline_evidence(F.col("due"), F.col("chosen")))
    named = F.nullif(tx.clean_title(F.coalesce(F.col("event.name"), F.lit(""))), F.lit(""))
    rows = staged(
        rows, own_title=places.page_title(F.col("p.heads"), F.col("p.shared_title"), F.col("p.title")), event_title=named, given_place=validation.clean_place(F.col("g.location.value")),
        event_place=validation.clean_place(F.col("event.location")), own_place=places.page_place(F.col("p.pieces"), F.col("p.heads"), text, F.col("region")),
    )
    some_text = lambda c: F.nullif(F.col(c), F.lit(""))
    title = pick(of("title"), (some_text("own_title"), prose), (F.col("event_title"), jsonld))
    location = pick((some_text("given_place"), F.col("g.location.origin")), (some_text("event_place"), jsonld), (F.col("own_place"), prose))
    fee = pick(of("fee"), (F.nullif(F.col("fee_text"), F.lit("")), prose))
    rows = staged(rows, deadline=deadline, deadline_evidence=stated, title=title, place=location, fee=fee, f=funding(text, F.col("g.funding_type.value")), said_mode=extract.mode_of(text))
    structured_dates = F.col("g.start").isNotNull() | F.col("event.start").isNotNull() | F.col("s").isNotNull()
    count = F.when(structured_dates, 1).otherwise(F.greatest(F.size("ranges"), F.size("events")))
    more = extract.says(text, extract.NOT_OPEN) | (F.col("fee_text") != "")
    listing = (count >= LISTING) | F.col("deadline").isNull() & (count != 1) & ~more
    rows = rows.filter(~listing & F.col("title").isNotNull()).filter(~filters.workshop_title(F.col("title.value")))
    amount = F.coalesce(F.col("fee.value"), F.lit(""))
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in fx.items() for x in kv]), money.currency(amount))
    mode = F.when((F.col("said_mode") == "uncertain") & places.is_specific(F.col("place.value"), F.col("region")), "in-person").otherwise(F.col("said_mode"))
    days = F.when(F.col("s").isNotNull(), span["duration_days"]).otherwise(dates.duration_days(F.col("start.value"), F.col("end.value")))
    ranges_said = F.array_join(F.transform("s", lambda s: F.concat(s["name"], F.lit(": "), s["start"].cast("string"), F.lit(" to "), s["end"].cast("string"))), "; ")
    origins = F.map_filter(F.map_from_arrays(F.array(*[F.lit(n) for n in ("start", "end", "deadline", "title", "place", "fee")]), F.array("start.origin", "end.origin", "deadline.origin", "title.origin", "place.origin", "fee.origin")), lambda _, o: o.isNotNull())
    out = rows.select(
        "page_id", F.col("url").alias("source_url"), F.coalesce(F.col("g.application_link.value"), F.col("url")).alias("application_link"), F.col("title.value").alias("title"),
        tx.first_term(text, filters.PROGRAMME_TERMS, "research training").alias("type"), F.col("place.value").alias("location"), F.col("start.value").alias("start_date"), F.col("end.value").alias("end_date"),
        days.alias("duration_days"), F.coalesce(F.nullif(ranges_said, F.lit("")), F.col("range.evidence"), F.lit("")).alias("duration_evidence"), F.col("s").alias("sessions"),
        F.col("deadline.value").alias("deadline"), "deadline_evidence", extract.application_status(text, F.col("deadline.value"), as_of).alias("deadline_status"),
        F.col("f.available").alias("funding_available"), F.col("f.types").alias("funding_type"), F.col("f.evidence").alias("funding_evidence"), amount.alias("fee"),
        money.fee_to_eur(amount, F.coalesce(rate, F.when(amount.rlike(money.FREE), 1.0))).alias("fee_eur"), mode.alias("mode"), extract.mode_evidence(text).alias("mode_evidence"),
        extract.level_of(text).alias("target_level"), tx.clean_space(tx.first_match(text, ELIGIBILITY)).alias("eligibility"), extract.topics_in(text, topics).alias("topic_keywords"),
        tx.clean_space(F.substring(text, 1, 280)).alias("summary"), origins.alias("origins"),
    )
    known = [F.col("deadline").isNotNull(), F.col("duration_days").isNotNull(), F.coalesce(F.col("funding_available"), F.lit(False)) | F.col("fee_eur").isNotNull(), F.col("mode") != "uncertain"]
    return out.withColumn("extraction_confidence", F.round(sum((k.cast("int") for k in known), F.lit(0)) / 4, 2))

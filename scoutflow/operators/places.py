"""Facts that stand by their place in a page: values below labels, places below dates, titles above them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.operators import filters, validation

# Labels of a place, labels that end a value, titles that name no programme, and words that mark a section.
PLACE_LABELS = ["location", "venue", "place"]
STOP_LABELS = [
    "date", "dates", "date & time", "date and time", "time", "contact", "contacts", "organizer", "organiser", "agenda", "application", "deadline", "fee", "fees", "funding",
    "course fee", "course fees", "cost", "costs", "price", "tuition", "credits", "ects", "level", "language", "format", "duration", "registration", "type", "study load",
    "more information", "read more",
]
GENERIC_TITLES = [
    "home", "homepage", "welcome", "events", "event", "training", "trainings", "training schools", "training school", "course funding", "courses", "course", "search this site",
    "news", "calendar", "untitled", "overview", "summer schools", "top menu", "main menu", "menu", "navigation", "application", "applications", "apply", "register",
    "registration", "read more", "skip to main content", "student support", "opportunities", "vacancies", "about", "about us", "contact", "contact us", "events archive",
    "upcoming events", "our events", "mobile menu", "our use of cookies",
]
SECTION_WORDS = ["navigation", "archive", "search results", "important dates", "abstract submission", "governing", "registration & instructions"]
NOT_SPECIFIC = ["", "global", "europe", "continental europe", "uk and nearby"]
LINES, ENOUGH, WIDEST, SHORTEST = 3, 8, 100, 6


def label_value(lines: Column, labels: Sequence[str]) -> Column:
    """What stands below the first line that is one of ``labels``: up to ``LINES`` lines, until they have ``ENOUGH`` characters or the next label comes; else empty."""
    bare = lambda line: F.lower(F.regexp_replace(line, ":+$", ""))
    at = F.array_position(F.transform(lines, lambda x: bare(x).isin(list(labels))), True)

    def read(state: Column, line: Column) -> Column:
        text = F.concat_ws(" ", F.nullif(state["text"], F.lit("")), line)
        over = state["over"] | bare(line).isin(STOP_LABELS)
        return F.struct(F.when(over, state["text"]).otherwise(text).alias("text"), (over | (F.length(text) >= ENOUGH)).alias("over"))

    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("over"))
    value = F.aggregate(F.slice(lines, at.cast("int") + 1, LINES), start, read, lambda s: s["text"])
    return F.when(at > 0, tx.clean_space(value)).otherwise("")


def is_dated(line: Column) -> Column:
    return line.rlike(r"\b20\d{2}\b") & line.rlike(r"\b\d{1,2}\b")


def heading_place(headings: Column) -> Column:
    """The lines (two at most) below the date in the first heading that has a date and such lines; else empty."""

    def below(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, is_dated), True).cast("int")
        return F.when(at > 0, F.array_join(F.filter(F.slice(lines, at + 1, 2), lambda x: F.length(x) <= WIDEST), ", ")).otherwise("")

    return F.coalesce(F.get(F.filter(F.transform(headings, below), lambda v: v != ""), F.lit(0)), F.lit(""))


def heading_title(lines: Column) -> Column:
    """A heading without its date and what follows that; all of it where it begins with a date. ``48 th`` is put together."""
    at = F.array_position(F.transform(lines, is_dated), True).cast("int")
    above = F.array_join(F.when(at > 0, F.slice(lines, 1, at - 1)).otherwise(lines), " ")
    return F.regexp_replace(tx.clean_space(F.coalesce(F.nullif(above, F.lit("")), F.array_join(lines, " "))), r"(?i)\b(\d+)\s+(st|nd|rd|th)\b", "$1$2")


def names_something(title: Column) -> Column:
    """Whether a title can name a programme: no navigation, section, bare address, home page or banner in capitals."""
    low = F.lower(title)
    address = F.greatest(*[F.startswith(low, F.lit(p)) for p in ("http://", "https://", "www.")]) | ~F.contains(low, F.lit(" ")) & low.rlike(r"\.[a-z]{2,}$")
    long_words = F.filter(F.split(title, " "), lambda w: w.rlike(r"^\p{L}{3,}$"))
    banner = (title == F.upper(title)) & (title != low) & (F.size(long_words) >= 2)
    label = F.trim(F.split_part(low, F.lit(":"), F.lit(1))).isin("events", "event", "news")
    return ~address & ~banner & ~label & ~low.isin(GENERIC_TITLES) & ~tx.any_term(low, SECTION_WORDS) & (F.split_part(low, F.lit(" "), F.lit(1)) != "home") & (F.length(title) >= SHORTEST)


def page_title(headings: Column, shared_title: Column, title: Column) -> Column:
    """The first title that can name a programme: of headings (those that name a kind of programme first), of the title for sharing, of the page; else empty."""
    titles = F.transform(headings, heading_title)
    kind = lambda t: tx.any_term(t, filters.PROGRAMME_TERMS)
    ordered = F.concat(F.filter(titles, kind), F.filter(titles, lambda t: ~kind(t)), F.array(F.coalesce(shared_title, F.lit("")), F.coalesce(title, F.lit(""))))
    return F.coalesce(F.get(F.filter(F.transform(ordered, lambda t: tx.clean_title(t)), names_something), F.lit(0)), F.lit(""))


def page_place(pieces: Column, headings: Column, text: Column, region: Column) -> Column:
    """The place of a page: below a label, below the date of a heading, or in prose; else its source's region. Continental Europe is Europe."""
    raw = F.coalesce(F.nullif(label_value(pieces, PLACE_LABELS), F.lit("")), F.nullif(heading_place(headings), F.lit("")), tx.first_match(text, validation.PLACE_PATTERNS, validation.PLACE_NEEDS))
    named = lambda place: F.when(F.lower(F.trim(place)) == "continental europe", "Europe").otherwise(place)
    return tx.let(validation.clean_place(raw), lambda clean: named(F.when(clean != "", clean).otherwise(F.coalesce(region, F.lit("")))))


def is_specific(place: Column, region: Column) -> Column:
    """Whether a place is more than its source's region or a part of the world."""
    low = F.lower(tx.clean_space(place))
    return ~low.isin(NOT_SPECIFIC) & (low != F.lower(tx.clean_space(F.coalesce(region, F.lit("")))))

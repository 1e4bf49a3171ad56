"""Deadlines of a page: with a year, or with the year of the event they belong to."""

from __future__ import annotations

import re
from datetime import date

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions import dates, spans
from scoutflow.functions import text as tx
from scoutflow.functions.batches import in_batches

# How dates and deadlines are written.
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
DAY = r"\d{1,2}(?:st|nd|rd|th)?"
FULL_DATE = rf"(?:{DAY}\s+{MONTH}\s+20\d{{2}}|{MONTH}\s+{DAY},?\s+20\d{{2}}|20\d{{2}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]20\d{{2}})"
NO_YEAR = rf"(?:{MONTH}\s+{DAY}(?!\d)|{DAY}\s+{MONTH})"  # the first digits of a year are no day
NOT_DATED = r"(?!\s*,?\s*20\d{2})"
NAMES = r"application deadline|registration deadline|submission deadline|abstract deadline"
MORE_NAMES = r"deadline for applications?|applications?\s+deadline"
CLOSING = r"deadline|apply by|apply before|applications?\s+(?:close[sd]?|are due|due)|closing date|last date|\bregister\b(?:\s+\w+){0,5}\s+(?:latest|no later than)\s+on"
DATED = [("dated", rf"(?:{NAMES}|{CLOSING})[^.\n]{{0,40}}?({FULL_DATE})")]
YEARLESS = [
    ("date first", rf"({NO_YEAR}){NOT_DATED}(?:(?!{NO_YEAR})[^.\n]){{0,90}}?(?:application\s+deadline|deadline\s+for\s+applications?|applications?\s+deadline)\b"),
    ("date after", rf"(?:{NAMES}|{MORE_NAMES}|{CLOSING})[^.\n]{{0,40}}?({NO_YEAR}){NOT_DATED}"),
    ("open range", rf"({NO_YEAR})\s*(?:-|–|—|to|until|through)\s*({NO_YEAR})\s*:\s*(?:registration|applications?)\s+open"),
    ("open until", rf"(?:registration|applications?)\s+(?:opens?\s+)?until\s+({NO_YEAR})\b{NOT_DATED}"),
    ("payment", rf"(?:must be paid|payment[^.\n]{{0,20}}(?:due|before))[^.\n]{{0,30}}(?:before|by)?\s*({NO_YEAR})\b{NOT_DATED}"),
]
# Matches of one name that begin inside those of another do not count.
SHADOWED = {"date after": "date first"}
# How each pattern begins: places that fail this need no look at its alternatives.
_NAMED = "(?=[adrscl])"
STARTS = {"dated": _NAMED, "date first": r"(?=[jfmasond\d])", "date after": _NAMED, "open range": r"(?=[jfmasond\d])", "open until": "(?=[ra])", "payment": "(?=[mp])"}
OTHERS_SHOWN = 3
DEADLINES = "array<struct<day:date,category:int,evidence:string>>"
_DEADLINES = pa.list_(pa.struct([("day", pa.date32()), ("category", pa.int32()), ("evidence", pa.string())]))
# What every match of a pattern holds, in lower case; and what ends every match of "date first", at most so far behind its date.
_CLOSING = ("deadline", "apply b", "application", "closing date", "last date", "register")
NEEDS = {"dated": _CLOSING, "date after": _CLOSING, "date first": ("deadline",), "open range": (":",), "open until": ("until",), "payment": ("paid", "payment")}
_OPENED = re.compile(r":\s*(?:registration|applications?)\s+open")
_BEHIND = re.compile(r"(?:applications?\s+deadline|deadline\s+for\s+application)\w*")
REACH = 90


def begins(low: str) -> dict[str, int]:
    """The patterns that can match a text in lower case, each with a place before which it does not begin. A date is no more than two words, with space before them."""
    found = {kind: 0 for kind, words in NEEDS.items() if any(w in low for w in words)}
    if ":" in low and not _OPENED.search(low):
        del found["open range"]
    if "date first" in found:
        if behind := _BEHIND.search(low):
            words = low[: max(0, behind.start() - REACH)].rsplit(None, 4)
            found["date first"] = len(words[0]) if len(words) == 5 else 0
        else:
            del found["date first"]
    return found


def deadlines(text: Column, event_start: Column | None = None) -> Column:
    """``array<struct<day, category, evidence>>`` of a page's deadlines, the earliest first, each day once with the evidence found first.

    With ``event_start``, dates without a year count too, in the event's year or, where they would follow its start, the year before. A date
    that stands before its words of deadline keeps them: they are not read as those of the next date. Category 0 is for applications, 1 for registrations,
    2 for others.
    """
    patterns = DATED + (YEARLESS if event_start is not None else [])
    named, lower = spans.compiled(patterns), spans.compiled_lower([(kind, STARTS[kind] + p) for kind, p in patterns])

    def read(t: str | None, start: date | None) -> list[tuple]:
        first: dict[date, tuple] = {}
        t = t or ""
        low = t.lower()
        for kind, m in spans.matches_of(low, lower, SHADOWED, begins(low)) if t.isascii() else spans.matches_of(t, named, SHADOWED):
            value = t[slice(*m.span(m.lastindex or 0))]
            if kind == "dated":
                day = dates.date_of(value)
            else:
                day = dates.date_of(f"{value} {start.year}") if start is not None else None
                day = dates.in_year_of(day, start) if day else None
            if day:
                evidence = " ".join(t[m.start() : m.end()].split())
                first.setdefault(day, (day, category_of(evidence), evidence))
        return [first[day] for day in sorted(first)]

    return in_batches(DEADLINES, _DEADLINES, read, text, F.lit(None).cast("date") if event_start is None else event_start.cast("date"))


def category_of(evidence: str) -> int:
    low = evidence.lower()
    return 0 if "application" in low or "apply" in low else 1 if "registration" in low or "register" in low else 2


def chosen_deadline(found: Column) -> Column:
    """``struct<day, evidence>``: of the best category there is, the latest."""

    def pick(rows: Column) -> Column:
        best = F.array_min(F.transform(rows, lambda d: d["category"]))
        return F.array_max(F.transform(F.filter(rows, lambda d: d["category"] == best), lambda d: F.struct(d["day"].alias("day"), d["evidence"].alias("evidence"))))

    return tx.let(found, pick)


def deadline_evidence(found: Column, chosen: Column) -> Column:
    """The chosen deadline's evidence, with the other dates that are listed; empty without a deadline."""
    others = F.transform(F.filter(found, lambda d: d["day"] != chosen["day"]), lambda d: d["day"].cast("string"))
    listed = F.array_join(F.slice(others, 1, OTHERS_SHOWN), ", ")
    return F.when(chosen["day"].isNull(), "").when(F.size(others) > 0, F.concat(chosen["evidence"], F.lit(" (other dates listed: "), listed, F.lit(")"))).otherwise(chosen["evidence"])

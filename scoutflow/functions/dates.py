"""Dates as Column expressions. Every function that needs today takes ``as_of``."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions.text import let

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
MONTH_WORD = rf"(?i:{MONTHS})[a-z]*\.?"


def parse_date(text: Column) -> Column:
    """A date from ISO, ``12 March 2026``, ``March 12, 2026`` or numeric text (day first, unless that cannot be). Otherwise null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\bof\b|,", " "))
    part = lambda t, pattern, i: F.regexp_extract(t, pattern, i)
    # Each form is tried only where it stands: a failed parse costs as much as many matches.
    iso, day_month, month_day = r"^(\d{4}-\d{1,2}-\d{1,2})(?:[T ].*)?$", rf"^(\d{{1,2}}) ({MONTH_WORD}) (\d{{4}})$", rf"^({MONTH_WORD}) (\d{{1,2}}) (\d{{4}})$"
    numbers = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"
    named = lambda t, p, d, m: F.try_to_date(F.concat_ws(" ", part(t, p, d), F.initcap(F.substring(part(t, p, m), 1, 3)), part(t, p, 3)), "d MMM yyyy")
    numeric = lambda t, d, m: F.try_to_date(F.concat_ws("-", part(t, numbers, 3), F.lpad(part(t, numbers, m), 2, "0"), F.lpad(part(t, numbers, d), 2, "0")), "yyyy-MM-dd")

    def read(t: Column) -> Column:
        return (
            F.when(t.rlike(iso), F.try_to_date(part(t, iso, 1), "yyyy-M-d")).when(t.rlike(day_month), named(t, day_month, 1, 2)).when(t.rlike(month_day), named(t, month_day, 2, 1))
            .when(t.rlike(numbers), F.coalesce(numeric(t, 1, 2), numeric(t, 2, 1)))
        )

    return let(F.regexp_replace(bare, r"\s+", " "), read)


_NUMBER_OF = {m: i for i, m in enumerate(MONTHS.lower().split("|"), 1)}
_ORDINAL, _FILLER, _SPACE = (re.compile(p, re.I | re.A) for p in (r"(\d)(?:st|nd|rd|th)\b", r"\bof\b|,", r"\s+"))
_FORMS = [
    (re.compile(p, re.A), groups)
    for p, groups in [
        (r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ][^\n]*)?", [(1, 2, 3)]), (rf"(\d{{1,2}}) ({MONTH_WORD}) (\d{{4}})", [(3, 2, 1)]), (rf"({MONTH_WORD}) (\d{{1,2}}) (\d{{4}})", [(3, 1, 2)]),
        (r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})", [(3, 2, 1), (3, 1, 2)]),
    ]
]


def date_of(text: str) -> date | None:
    """What ``parse_date`` reads, for functions that work on Arrow batches."""
    bare = _SPACE.sub(" ", _FILLER.sub(" ", _ORDINAL.sub(r"\1", text)).strip(" "))
    for form, tries in _FORMS:
        if m := form.fullmatch(bare):
            for year, month, day in tries:
                number = m[month]
                try:
                    return date(int(m[year]), int(number) if number.isdigit() else _NUMBER_OF[number[:3].lower()], int(m[day]))
                except ValueError:
                    continue
            return None
    return None


def in_year_of(day: date, event_start: date) -> date | None:
    """What ``inferred_year`` gives, for functions that work on Arrow batches."""
    for year in (event_start.year, event_start.year - 1):
        try:
            same = day.replace(year=year)
        except ValueError:
            return None
        if same <= event_start:
            return same
    return same


def duration_days(start: Column, end: Column) -> Column:
    """Days from start to end with both counted; null if either is."""
    return F.datediff(end, start) + 1


def inferred_year(day: Column, event_start: Column) -> Column:
    """A date put in the event's year; a year earlier where it would follow the start. 29 February without a leap year: null."""
    in_year = lambda d, back: F.try_to_date(F.concat_ws("-", (F.year(event_start) - back).cast("string"), F.date_format(d, "MM-dd")), "yyyy-MM-dd")
    either = lambda d: let(in_year(d, 0), lambda same: F.when(same > event_start, in_year(d, 1)).otherwise(same))
    return let(day, lambda d: F.when(d.isNotNull() & event_start.isNotNull(), either(d)))


def date_span_label(start: Column, end: Column) -> Column:
    """``3 Jul - 9 Jul 2026``, the year once where it is the same; one date where there is no end."""
    long = "d MMM yyyy"
    both = F.when(F.year(start) == F.year(end), F.concat(F.date_format(start, "d MMM"), F.lit(" - "), F.date_format(end, long))).otherwise(F.concat(F.date_format(start, long), F.lit(" - "), F.date_format(end, long)))
    return F.when(start.isNull(), F.lit("")).when(end.isNull() | (start == end), F.date_format(start, long)).otherwise(both)


def refreshed_status(status: Column, deadline: Column, as_of: Column) -> Column:
    """An open deadline that has passed is closed; closed and not-open stay."""
    return F.when(status.isin("closed", "not_open"), status).when(deadline < as_of, "closed").when(deadline >= as_of, "open").otherwise(status)


def is_past(status: Column, deadline: Column, start: Column, as_of: Column) -> Column:
    """Closed or not open; else by the deadline; else by the start."""
    by_date = F.when(deadline.isNotNull(), deadline < as_of).otherwise(F.coalesce(start < as_of, F.lit(False)))
    return F.coalesce(status.isin("closed", "not_open"), F.lit(False)) | by_date

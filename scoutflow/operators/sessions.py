"""Programmes of several selectable sessions."""

from __future__ import annotations

import re
from datetime import date

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions.batches import in_batches
from scoutflow.operators.extract import spans

SESSION = "array<struct<name:string,start:date,end:date,deadline:date>>"
_SESSION = pa.list_(pa.struct([("name", pa.string()), ("start", pa.date32()), ("end", pa.date32()), ("deadline", pa.date32())]))
LABEL = re.compile(r"\b(session|course|week|module|block|term)\s+(\d{1,2}|[ivx]{1,4}|one|two|three|four|five|six|seven|eight|nine|ten|[a-h])\b", re.I)
NUMBERS = dict(zip("one two three four five six seven eight nine ten".split(), range(1, 11)))
DEADLINE = re.compile(r"(?:deadline|apply by)\D{0,25}?(\d{1,2}(?:st|nd|rd|th)?\s+[A-Z][a-z]+\s+20\d{2}|20\d{2}-\d{2}-\d{2})", re.I)
ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
WIDEST, REACH = 60, 120


def label_of(kind: str, number: str) -> str:
    """``Session 2`` for session two, II or 2; single letters in upper case."""
    low = number.lower()
    return f"{kind.title()} {NUMBERS.get(low) or ROMAN.get(low) or (int(low) if low.isdigit() else low.upper())}"


def sessions_of(text: str | None) -> list[tuple[str, date, date, date | None]]:
    """Labelled ranges of at most 60 days with their deadlines, by start: none unless two labels have one. Cancelled ones are left out."""
    text = text or ""
    marks = list(LABEL.finditer(text))
    found: dict[tuple[str, date, date], date | None] = {}
    for m, after in zip(marks, [*marks[1:], None]):
        part = text[m.end() : min(after.start() if after else len(text), m.end() + 4 * REACH)]
        ranges = [r for r in spans(part[:REACH]) if (r[1] - r[0]).days <= WIDEST]
        if not ranges or re.search(r"cancel(?:l?ed)", part[:REACH], re.I):
            continue
        due = DEADLINE.search(part)
        day = spans(f"{due[1]} to {due[1]}") if due else []
        found.setdefault((label_of(m[1], m[2]), *ranges[0][:2]), day[0][0] if day else None)
    rows = sorted(((n, a, b, d) for (n, a, b), d in found.items()), key=lambda r: (r[1], r[2], r[0]))
    return rows if len({n for n, *_ in rows}) >= 2 else []


def programme_sessions(text: Column) -> Column:
    return in_batches(SESSION, _SESSION, sessions_of, text)


def programme_span(sessions: Column) -> Column:
    """Start and end over all sessions, the longest session's days, and the latest start, by which it counts as past."""
    pick = lambda f: F.transform(sessions, f)
    return F.struct(
        F.array_min(pick(lambda s: s["start"])).alias("start_date"),
        F.array_max(pick(lambda s: s["end"])).alias("end_date"),
        F.array_max(pick(lambda s: F.datediff(s["end"], s["start"]) + 1)).alias("duration_days"),
        F.array_max(pick(lambda s: s["start"])).alias("reference_start"),
    )

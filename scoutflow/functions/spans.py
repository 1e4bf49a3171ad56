"""Pattern matches with their places, which expressions alone cannot give."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column

from scoutflow.functions.batches import in_batches

SPAN = "array<struct<kind:string,start:int,end:int,match:string,value:string,context:string>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string()), ("value", pa.string()), ("context", pa.string())]))


def outside(starts: list[int], spans: list[tuple[int, int]]) -> list[bool]:
    """Of each start whether it lies in none of ``spans`` (ends counted), which are in order and do not overlap."""
    begins = [a for a, _ in spans]
    return [(at := bisect_right(begins, s)) == 0 or spans[at - 1][1] < s for s in starts]


def compiled(patterns: Sequence[tuple[str, str]]) -> list[tuple[str, re.Pattern]]:
    return [(kind, re.compile(p, re.I)) for kind, p in patterns]


def compiled_lower(patterns: Sequence[tuple[str, str]]) -> list[tuple[str, re.Pattern]]:
    """For ASCII texts in lower case, on which they find the same places several times sooner. Patterns must hold no escapes in upper case."""
    return [(kind, re.compile(p.lower())) for kind, p in patterns]


def matches_of(text: str, named: list[tuple[str, re.Pattern]], unless: dict[str, str] | None = None, begins: dict[str, int] | None = None) -> list[tuple[str, re.Match]]:
    """What ``found`` gives, one text's matches with their names. ``begins``: the names that can match, with a place before which they cannot begin; all, unless it is given."""
    by_kind = [(kind, list(p.finditer(text, begins[kind] if begins else 0)) if begins is None or kind in begins else []) for kind, p in named]
    rows = []
    for kind, matches in by_kind:
        if matches and unless and kind in unless:
            held = sorted((m.start(), m.end()) for other, ms in by_kind if other == unless[kind] for m in ms)
            matches = [m for m, free in zip(matches, outside([m.start() for m in matches], held)) if free]
        rows += [(kind, m) for m in matches]
    return rows


def found(text: Column, patterns: Sequence[tuple[str, str]], before: int = 0, after: int = 0, unless: dict[str, str] | None = None, needs: Sequence[str] = ()) -> Column:
    """All matches of named patterns, ignoring case: by pattern, then by place.

    ``value`` is the last group (without groups the match), ``context`` the match with ``before`` and ``after`` characters around it. With ``unless``,
    matches of one name are left out where they begin inside a match of another. A null text has none. ``needs``: words in lower case of which every match holds one.
    """
    named, lower = compiled(patterns), compiled_lower(patterns)

    def matched(t: str) -> list[tuple[str, re.Match]]:
        if not t.isascii():
            return matches_of(t, named, unless)
        low = t.lower()
        return matches_of(low, lower, unless) if not needs or any(word in low for word in needs) else []

    def one(t: str, kind: str, m: re.Match) -> tuple:
        start, end = m.span()
        return kind, start, end, " ".join(t[start:end].split()), t[slice(*m.span(m.lastindex or 0))], t[max(0, start - before) : end + after]

    return in_batches(SPAN, _SPAN, lambda t: [one(t, kind, m) for kind, m in matched(t)] if t else [], text)

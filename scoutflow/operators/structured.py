"""Structured data of any nesting: events of JSON-LD scripts, and nested values as text.

Lists in lists, graphs in lists and objects in objects need no schema. Events and texts are read in Arrow batches: expressions that walk
VARIANT level by level run interpreted, and the query took more than twice as long. What counts as JSON, and how its numbers are written, is as VARIANT has it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import dates

# The types of nodes that are events.
EVENT_TYPES = {"event", "educationevent", "businessevent", "socialevent", "festival", "course", "courseinstance"}
ADDRESS = ["addressLocality", "addressRegion", "addressCountry"]
WIDEST_SESSION = 60


def nesting(json: Column) -> Column:
    """How deep the brackets of a JSON text are nested; those inside strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), r'"[^"]*"', ""), r"[^\[\]{}]", "")
    deeper = lambda s, c: s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(F.split(bare, ""), zero, lambda s, c: F.struct(deeper(s, c).alias("now"), F.greatest(s["most"], deeper(s, c)).alias("most")), lambda s: s["most"])


def levels(json: Column) -> Column:
    return F.sequence(F.lit(0), F.coalesce(nesting(json), F.lit(0)))


def nodes(script: Column) -> Column:
    """Every node of a JSON-LD script as ``array<variant>``: members of lists and of ``@graph``, however nested. What is no JSON has none."""

    def opened(node: Column) -> Column:
        return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.try_variant_get(node, "$['@graph']", "array<variant>"), F.array(node))

    parsed = F.try_parse_json(script)
    return F.when(parsed.isNotNull(), F.aggregate(levels(script), F.array(parsed), lambda found, _: F.flatten(F.transform(found, opened)))).otherwise(F.array().cast("array<variant>"))


class _Number(str):
    """A number as it is written."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _object(pairs: list[tuple]) -> dict:
    if len(made := dict(pairs)) < len(pairs):
        raise ValueError("a key stands twice")
    return made


_JSON = json.JSONDecoder(object_pairs_hook=_object, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
_BEGIN, _SPACE, _ISO = re.compile(r"[ \t\n\r]*"), re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"), re.compile(r"\d{4}-\d{2}-\d{2}", re.A)
DEEPEST = 1000


def _held(value: object) -> list:
    return list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else []


def _too_deep(value: object) -> bool:
    level = [value]
    for _ in range(DEEPEST + 1):
        level = [v for held in level if isinstance(held, dict | list) for v in (_held(held) or [None])]
        if not level:
            return False
    return True


def parsed(text: str | None) -> object:
    """The value of a JSON text, numbers as they are written. ``ValueError`` for what VARIANT takes for no JSON: a key twice, more than ``DEEPEST`` levels."""
    if text is None:
        raise ValueError("null")
    try:
        value, end = _JSON.raw_decode(text, _BEGIN.match(text).end())
    except RecursionError as e:
        raise ValueError("too deep") from e
    alone = isinstance(value, _Number | bool) or value is None  # these must end before another sign
    if alone and text[end : end + 1].strip(" \t\n\r") or text.count("[") + text.count("{") > DEEPEST and _too_deep(value):
        raise ValueError(text[end : end + 20])
    return value


def _whole(text: str) -> str:
    """Halves of characters, which JSON can name and UTF-8 cannot, become question marks."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _clean(text: str) -> str:
    return _SPACE.sub(" ", _whole(text)).strip(" ")


def _double(written: str) -> str:
    x = float(written)
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    all_ = "".join(map(str, digits))
    return f"{'-' * sign}{all_[0]}.{all_[1:].rstrip('0') or '0'}E{exponent + len(all_) - 1}"


def _number(written: str) -> str:
    """A number as VARIANT shows it: decimals of up to 38 digits without closing zeros, others as doubles."""
    digits, _, behind = written.lstrip("-").partition(".")
    if not (digits + behind).isdigit() or len((digits + behind).lstrip("0")) > 38 or len(behind) > 38:
        return _double(written)
    bare = written.rstrip("0").rstrip(".") if behind else written
    return "0" if bare == "-0" else bare


def _shown(value: object) -> str:
    """A value as VARIANT casts it to text, with sorted keys; a missing one is empty."""
    if type(value) is str:
        return value
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return _number(value) if isinstance(value, _Number) else _dumped(value)


def _dumped(value: object) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dumped(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dumped, value)) + "]"
    return json.dumps(value, ensure_ascii=False) if type(value) is str else _shown(value) if value is not None else "null"


def _field(value: object, name: str) -> object:
    return value.get(name) if isinstance(value, dict) else None


def _words(value: object) -> str:
    return _clean(_shown(value))


def _first(value: object) -> object:
    """The first member of a list; other values as they are."""
    return value[0] if isinstance(value, list) and value else value


def _day(value: object) -> date | None:
    """The date of a text or of a list's first text: year first where it begins so, else as in prose."""
    text = _first(value)
    if type(text) is not str:
        return None
    if not _ISO.match(text):
        return dates.date_of(text)
    try:
        return date.fromisoformat(text[:10])
    except ValueError:
        return None


def _place(value: object) -> str:
    """A place as text, from a text, a named place with an address (a text or its parts), or a list's first of these."""
    v = _first(value)
    if type(v) is str:
        return _clean(v)
    address = _field(v, "address")
    parts = ", ".join(t for name in ADDRESS if (t := _words(_field(address, name)))) if isinstance(address, dict) else _words(address)
    return ", ".join(t for t in (_words(_field(v, "name")), parts) if t)


def _sessions(node: dict) -> list[dict]:
    """Sub-events of at most ``WIDEST_SESSION`` days between their ends as sessions; none unless there are two. Those without a name are numbered."""
    sub = node["subEvent"] if "subEvent" in node else node.get("subEvents")
    found = []
    for i, item in enumerate(sub if isinstance(sub, list) else [sub], 1):
        start = _day(_field(item, "startDate"))
        end = _day(_field(item, "endDate")) or start
        if start and 0 <= (end - start).days <= WIDEST_SESSION:
            found.append({"name": _words(_field(item, "name")) or f"Session {i}", "start": start, "end": end, "deadline": None})
    return found if len(found) >= 2 else []


def _is_event(node: object) -> bool:
    kind = _field(node, "@type")
    return any(type(k) is str and k.lower() in EVENT_TYPES for k in (kind if isinstance(kind, list) else [kind]))


def _nodes(script: str | None) -> Iterator[object]:
    """What ``nodes`` gives, for functions that work on Arrow batches."""
    try:
        waiting = [parsed(script)]
    except ValueError:
        return
    while waiting:
        node = waiting.pop()
        below = node if isinstance(node, list) else _field(node, "@graph")
        if isinstance(below, list):
            waiting += reversed(below)
        else:
            yield node


def _events(scripts: list[str | None]) -> Iterator[dict]:
    for script in scripts:
        for node in _nodes(script):
            if _is_event(node) and (start := _day(_field(node, "startDate"))):
                yield {"start": start, "end": _day(_field(node, "endDate")) or start, "name": _words(_field(node, "name")), "location": _place(_field(node, "location")), "sessions": _sessions(node)}


def events(scripts: Column) -> Column:
    """Dated events of a page's JSON-LD scripts: ``array<struct<start, end, name, location, sessions>>``, in page order. An event without an end ends as it starts."""

    @F.pandas_udf("array<struct<start:date,end:date,name:string,location:string,sessions:array<struct<name:string,start:date,end:date,deadline:date>>>>")
    def all_of(pages: pd.Series) -> pd.Series:
        return pd.Series([[] if page is None else list(_events(page)) for page in pages])

    return all_of(scripts)


def _leaf(value: object) -> str:
    """A single value as text; empty, false and zero ones have none."""
    if isinstance(value, _Number):
        return "" if float(value) == 0 else value if value.lstrip("-").isdigit() else _double(value)
    return _clean(value) if isinstance(value, str) else "True" if value else ""


def _compact(value: object) -> str:
    # Each level being put together: what is still to come, the texts so far, the key that it stands under.
    levels_ = [(iter([(None, value)]), [], None)]
    while True:
        coming, texts, key = levels_[-1]
        for k, v in coming:
            if isinstance(v, dict | list):
                levels_.append((iter(v.items() if isinstance(v, dict) else [(None, x) for x in v]), [], k))
                break
            if text := _leaf(v):
                texts.append(text if k is None else f"{k}: {text}")
        else:
            levels_.pop()
            text = "; ".join(texts)
            if not levels_:
                return text
            if text:
                levels_[-1][1].append(text if key is None else f"{key}: {text}")


def _compact_text(text: str | None) -> str:
    try:
        value = parsed(text)
    except ValueError:
        return _clean(text or "")
    if isinstance(value, _Number):  # alone, it stands as it is written
        return _clean(text) if _leaf(value) else ""
    return _whole(_compact(value))


def compact_value(json: Column) -> Column:
    """A nested value as text, in the order of its JSON: ``key: value`` and members of lists, joined by semicolons. Empty, false and zero values are left out.

    What is no JSON is text.
    """

    @F.pandas_udf("string")
    def texts(values: pd.Series) -> pd.Series:
        return values.map(_compact_text)

    return texts(json)


def page_events(pages: DataFrame) -> DataFrame:
    """``page_id, ord, start, end, name, location, sessions`` of every dated event that a page's scripts hold (``page_id, jsonld``)."""
    return pages.select("page_id", F.posexplode(events(F.col("jsonld"))).alias("ord", "e")).select("page_id", "ord", "e.*")

"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What evidence sentences are tagged with, in order.
SIGNALS: list[tuple[str, str]] = [
    ("deadline", r"(?i)\b(deadline|apply by|applications? (?:close|due))\b"),
    ("fee", r"(?i)\b(fee|fees|cost|tuition|price)\b|€|£|\$"),
    ("funding", r"(?i)\b(funding|funded|scholarship|grant|bursary|stipend)\b"),
    ("duration", r"(?i)\b(days?|weeks?|duration)\b"),
    ("mode", r"(?i)\b(online|in[- ]person|hybrid|on[- ]site|virtual)\b"),
    ("eligibility", r"(?i)\b(eligib\w*|participants?|open to|phd|doctoral|postdoc\w*)\b"),
    ("dates", r"\b20\d{2}\b"),
]
TITLE_CUTS = (" | ", " - ", " • ", " :: ")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row even where ``body`` uses it inside lambdas (the optimiser would put a projected expression back into them)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that later expressions read and do not repeat: the optimiser puts projected expressions in place of their names, but not generated ones."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def lowered(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``body`` of a text and of the text in lower case, both bound once (a name inside a lambda could be taken for another column of the same select)."""
    return let(F.struct(text.alias("t"), F.lower(text).alias("low")), lambda both: body(both["t"], both["low"]))


def has_any(low: Column, words: Sequence[str]) -> Column:
    """Whether a text in lower case holds any of the words: much cheaper than a pattern that needs one of them."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def clean_space(text: Column) -> Column:
    """White space runs, Unicode ones too, become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term is a substring, ignoring case. Null text: false."""
    if not terms:
        return F.lit(False)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t)))


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return F.lit(0)
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(low, t))))


def first_term(text: Column, terms: Sequence[str], default: str = "") -> Column:
    """The first term in list order that the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms], F.lit(default))


def first_match(text: Column, patterns: Sequence[str], needs: Sequence[Sequence[str]] = ()) -> Column:
    """Group 1 (or the whole match) of the first pattern that matches; empty without a match. ``needs``: for each pattern words of which every match holds one."""

    def first(t: Column, held: list[Column]) -> Column:
        group = lambda p: 1 if "(" in p.replace("(?", "").replace(r"\(", "") else 0
        return F.coalesce(*[F.when(h & (F.regexp_instr(t, F.lit(p)) > 0), F.regexp_extract(t, p, group(p))) for h, p in zip(held, patterns, strict=True)], F.lit(""))

    return lowered(text, lambda t, low: first(t, [has_any(low, words) for words in needs])) if needs else first(text, [F.lit(True) for _ in patterns])


def evidence_window(text: Column, pattern: str, radius: int = 120, needs: Sequence[str] = ()) -> Column:
    """The match and ``radius`` characters after it, cleaned; it never looks back. Empty without a match. ``needs``: words of which every match holds one."""

    def window(t: Column, held: Column) -> Column:
        at = F.regexp_instr(t, F.lit(pattern))
        span = F.length(F.regexp_extract(t, pattern, 0)) + radius
        return F.when(held & (at > 0), clean_space(F.substr(t, at, span))).otherwise(F.lit(""))

    return lowered(text, lambda t, low: window(t, has_any(low, needs))) if needs else window(text, F.lit(True))


def clean_title(title: Column, limit: int = 140) -> Column:
    """Cut at each separator in turn, clean, and cap."""
    out = clean_space(title)
    for cut in TITLE_CUTS:
        out = F.split_part(out, F.lit(cut), F.lit(1))
    return F.substring(F.trim(out), 1, limit)


def normalise_title(title: Column) -> Column:
    """Lower case without four-digit years; anything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"\b\d{4}\b", ""), "[^a-z0-9]+", " "))


def normalise_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "|", " "), r"\s+", " "))


def shorten(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space where there is one."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, r"^(.*\S)\s+\S*$", 1)
    return F.when(F.length(text) <= limit, text).when(cut != "", cut).otherwise(head)


def slug(text: Column, limit: int = 70) -> Column:
    out = F.regexp_replace(F.lower(text), r"(?U)[^\p{Alnum}]+", "-")
    return F.substring(F.regexp_replace(out, "^-+|-+$", ""), 1, limit)


def stable_filename(title: Column, key: Column, suffix: str = ".html") -> Column:
    return F.concat(F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("item")), F.lit("-"), F.substring(F.sha1(key), 1, 8), F.lit(suffix))


def signals(text: Column) -> Column:
    """Names of the signals that a sentence carries, in their fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SIGNALS]))


def sentences(text: Column) -> Column:
    """Sentences by end marks and line breaks, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), clean_space), lambda s: s != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Overlapping windows of ``size`` characters of the cleaned text; the last one reaches its end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    step = size - overlap
    # Rows of ``step`` characters each, split once: taking the n-th part of a text by its place would count from its start again.
    part = rf"(?s).{{1,{step}}}"

    def cut(parts: Column) -> Column:
        whole = -(-size // step)  # rows that a window reaches into
        last = F.greatest(F.ceil((F.greatest((F.size(parts) - 1) * step + F.length(F.try_element_at(parts, F.lit(-1))), F.lit(0)) - F.lit(size)) / F.lit(step)), F.lit(0)).cast("int")
        one = lambda i: F.trim(F.substring(F.concat(*[F.coalesce(F.get(parts, i + k), F.lit("")) for k in range(whole)]), 1, size))
        return F.filter(F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), one), lambda c: c != "")

    return let(F.regexp_extract_all(clean_space(F.coalesce(text, F.lit(""))), F.lit(part), F.lit(0)), cut)


def markdown_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|<>])", r"\\$1")


def ics_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, safe in ((";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out

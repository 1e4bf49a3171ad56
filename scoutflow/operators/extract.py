"""What pages say: one HTML parse, then expressions over the parsed columns."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions import dates
from scoutflow.functions import text as tx
from scoutflow.functions.batches import in_batches

PARSED = (
    "struct<title:string,text:string,headings:array<string>,links:array<struct<href:string,label:string,card:string>>,jsonld:array<string>,lines:array<string>,"
    "pieces:array<string>,heads:array<array<string>>,shared_title:string,marked:array<struct<tag:string,classes:array<string>,title:string,href:string,text:string>>>"
)
# Funding kinds and the phrases that offer them, in order.
FUNDING = [
    (
        "travel grant",
        r"travel grant[s]?|travel bursar(?:y|ies)|travel support"
        r"|travel costs?[^.\n]{0,20}(?:covered|reimbursed)"
        r"|covers?[^.\n]{0,20}(?:travel costs?|airfare|flights?)",
    ),
    ("scholarship", r"scholarship[s]?"),
    ("bursary", r"bursar(?:y|ies)"),
    (
        "fellowship",
        r"fellowship[s]?\s+(?:are|is)?\s*(?:available|offered|awarded|provided|on offer)"
        r"|(?:travel|attendance|mobility|registration)\s+fellowship[s]?"
        r"|(?:offers?|provides?|awards?|grant(?:s|ed)?)\s+(?:\w+\s+){0,2}fellowship[s]?"
        r"|fellowship[s]?\s+(?:to|for)\s+(?:attend|participat)",
    ),
    ("tuition waiver", r"tuition waiver[s]?"),
    ("fee waiver", r"fee waiver[s]?|registration (?:fee )?waiver|waived (?:registration|tuition) fee"),
    ("stipend", r"stipend[s]?"),
    (
        "accommodation support",
        r"accommodation support|covered accommodation|accommodation is covered|free accommodation"
        r"|(?:accommodation|board and lodging|board|lodging|meals?)\s+(?:is|are|will be)?\s*(?:provided|covered|included)"
        r"|covers?\s+(?:accommodation|board|lodging|subsistence|meals)",
    ),
    (
        "financial support",
        r"(?:financial|funding) support\s+(?:(?:is|will be)\s+)?(?:available|offered|provided)"
        r"|funding (?:is )?available"
        r"|fully funded|all costs?[^.\n]{0,15}covered",
    ),
]
NEGATION = r"\b(?:no|not|without|cannot|can't|won't)\b|self[- ]funded|own (?:expense|cost)"
LEVELS = [("MSc", r"(?i)\bMSc\b|master"), ("PhD", r"(?i)\bPhD\b|doctoral"), ("postdoc", "(?i)postdoc"), ("early-career researcher", r"(?i)early[- ]career")]
# Signs of being there and of being online, in order of trial.
IN_PERSON = [
    r"in[- ]person", r"on[- ]?site", r"residential", r"field school", r"venue", r"hosted in", r"will be hosted at",
    r"will (?:take place|be held) in (?!an? (?:online|virtual))", r"course at (?:EMBL|the European Bioinformatics Institute)",
]
ONLINE = [r"online-only", r"fully online", r"online course", r"webinar"]
# What closes applications whatever else is said, what closes them unless they are said to be open, and what says that they are to open.
STRONG_CLOSED = [
    r"no\s+longer\s+accepting\s+applications",
    r"selection\s+(?:notifications?|results?)[^.]{0,30}(?:released|sent|announced|out)",
    r"application(?:s)?\s+(?:period|window)[^.]{0,20}(?:closed|ended|over)",
    r"(?<!early\s)registration\s+is\s+closed",
]
WEAK_CLOSED = [
    r"(?:applications?|registration)[^.]{0,30}has\s+passed",
    r"applications?[^.]{0,25}(?:are|have|is|now)[^.]{0,15}closed",
    r"applications?\s+(?:are\s+|have\s+|has\s+)?closed",
    r"registration[^.]{0,25}(?:is\s+)?closed",
]
NOT_OPEN = [
    r"applications?[^.\n]{0,40}(?:not yet|not currently)\s+open",
    r"registration[^.\n]{0,40}(?:not yet|not currently)\s+open",
    r"(?:applications?|registration)[^.\n]{0,40}(?:will|is expected to)\s+open",
]
OPEN = [
    r"applications?[^.]{0,15}(?:are|is)[^.]{0,10}open",
    r"apply\s+(?:now|here|online|today|by)",
    r"now\s+accepting\s+applications",
    r"applications?\s+(?:are\s+)?(?:invited|welcome)",
    r"call\s+for\s+applications",
    r"registration[^.]{0,15}(?:is\s+)?open",
    r"applications?\s+open",
]
# Participants who pay for themselves, the funding that this leaves in doubt, and words of funding.
OWN_COST = (
    r"\b(?:applicants?|participants?|students?)\s+"
    r"(?:(?:are|remain|will be)\s+responsible\s+for[^.\n]{0,220}"
    r"(?:fees?|costs?|expenses?|travel|accommodation)"
    r"|(?:must|should|will)\s+(?:cover|pay|fund)[^.\n]{0,100}\bown\b[^.\n]{0,80}"
    r"(?:fees?|costs?|expenses?|travel|accommodation))\b"
)
VAGUE_FUNDING = "financial support"
FUNDING_WORDS = r"scholarship|travel grant|tuition waiver|stipend|financial support|funding"
ONE_DATE = rf"(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{dates.MONTH_WORD}\s+20\d{{2}}|{dates.MONTH_WORD}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+20\d{{2}}|20\d{{2}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]20\d{{2}})"
LOGISTICS = re.compile("accommodation|hotel|lodging|reservation|booking|payment", re.I)
WIDEST, LOOK_BACK = 120, 60
# Words of which every match of a pattern holds one: on texts without them, which are most, the pattern is not tried.
NEEDS = {
    **dict(zip((p for _, p in FUNDING), [
        ("travel", "airfare", "flight"), ("scholarship",), ("bursar",), ("fellowship",), ("tuition waiver",), ("waive",), ("stipend",), ("accommodation", "board", "lodging", "meal", "subsistence"),
        ("support", "funding", "funded", "covered"),
    ], strict=True)),
    **dict(zip((p for _, p in LEVELS), [("msc", "master"), ("phd", "doctoral"), ("postdoc",), ("early",)], strict=True)),
    **dict(zip(IN_PERSON, [("person",), ("site",), ("residential",), ("field school",), ("venue",), ("hosted in",), ("will be hosted at",), ("take place in", "be held in"), ("course at",)], strict=True)),
    **dict(zip(ONLINE, [("online-only",), ("fully online",), ("online course",), ("webinar",)], strict=True)),
    **dict(zip(STRONG_CLOSED, [("accepting",), ("selection",), ("period", "window"), ("closed",)], strict=True)),
    **dict(zip(WEAK_CLOSED, [("passed",), ("closed",), ("closed",), ("closed",)], strict=True)),
    **dict(zip(NOT_OPEN, [("open",), ("open",), ("open",)], strict=True)),
    **dict(zip(OPEN, [("open",), ("apply",), ("accepting",), ("invited", "welcome"), ("call",), ("open",), ("open",)], strict=True)),
    "hybrid": ("hybrid",), OWN_COST: ("responsible", "must", "should", "will"), FUNDING_WORDS: ("scholarship", "travel grant", "tuition waiver", "stipend", "financial support", "funding"),
}


class _Reader(HTMLParser):
    """Collects what the extraction needs in one pass."""

    HIDDEN, BREAKS, CARDS = {"script", "style", "noscript"}, {"p", "div", "li", "tr", "br", "h1", "h2", "h3", "h4", "section", "article", "td", "th"}, {"article", "li"}
    HEADS, MOST_HEADS = {"h1", "h2"}, 8

    def __init__(self, classes: frozenset[str] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces, self.heads, self.head, self.shared_title = [], [], None, ""
        self.classes, self.marked, self.marking = classes, [], []
        self.title, self.words, self.headings, self.links, self.jsonld, self.lines, self.line = "", [], [], [], [], [], []
        self.hidden, self.heading, self.anchor, self.in_title, self.data = 0, None, None, False, None
        self.cards: list[tuple[int, int]] = []

    def updatepos(self, i, j):
        return j  # lines are not counted: nobody asks where a tag stands

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.data = []
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and a.get("href"):
            self.anchor = [a["href"], []]
        if tag in ("h1", "h2", "h3"):
            self.heading = []
        if tag in self.HEADS:
            self.head = []
        if tag == "meta" and a.get("property") == "og:title":
            self.shared_title = self.shared_title or " ".join((a.get("content") or "").split())
        self._mark(tag, a)
        if tag in self.CARDS:
            self.cards.append((len(self.words), len(self.links)))
        if tag in self.BREAKS:
            self._break()

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            if self.data is not None:
                self.jsonld.append("".join(self.data).strip())
                self.data = None
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.anchor:
            self.links.append([self.anchor[0], _clean(self.anchor[1]), ""])
            self.anchor = None
        elif tag in ("h1", "h2", "h3") and self.heading is not None:
            self.headings.append(_clean(self.heading))
            self.heading = None
        if tag in self.HEADS and self.head is not None:
            if len(self.heads) < self.MOST_HEADS:
                self.heads.append(_lines(self.head))
            self.head = None
        for open_ in self.marking:
            open_[1] -= open_[0] == tag
        self.marking = [x for x in self.marking if x[1]]
        if tag in self.CARDS and self.cards:
            start, first = self.cards.pop()
            for link in self.links[first:]:
                link[2] = link[2] or _clean(self.words[start:])
        if tag in self.BREAKS:
            self._break()

    def handle_data(self, data):
        if self.data is not None:
            self.data.append(data)
        if self.hidden:
            return
        self.pieces.append(data)
        if self.in_title:
            self.title += data
            return
        for sink in (self.words, self.line, self.heading, self.head, self.anchor[1] if self.anchor else None, *(x[2]["text"] for x in self.marking)):
            if sink is not None:
                sink.append(data)

    def _mark(self, tag, a):
        """Open elements of the wanted classes gather their text and their first link."""
        for open_ in self.marking:
            open_[1] += open_[0] == tag
            open_[2]["href"] = open_[2]["href"] or (a.get("href") or "" if tag == "a" else "")
        held = self.classes.intersection((a.get("class") or "").split()) if self.classes else ()
        if held:
            self.marked.append({"tag": tag, "classes": sorted(held), "title": a.get("title"), "href": a.get("href") or "", "text": []})
            self.marking.append([tag, 1, self.marked[-1]])

    def _break(self):
        if self.line and (text := _clean(self.line)):
            self.lines.append(text)
        self.line = []


def _clean(parts: list[str]) -> str:
    return " ".join(" ".join(parts).split())


def _lines(parts: list[str]) -> list[str]:
    return [t for p in parts for line in p.splitlines() if (t := " ".join(line.split()))]


def _read(page: str | None, classes: frozenset[str] = frozenset()) -> tuple:
    reader = _Reader(classes)
    reader.feed(page or "")
    reader.close()
    reader._break()
    marked = [(m["tag"], m["classes"], m["title"], m["href"], _clean(m["text"])) for m in reader.marked]
    links = [tuple(link) for link in reader.links]
    return " ".join(reader.title.split()), _clean(reader.words), [h for h in reader.headings if h], links, reader.jsonld, reader.lines, _lines(reader.pieces), reader.heads, reader.shared_title, marked


_TEXT, _TEXTS = pa.string(), pa.list_(pa.string())
_PARSED = pa.struct([
    ("title", _TEXT), ("text", _TEXT), ("headings", _TEXTS), ("links", pa.list_(pa.struct([("href", _TEXT), ("label", _TEXT), ("card", _TEXT)]))), ("jsonld", _TEXTS), ("lines", _TEXTS), ("pieces", _TEXTS),
    ("heads", pa.list_(_TEXTS)), ("shared_title", _TEXT), ("marked", pa.list_(pa.struct([("tag", _TEXT), ("classes", _TEXTS), ("title", _TEXT), ("href", _TEXT), ("text", _TEXT)]))),
])


def parsed_page(html: Column, classes: Sequence[str] = ()) -> Column:
    """Title, visible text, headings, links with labels and card text, JSON-LD scripts and text lines. A null page has none.

    ``pieces`` are the lines of all texts between tags, ``heads`` those of each of the first headings; ``marked`` are the elements of the
    given ``classes`` with their text and first link.
    """
    wanted = frozenset(classes)

    def parse(page: str | None) -> tuple:
        return _read(page, wanted)

    return in_batches(PARSED, _PARSED, parse, html)


_MONTHS = {m: i for i, m in enumerate(dates.MONTHS.lower().split("|"), 1)}
_DAY, _WORD, _TO = r"(\d{1,2})(?:st|nd|rd|th)?", r"([A-Z][a-z]+)", r"\s*(?:to|-|–|—|until|through)\s*(?:(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day\s*,?\s*)?"
# Spans in order of trust; each names the groups of day, month and year of both ends.
_SPANS = [
    (re.compile(rf"{_DAY}\s+{_WORD}\s+(20\d{{2}}){_TO}{_DAY}\s+{_WORD}\s+(20\d{{2}})"), (1, 2, 3, 4, 5, 6)),
    (re.compile(rf"{_WORD}\s+{_DAY},?\s+(20\d{{2}}){_TO}{_WORD}\s+{_DAY},?\s+(20\d{{2}})"), (2, 1, 3, 5, 4, 6)),
    (re.compile(rf"(20\d{{2}})-(\d{{2}})-(\d{{2}}){_TO}(20\d{{2}})-(\d{{2}})-(\d{{2}})"), (3, 2, 1, 6, 5, 4)),
    (re.compile(rf"{_DAY}\s+{_WORD}{_TO}{_DAY}\s+{_WORD},?\s+(20\d{{2}})"), (1, 2, 5, 3, 4, 5)),
    (re.compile(rf"{_WORD}\s+{_DAY}{_TO}{_WORD}\s+{_DAY},?\s+(20\d{{2}})"), (2, 1, 5, 4, 3, 5)),
    (re.compile(rf"{_WORD}\s+{_DAY}{_TO}{_DAY},?\s+(20\d{{2}})"), (2, 1, 4, 3, 1, 4)),
    (re.compile(rf"{_DAY}{_TO}{_DAY}\s+{_WORD}\s+(20\d{{2}})"), (1, 3, 4, 2, 3, 4)),
]


def _day(day: str, month: str, year: str) -> date | None:
    number = int(month) if month.isdigit() else _MONTHS.get(month[:3].lower(), 0)
    try:
        return date(int(year), number, int(day))
    except ValueError:
        return None


# What joins the ends of a span, and what may stand behind it where a span goes on; by what stands before it, the places in _SPANS of those that can.
_JOIN = re.compile(r"(?:to|-|–|—|until|through)\s*(?:(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day\s*,?\s*)?(?=[A-Z\d])")
_BEHIND = [re.compile(p) for p in (r"\d{1,2}(?:st|nd|rd|th)?\s+[A-Z]", r"[A-Z][a-z]+\s+\d", r"\d{1,2}(?:st|nd|rd|th)?,?\s+20\d", r"20\d{2}-")]
_AFTER_NUMBER, _AFTER_WORD = ((0, 0), (1, 1), (3, 2), (1, 4), (2, 5), (0, 6)), ((0, 3),)


def _may_stand(text: str) -> set[int]:
    """Places in ``_SPANS`` of the patterns that can match: all that do, and few others."""
    some: set[int] = set()
    for m in _JOIN.finditer(text):
        end = m.start()
        while end and text[end - 1].isspace():
            end -= 1
        before = text[max(0, end - 2) : end]
        tries = _AFTER_NUMBER if before[-1:].isdigit() or before in ("st", "nd", "rd", "th") else ()
        tries += _AFTER_WORD if before[-1:].islower() else ()
        some.update(at for behind, at in tries if at not in some and _BEHIND[behind].match(text, m.end()))
    return some


def spans(text: str | None) -> list[tuple[date, date, str]]:
    """Distinct date ranges of at most 120 days, in order of trust and then of place, without those that follow words of lodging or payment."""
    found: dict[tuple[date, date], str] = {}
    if not text or "20" not in text:
        return []
    for pattern, groups in [_SPANS[at] for at in sorted(_may_stand(text))]:
        for m in pattern.finditer(text):
            start, end = _day(*(m[g] for g in groups[:3])), _day(*(m[g] for g in groups[3:]))
            if start and end and 0 <= (end - start).days <= WIDEST and not LOGISTICS.search(text[max(0, m.start() - LOOK_BACK) : m.start()]):
                found.setdefault((start, end), " ".join(m[0].split()))
    return [(a, b, e) for (a, b), e in found.items()]


def date_ranges(text: Column) -> Column:
    return in_batches("array<struct<start:date,end:date,evidence:string>>", pa.list_(pa.struct([("start", pa.date32()), ("end", pa.date32()), ("evidence", pa.string())])), spans, text)


def funding_offered(text: Column, pattern: str) -> Column:
    """Whether the phrase stands anywhere without a negation in the thirty characters before it."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)(?=((?:.{{30}}|^.{{0,29}})(?:{pattern})))."), F.lit(1))
    head = F.when(F.regexp_instr(text, F.lit(rf"(?i)^(?:{pattern})")) == 1, F.lit(True)).otherwise(F.lit(False))
    # Most texts hold none of the phrase: those need no look at what stands before it.
    return says(text, [pattern]) & (head | F.exists(found, lambda m: ~F.regexp_replace(m, rf"(?is)(?:{pattern})$", "").rlike(rf"(?i){NEGATION}")))


def funding_types(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(funding_offered(text, p), F.lit(n)) for n, p in FUNDING]))


def says(text: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns (all of them in ``NEEDS``) matches, ignoring case."""
    return tx.lowered(text, lambda t, low: reduce(lambda a, b: a | b, [tx.has_any(low, NEEDS[p]) & t.rlike(f"(?i){p}") for p in patterns]))


def mode_of(text: Column) -> Column:
    here, there, mixed = says(text, IN_PERSON), says(text, ONLINE), says(text, ["hybrid"])
    return F.when(here & mixed, "hybrid").when(here, "in-person").when(there, "online").when(mixed, "hybrid").otherwise("uncertain")


def mode_evidence(text: Column, radius: int = 50) -> Column:
    """The first sign of a mode, in order of trial, with the ``radius`` characters after it; empty without one."""
    one = lambda t, p: F.nullif(tx.clean_space(F.regexp_extract(t, rf"(?is)(?:{p}).{{0,{radius}}}", 0)), F.lit(""))
    first = tx.lowered(text, lambda t, low: F.coalesce(*[F.when(tx.has_any(low, NEEDS[p]), one(t, p)) for p in [*IN_PERSON, *ONLINE, "hybrid"]]))
    return F.coalesce(first, F.lit(""))


def application_status(text: Column, deadline: Column, as_of: Column) -> Column:
    """Closed or not open by what the page says, else by the deadline. A passed deadline of something else, or a weak sign beside an open one, closes nothing."""
    closed = says(text, STRONG_CLOSED) | says(text, WEAK_CLOSED) & ~says(text, OPEN)
    return F.when(closed, "closed").when(says(text, NOT_OPEN), "not_open").when(deadline.isNull(), "uncertain").when(deadline >= as_of, "open").otherwise("closed")


def level_of(text: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*[F.when(says(text, [p]), F.lit(n)) for n, p in LEVELS])), ", "), F.lit("")), F.lit("uncertain"))


def topics_in(text: Column, topics: list[str]) -> Column:
    """Topics that the text names; those of up to three letters only as whole words."""
    tests = [F.when(text.rlike(rf"(?i)\b{re.escape(t)}\b" if len(t) <= 3 else rf"(?i){re.escape(t)}"), F.lit(t)) for t in topics]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")

"""Catalogues of cards: one page cut into its repeated cards, and what the pages behind a card's links add, hop by hop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import urls
from scoutflow.functions.batches import in_batches
from scoutflow.operators import coverage
from scoutflow.operators.deadlines import chosen_deadline, deadlines
from scoutflow.operators.extract import parsed_page

CARDS = "array<struct<text:string,links:array<struct<href:string,label:string>>>>"
_CARDS = pa.list_(pa.struct([("text", pa.string()), ("links", pa.list_(pa.struct([("href", pa.string()), ("label", pa.string())])))]))
# Hosts that are no event's own page.
SOCIAL = ["facebook.com", "twitter.com", "x.com", "linkedin.com", "youtube.com", "instagram.com"]
# Gives ``url, html`` (null where there is no page) for ``url``.
Fetch = Callable[[DataFrame], DataFrame]


class _Cards(HTMLParser):
    """Texts and links of all elements that carry each of the wanted classes; cards in cards are cards too."""

    def __init__(self, wanted: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.found, self.open, self.hidden, self.link = wanted, [], [], 0, None

    def updatepos(self, i, j):
        return j  # lines are not counted: nobody asks where a tag stands

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.hidden += 1
        for card in self.open:
            card[1] += card[0] == tag
        if self.wanted <= set((a.get("class") or "").split()):
            self.found.append(([], []))
            self.open.append([tag, 1, self.found[-1]])
        if tag == "a" and a.get("href"):
            self.link = (a["href"], [])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        if tag == "a" and self.link:
            for card in self.open:
                card[2][1].append((self.link[0], " ".join(" ".join(self.link[1]).split())))
            self.link = None
        for card in self.open:
            card[1] -= card[0] == tag
        self.open = [card for card in self.open if card[1]]

    def handle_data(self, data):
        if self.hidden:
            return
        if self.link:
            self.link[1].append(data)
        for card in self.open:
            card[2][0].append(data)


def cards(html: Column, page_url: Column, classes: Sequence[str]) -> Column:
    """The page's cards in order, with their text and their links made absolute. A null page has none."""
    wanted = frozenset(classes)

    def cut(page: str | None, base: str | None) -> list[tuple]:
        reader = _Cards(wanted)
        reader.feed(page or "")
        reader.close()
        whole = {h: urljoin(base or "", h) for h in {h for _, links in reader.found for h, _ in links}}
        return [(" ".join(" ".join(words).split()), [(whole[h], t) for h, t in links]) for words, links in reader.found]

    return in_batches(CARDS, _CARDS, cut, html, page_url)


def listed_events(pages: DataFrame, classes: Sequence[str], path: str) -> DataFrame:
    """``page_url, ord, url, title, start, end, text`` of a listing's dated cards (``page_url, html``).

    A card's link is the one below ``path`` with the longest label, which is its title; of cards with the same link the first on its page counts.
    """
    rows = pages.select("page_url", F.posexplode(cards(F.col("html"), F.col("page_url"), classes)).alias("ord", "card"))
    named = F.filter("card.links", lambda x: F.contains(x["href"], F.lit(path)) & (x["label"] != ""))
    best = F.array_max(F.transform(named, lambda x, i: F.struct(F.length(x["label"]).alias("n"), (-i).alias("at"), x["href"].alias("url"), x["label"].alias("title"))))
    rows = rows.select("page_url", "ord", best.alias("best"), coverage.listing_range(F.col("card.text")).alias("range"), F.col("card.text").alias("text"))
    dated = rows.filter("best is not null and range.start is not null and range.end is not null").select("page_url", "ord", "best.url", "best.title", "range.start", "range.end", "text")
    # Aggregated, not joined to its own firsts: that cut every page a second time. Column by column, so that a text nobody asks for does not travel.
    first = dated.groupBy("page_url", "url").agg(*[F.min_by(c, "ord").alias(c) for c in ("title", "start", "end", "text")], F.min("ord").alias("ord"))
    return first.select("page_url", "ord", "url", "title", "start", "end", "text")


@dataclass(frozen=True)
class Hop:
    """A kind of link that is followed from each page of the hop before: at most ``limit`` a page, in the page's order."""

    name: str
    follows: Callable[[Column, Column], Column]
    limit: int = 3


def is_registration(href: Column, label: Column) -> Column:
    return F.contains(F.lower(label), F.lit("regist")) & F.lower(label).rlike("registration|register") | F.contains(F.lower(href), F.lit("registration"))


def is_outside(own: Sequence[str]) -> Callable[[Column, Column], Column]:
    """Links that lead to another site than the catalogue's, social networks aside."""
    return lambda href, _: (urls.host(href) != "") & ~urls.host_matches(urls.host(href), [*own, *SOCIAL])


def chained(origins: DataFrame, fetch: Fetch, hops: Sequence[Hop]) -> DataFrame:
    """``origin, hop, path, url, text`` of all pages that the hops reach from ``origins`` (``origin, url``).

    Every page of a hop is fetched once, however many origins lead there; ``path`` holds the place of each link followed, so pages in its order are those
    of a reader who follows every link before going back. A page that could not be fetched ends its branch.
    """
    frontier = origins.select("origin", F.array(F.lit(0)).alias("path"), "url")
    reached = None
    for at, name in enumerate(["first", *[h.name for h in hops]]):
        got = fetch(frontier.select("url").distinct())
        pages = got.filter("html is not null").select("url", parsed_page(F.col("html")).alias("p")).select("url", "p.text", "p.links").dropDuplicates(["url"])
        here = frontier.join(pages, "url").checkpoint()
        rows = here.select("origin", F.lit(name).alias("hop"), "path", "url", "text")
        reached = rows if reached is None else reached.unionByName(rows)
        if at < len(hops):
            hop = hops[at]
            kept = F.slice(F.filter("links", lambda x: hop.follows(x["href"], x["label"])), 1, hop.limit)
            frontier = here.select("origin", "path", F.posexplode(kept).alias("n", "link")).select("origin", F.concat("path", F.array("n")).alias("path"), F.col("link.href").alias("url"))
    return reached


def catalogue_records(pages: DataFrame, fetch: Fetch, classes: Sequence[str], path: str, own: Sequence[str], as_of: Column) -> DataFrame:
    """Editions of a catalogue (``page_url, html``) that have not ended: ``url, title, start_date, end_date, deadline, fee, fee_eur, n_pages``.

    Deadline and fee come from the pages behind the card: its own, then registration and outside pages, then their registration pages. A deadline with a year beats those without,
    of which the latest counts.
    """
    events = listed_events(pages, classes, path).filter(F.col("end") >= as_of).dropDuplicates(["url"]).checkpoint()
    either = lambda href, label: is_registration(href, label) | is_outside(own)(href, label)
    found = chained(events.select(F.col("url").alias("origin"), "url"), fetch, [Hop("follow-up", either), Hop("registration", is_registration)])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda r: r["text"]), " ")
    said = found.groupBy("origin").agg(texts.alias("said"), F.count(F.lit(1)).alias("n_pages"))
    rows = events.join(said.withColumnRenamed("origin", "url"), "url", "left").withColumn("said", F.coalesce("said", F.lit("")))
    rows = rows.select("*", deadlines(F.col("said")).alias("dated"), deadlines(F.col("said"), F.col("start")).alias("all"), coverage.fee_table(F.col("said")).alias("f"))
    deadline = F.coalesce(chosen_deadline(F.col("dated"))["day"], F.array_max(F.transform("all", lambda d: d["day"])))
    return rows.select("url", "title", F.col("start").alias("start_date"), F.col("end").alias("end_date"), deadline.alias("deadline"), F.when(F.col("f.amount").isNotNull(), F.col("f.label")).otherwise("").alias("fee"), F.col("f.amount").alias("fee_eur"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"))

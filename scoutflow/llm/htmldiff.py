"""Main text of web pages by differencing against the page of nearest URL.

A page is read into blocks of text. Pages are paired within their host with the neighbour in path order that
shares the longest path and is not a copy of the page; a longest common subsequence aligns the two pages' blocks, and blocks that both have are
template and go, inside the main element too. Blocks inside an article are the author's own and stay even when a
neighbour repeats them; blocks under elements whose role is named (navigation, footer, advertisement and so on) go in
any case, and so do blocks outside of article and main where these hold the longer part of what is left.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoutflow.llm.common import load, written

# Elements of the HTML standard by what they do here.
RAW = {"script", "style", "template", "noscript", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "head", "select", "noembed", "noframes", "xmp"}
CHROME = {"nav", "footer", "aside", "form", "dialog", "menu", "button", "fieldset", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTENT = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
# Words of class and id names that mark page furniture.
MARKS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "widget", "ad", "ads",
    "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup",
    "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus",
    "respond", "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer",
}
# Pages looked at on each side of a page in path order, and the share of a page's characters from which another is its copy.
NEAR, COPY = 4, 0.9
BESIDES = {"has", "with", "no", "without", "and"}
# Names written as one word, and what an id inside content may say besides a mark (else it is an anchor: related-work, social-history).
RUN_TOGETHER = {"commentlist", "commentform", "commentbox", "commentarea", "commentsection", "commentthread", "adsbygoogle", "adbox", "adslot", "adunit", "sharebar", "sociallinks"}
MARK_ENDS = ("nav", "navbar", "menu", "sidebar", "footer", "breadcrumb", "breadcrumbs")
AROUND = {"box", "list", "container", "wrapper", "wrap", "block", "area", "form", "links", "posts", "articles", "items", "bar", "buttons", "section", "inner", "outer", "left", "right", "top", "bottom", "main"}
ID_TAGS = {"div", "ul", "ol", "dl", "table", "details", "header"}
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")
# A paragraph ends where one of these begins.
ENDS_P = BLOCK - {"html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "summary", "legend", "figcaption"}


def is_mark(word: str) -> bool:
    return word in MARKS or word in RUN_TOGETHER or word.endswith(MARK_ENDS)


def marked(name: str, inside: bool = False) -> bool:
    """Whether a class or id names page furniture. ``has-sidebar`` and the like name what an element goes with; a header inside content is its heading."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    return any(is_mark(w) and not (inside and w == "header") and (i == 0 or words[i - 1] not in BESIDES) for i, w in enumerate(words))


def anchor(tag: str, name: str) -> bool:
    """Whether an id inside content is a place to link to: that of a heading, a section or text, or one with words of its own."""
    return tag not in ID_TAGS or not all(is_mark(w) or w in AROUND for w in map(str.lower, NAME_WORD.findall(name)))


def furniture(tag: str, attributes: str, inside: bool = False) -> bool:
    """Whether an element's name, role, class, id or hiddenness says that it is not part of the article; ``inside``: it stands in content.

    An article may be a comment or a teaser by its class. A heading's class says nothing, and inside content ids are mostly anchors.
    """
    if tag in CHROME:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name not in ("class", "id") or tag == "main" or inside and tag in HEADINGS:
            continue
        own = inside or tag == "article"
        if any(marked(part, own) and not (name == "id" and own and tag != "article" and anchor(tag, part)) for part in value.split()):
            return True
    return False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order, each with 0 (open to doubt), 1 (inside the main element), 2 (inside the article) or -1 (furniture)."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    # Open elements: tag, whether it is furniture, whether it is article content.
    stack: list[tuple[str, int, int]] = []
    chrome = content = article = 0
    hushed = 0  # open furniture within a line: its words are no part of the block around it
    # Where in the stack the open elements of each name stand, and all open blocks: no stray tag asks for a walk down the stack.
    places: dict[str, list[int]] = {}
    open_blocks: list[int] = []
    head_seen = False
    source = page or ""

    def flush() -> None:
        nonlocal text
        if text:
            line = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if line:
                out.append((line, -1 if chrome else 2 if article else 1 if content else 0))
            text = []

    def close(depth: int) -> None:
        nonlocal chrome, content, article, hushed
        for name, c, k in stack[depth:]:
            chrome -= c
            hushed -= c and name not in BLOCK
            content -= k
            article -= int(name == "article")
            places[name].pop()
        del stack[depth:]
        while open_blocks and open_blocks[-1] >= depth:
            open_blocks.pop()

    def last(*names: str) -> int:
        """Where the innermost open element of these names stands, or -1."""
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    at = 0
    while at < len(source):
        m = TOKEN.search(source, at)
        if m is None:
            text.append("" if hushed else source[at:])
            break
        if m.start() > at:
            text.append("" if hushed else source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK or tag == "br":
                if tag in BLOCK:
                    flush()
                else:
                    text.append(" ")
            depth = last(tag)
            # An inline end tag does not close blocks around it.
            if depth >= 0 and (tag in BLOCK or not open_blocks or depth > open_blocks[-1]):
                close(depth)
            continue
        if tag in RAW and tag != "head":
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|$)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag == "head":
            if head_seen:
                continue
            head_seen = True
            end = re.compile(r"<body(?=[\s>])", re.I)
            stop = end.search(source, at)
            over = re.compile(r"</head\s*>", re.I).search(source, at)
            ends = [x for x in (stop.start() if stop else None, over.end() if over else None) if x is not None]
            at = max(ends) if stop and over and over.end() <= stop.start() else ends[0] if ends else at
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P and (depth := last("p")) >= 0:
                close(depth)
            if tag == "li" and (depth := last("li")) > last("ul", "ol"):
                close(depth)
        elif tag in ("img", "wbr"):
            continue
        if tag in VOID:
            continue
        # A heading inside the article's own header is the article's.
        outer = tag == "header" and not content
        c = int(furniture(tag, m[3], content > 0) or outer)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_blocks.append(len(stack))
        stack.append((tag, c, int(tag in CONTENT)))
        chrome += c
        hushed += c and tag not in BLOCK
        content += int(tag in CONTENT)
        article += int(tag == "article")
    flush()
    return out


def line_hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence with ``b``: equal ends first, then bit-parallel rows."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    shared |= {head + i for i in lcs_places(x, y)}
    return shared


def lcs_ends(x: list[int], y: list[int]) -> int:
    """Bit j is zero where the longest common subsequence of ``x`` and ``y[: j + 1]`` is one longer than with ``y[:j]``."""
    places: dict[int, int] = {}
    for j, h in enumerate(y):
        places[h] = places.get(h, 0) | 1 << j
    full = (1 << len(y)) - 1
    v = full
    for h in x:
        hit = v & places.get(h, 0)
        v = ((v + hit) | (v - hit)) & full
    return v


def lcs_places(x: list[int], y: list[int]) -> Iterator[int]:
    """Places of ``x`` in a longest common subsequence, by halving ``x`` (Hirschberg): memory grows with the lines, not with their product."""
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d or set(x[a:b]).isdisjoint(y[c:d]):
            continue
        if b - a == 1:
            yield a
            continue
        mid = (a + b) // 2
        ahead, behind = lcs_ends(x[a:mid], y[c:d]), lcs_ends(x[mid:b][::-1], y[c:d][::-1])
        n = d - c
        # Common lines of the first half with y[:k] and of the second with y[k:], for each k.
        best, cut, left, right = -1, 0, 0, n - behind.bit_count()
        for k in range(n + 1):
            if left + right > best:
                best, cut = left + right, k
            if k < n:
                left += 1 - (ahead >> k & 1)
                right -= 1 - (behind >> (n - 1 - k) & 1)
        todo += [(a, mid, c, c + cut), (mid, b, c + cut, d)]


def doubtful(found: list[tuple[str, int]]) -> list[int]:
    """Hashes of the blocks outside furniture: what is aligned."""
    return [line_hash(t) for t, kind in found if kind >= 0]


def aligned(lines: list[tuple[str, int]], others: list[list[int]]) -> set[int]:
    """Places that the page shares with the first of ``others`` that is not a copy of it; none where all are.

    The other is a copy where it holds ``COPY`` of this page's characters: a mirror, a print view or a recrawl, which says
    nothing about what is template.
    """
    mine = [line_hash(t) for t, _ in lines]
    chars = sum(len(t) for t, _ in lines)
    for other in others:
        shared = common_lines(mine, other)
        if sum(len(lines[i][0]) for i in shared) < COPY * chars:
            return shared
    return set()


def keep(found: list[tuple[str, int]], others: list[list[int]] | None) -> str:
    """The page's main text, given the line hashes of its neighbours, nearest first (None: no neighbour).

    The alignment decides on all blocks outside an article. What it leaves outside of article and main goes too, unless
    it is longer than what is inside: then the marked part is a teaser.
    """
    lines = [(t, kind) for t, kind in found if kind >= 0]
    shared = aligned(lines, others or [])
    left = [(t, kind) for i, (t, kind) in enumerate(lines) if kind == 2 or i not in shared]
    inside, outside = (sum(len(t) for t, kind in left if (kind > 0) == side) for side in (True, False))
    return "\n".join(t for t, kind in left if kind > 0 or outside > inside)


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [blocks(h) for h in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "lines": [doubtful(f) for f in found], "asks": [any(kind in (0, 1) for _, kind in f) for f in found]})


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parsed blocks, compressed so that the shuffle carries less than the page."""
    for batch in batches:
        data = ["\n".join(f"{kind} {t}" for t, kind in blocks(h) if kind >= 0) for h in batch["html"]]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "packed": [zlib.compress(d.encode("utf-8", "replace"), 3) for d in data]})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for packed, others in zip(batch["packed"], batch["others"]):
            rows = zlib.decompress(packed).decode("utf-8")
            found = [(r.partition(" ")[2], int(r.partition(" ")[0])) for r in rows.split("\n")] if rows else []
            texts.append(keep(found, None if others is None else [list(o) for o in others]))
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def page_lines(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, lines, sig, asks``: one row for each id with its least URL and hash list; ``sig`` names the list.

    A page with no block outside of articles and furniture does not ask: no neighbour can change its text.
    """
    rows = pages.select("page_id", "url", "html").filter("page_id is not null").mapInPandas(_lines, "page_id long, url string, lines array<long>, asks boolean")
    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*)?([^#]*)", 1)
    one = rows.groupBy("page_id").agg(F.min(F.struct(host.alias("host"), path.alias("path"))).alias("k"), F.min("lines").alias("lines"), F.max("asks").alias("asks"))
    return written(one.select("page_id", "k.host", "k.path", "lines", F.xxhash64("lines").alias("sig"), "asks"), "page-lines")


def neighbours(heads: DataFrame) -> DataFrame:
    """``page_id, place, other``: for each row of ``heads`` (``page_id, host, path, asks``) that asks, those near it by path order in its host.

    Path order is taken over range partitions of (host, path), so a host of any size is spread out; only the first and
    last ``NEAR`` rows of each partition meet in one place. The longer common path goes first, then the closer page, then the page before.
    """
    order = ["host", "path", "page_id"]
    spread = written(heads.select(*order, "asks").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "page-order")
    inside = W.partitionBy("part").orderBy(*order)
    this = F.struct(*order)
    near = spread.select(
        *order, "asks", "part", F.collect_list(this).over(inside.rowsBetween(-NEAR, -1)).alias("before"), F.collect_list(this).over(inside.rowsBetween(1, NEAR)).alias("after")
    )
    backwards = W.partitionBy("part").orderBy(*(F.desc(c) for c in order))
    ends = spread.select("part", this.alias("k"), F.row_number().over(inside).alias("i"), F.row_number().over(backwards).alias("j"))
    edges = ends.groupBy("part").agg(
        F.sort_array(F.collect_list(F.when(F.col("i") <= NEAR, F.col("k")))).alias("first"), F.sort_array(F.collect_list(F.when(F.col("j") <= NEAR, F.col("k")))).alias("last")
    )
    across = W.orderBy(F.col("first")[0])
    # A partition may hold fewer rows than are wanted, so the edges of NEAR partitions are handed on.
    hand = edges.select(
        "part", F.flatten(F.collect_list("last").over(across.rowsBetween(-NEAR, -1))).alias("prior"), F.flatten(F.collect_list("first").over(across.rowsBetween(1, NEAR))).alias("next")
    )
    whole = near.join(F.broadcast(hand), "part")

    def side(rows: "F.Column", side: int) -> "F.Column":
        """The ``NEAR`` closest of the same host, with their order."""
        mine, theirs = F.split("path", "/"), lambda x: F.split(x["path"], "/")

        def rank(x: "F.Column", i: "F.Column") -> "F.Column":
            same = F.zip_with(mine, theirs(x), lambda u, v: u.eqNullSafe(v))
            common = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), F.size(same) + 1)
            return F.struct((-common).alias("common"), (i + 1).alias("far"), F.lit(side).alias("side"), x["page_id"].alias("other"))

        return F.filter(F.transform(F.slice(rows, 1, NEAR), lambda x, i: F.when(x["host"] == F.col("host"), rank(x, i))), lambda x: x.isNotNull())

    back = side(F.concat(F.reverse("before"), F.reverse("prior")), 0)
    ahead = side(F.concat(F.col("after"), F.col("next")), 1)
    ranked = whole.filter("asks").select("page_id", F.posexplode(F.sort_array(F.concat(back, ahead))).alias("place", "n"))
    return ranked.select("page_id", "place", "n.other")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages`` (``page_id, url, html``).

    A null or empty html has empty text. Where ids repeat, the least hash list of an id serves as its lines. Pages of one
    host with equal hash lists are copies: one of them stands for all in path order, so none is another's neighbour. Pages
    with a null id, pages alone on their host, and pages with nothing but copies near them are judged by their own markup.
    Outside an article a page keeps the unmarked blocks that its neighbour lacks (see ``keep``).
    """
    keyed = page_lines(pages)
    heads = keyed.filter(F.size("lines") > 0).groupBy("host", "sig").agg(F.min(F.struct("path", "page_id")).alias("k"), F.min("lines").alias("lines"), F.max("asks").alias("asks"))
    heads = written(heads.select("host", "sig", "k.path", "k.page_id", "lines", "asks"), "page-heads")
    found = neighbours(heads).join(heads.select(F.col("page_id").alias("other"), "lines"), "other")
    listed = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("place", "lines"))).alias("ls")).select("page_id", F.col("ls.lines").alias("others"))
    classes = heads.join(listed, "page_id").select("host", "sig", "others")
    other = keyed.filter("asks").select("page_id", "host", "sig").join(classes, ["host", "sig"]).select("page_id", "others")
    packed = pages.select("page_id", "url", "html").mapInPandas(_packed, "page_id long, url string, packed binary")
    return packed.join(other, "page_id", "left").select("page_id", "url", "packed", "others").mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


def op3_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_htmltext": op3_htmltext}
ORACLES: dict[str, str] = {}

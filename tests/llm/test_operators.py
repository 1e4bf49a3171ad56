"""Each corpus operator against brute force, and its defined results on odd inputs."""

from __future__ import annotations

import base64
import hashlib
import html
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scoutflow.llm import components, decontaminate, fuzzyhash, htmldiff, langid, licenses, mixing, neardup, sharding, toxicity, warc
from scoutflow.llm.common import fresh_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
        (2, "alpha beta gamma delta epsilon zeta", "en", "a", 5),
        (3, "", "en", None, 0),
        (4, None, None, "a", None),
        (5, "one two", "fr", "b", 7),
        (5, "one two", "fr", "b", 7),
        (6, LONG, "en", "b", len(LONG)),
        (7, "\n\t .", None, "b", 3),
    ]
    docs = spark.createDataFrame(rows, DOC)
    for name in ("score", "shard", "slot", "rate", "copy", "n", "id", "key", "component", "regs", "toxic", "pos", "row", "bucket", "tie", "len", "hash", "h", "w", "items", "hit_words", "text_key", "size"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# 1 WARC
def test_warc_round_trip(spark):
    body = "a\r\n\r\nWARC/1.1\r\n\r\né"
    rows = [(1, "http://h/x?y#z", body), (2, "http://h/y", body), (3, None, ""), (4, "u v\r\n", None), (None, "http://h/q", body), (5, "http://h/5", "only"), (6, "http://h/6", LONG)]
    out = fresh_path(spark, "t")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), out)
    got = {r["page_id"]: r for r in warc.captures(spark, out).collect()}
    assert len(got) == len(rows)
    for page, _, text in rows:
        data = (text or "").encode()
        assert got[page]["payload_bytes"] == len(data)
        assert got[page]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert [(got[p]["record_type"], got[p]["refers_to"]) for p in (1, 2, 3, 4, None, 5)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("revisit", 2), ("response", None)]
    whole = warc.transactions(warc.read_records(spark, out)).filter("response.warc_type = 'response'")
    assert {bytes(r["response"]["payload"]).decode() for r in whole.collect()} == {body, "", "only", LONG}
    assert all(len(r["requests"]) == len(r["metadata"]) == 1 for r in whole.collect())


def test_warc_threshold_and_empty(spark):
    out = fresh_path(spark, "t")
    warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), out, min_revisit_bytes=3)
    assert {r["record_type"] for r in warc.captures(spark, out).collect()} == {"response"}
    out = fresh_path(spark, "t")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), out)
    assert warc.captures(spark, out).count() == 0


def record(kind, name, block=b"", concurrent=(), **more):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", *(f"WARC-Concurrent-To: <{c}>" for c in concurrent), *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_transactions_of_other_writers(spark, tmp_path):
    import gzip

    http, about = {"Content_Type": "application/http; msgtype=response"}, {"Content_Type": "application/warc-fields"}
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    records = [
        record("response", "r1", body, **http), record("request", "q1", b"GET / HTTP/1.1\r\n\r\n", ["r1"], Content_Type="application/http; msgtype=request"),
        # One metadata record for two responses, one of which has no other companion.
        record("response", "r2", body, **http), record("metadata", "m", b"pageId: 7\r\n", ["r1", "r2"], **about),
        # The response names its companion, not the other way round; another record names nobody there.
        record("response", "r3", body, ["q3"], **http), record("request", "q3", b"GET /3 HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("metadata", "lost", b"pageId: 9\r\n", ["nobody"], **about), record("warcinfo", "i"),
        record("revisit", "v", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<r1>", WARC_Payload_Digest="sha1:X", **http), record("metadata", "mv", b"pageId: 8\r\n", ["v"], **about),
        record("revisit", "w", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<gone>", **http),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    got = {r["capture_id"]: r for r in warc.transactions(warc.read_records(spark, str(tmp_path))).collect()}
    shape = {k: (r["response"] and r["response"]["warc_type"], sorted(x["record_id"] for x in r["requests"]), sorted(x["record_id"] for x in r["metadata"])) for k, r in got.items()}
    assert shape == {
        "<r1>": ("response", ["<q1>"], ["<m>"]), "<r2>": ("response", [], ["<m>"]), "<r3>": ("response", ["<q3>"], []), "<nobody>": (None, [], ["<lost>"]),
        "<i>": (None, [], []), "<v>": ("revisit", [], ["<mv>"]), "<w>": ("revisit", [], []),
    }
    rows = sorted((tuple(r)[:5] for r in warc.captures(spark, str(tmp_path)).collect()), key=str)
    digest = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    assert rows == sorted([(7, 5, digest, "response", None)] * 2 + [(None, 5, digest, "response", None), (8, 5, "X", "revisit", 7), (None, None, None, "revisit", None)], key=str)


def test_warc_large_pages_in_archives_of_their_own(spark):
    rows = [(i, f"http://h/{i}", "x" * (50_000 if i % 5 == 0 else 10) + str(i)) for i in range(40)]
    out = fresh_path(spark, "t")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), out, archive_bytes=100_000)
    # The last page of a payload twice: two responses, and a revisit that is found by the digest.
    twice = fresh_path(spark, "t")
    warc.write_archives(spark.createDataFrame([(2, "u", "same"), (2, "u", "same"), (1, "v", "same")], "page_id long, url string, html string"), twice)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.captures(spark, twice).collect()) == [(1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4)]
    sizes = spark.read.format("binaryFile").load(out).count()
    got = {r["page_id"]: r["payload_bytes"] for r in warc.captures(spark, out).collect()}
    assert got == {i: len(h) for i, _, h in rows} and sizes >= 8


def test_op1_against_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = warc.op1_warc(spark, sf_dir)
    assert dict(got.dtypes) | {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"} == dict(got.dtypes)
    most: dict[bytes, int] = {}
    for p in pages:
        data = (p["html"] or "").encode()
        most[data] = max(most.get(data, -1), p["page_id"])
    want = {}
    for p in pages:
        data = (p["html"] or "").encode()
        first = most[data]
        want[p["page_id"]] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == p["page_id"] else "revisit", None if first == p["page_id"] else first)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()} == want


# 2 fingerprints
def test_fingerprints_against_plain_python(docs):
    rows = {r["doc_id"]: r for r in fuzzyhash.fingerprint_documents(docs).collect()}
    texts = texts_of(docs)
    order = sorted(texts, reverse=True)
    assert sorted(rows) == sorted(texts)
    for a, b in zip(order, order[1:] + order[:1]):
        n = len(texts[a])
        edited = texts[a][: n - n // 2] + texts[b][: n // 2]
        assert rows[a]["n_chars"] == n and rows[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[a]["fingerprint"] == fuzzyhash.fingerprints_of([texts[a].encode()])[0]
        assert rows[a]["near_next"] == fuzzyhash.likeness([rows[a]["fingerprint"]], [rows[b]["fingerprint"]])[0]
    assert sum(r["near_edited"] > 0.3 for r in rows.values()) > 0.9 * len(rows)
    assert sum(r["near_next"] > 0.2 for r in rows.values()) < 0.05 * len(rows)


def plain_fingerprint(text):
    """Rolling hash, chunk ends and letters, one byte and one number at a time."""
    full = (1 << 64) - 1
    step = 0x9E3779B97F4A7C15

    def mix(x):
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 & full
        return x ^ (x >> 29)

    padded, rolled, levels = bytes(7) + text, [], []
    for i in range(len(text)):
        last = padded[i + 1 : i + 8][::-1]
        rolled.append(mix(sum((b + 1) * (31**j + 2 * j) for j, b in enumerate(last)) * step & full))
        low, n = rolled[-1] & 0xFFFFFFFF, 0
        while low & 1:
            low, n = low >> 1, n + 1
        levels.append(n)
    chosen = 0
    while sum(x >= chosen for x in levels) >= 64:
        chosen += 1
    out = [str(chosen)]
    for k in range(chosen, chosen + 3):
        letters, begin = "", 0
        for i in range(len(text)):
            if levels[i] >= k or i == len(text) - 1:
                chunk = sum((b + 1) * pow(step, j, 1 << 64) for j, b in enumerate(text[begin : i + 1])) & full
                letters += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[mix(chunk ^ rolled[i]) >> 58]
                begin = i + 1
        out.append(letters)
    return ":".join(out)


def test_fingerprint_by_definition(monkeypatch):
    rnd = random.Random(6)
    texts = [bytes(rnd.choice(b"abcdefgh \xc3\xa9") for _ in range(n)) for n in (0, 1, 5, 7, 8, 63, 500, 4000, 9000)]
    want = [plain_fingerprint(t) for t in texts]
    assert fuzzyhash.fingerprints_of(texts) == want == fuzzyhash.fingerprints(texts)
    # The same by slices, whatever the bounds cut through.
    for size in (64, 1000, 4000):
        monkeypatch.setattr(fuzzyhash, "CHUNK", size)
        assert fuzzyhash.fingerprints(texts) == want


def test_edit_distance_is_exact():
    rnd = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rnd.choice("ABCD") for _ in range(rnd.randint(4, 64))) for _ in "12")
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: row[j - 1] + 1 if x == b[j - 1] else max(left, row[j]), initial=0))
        shared = any(a[i : i + 4] in b for i in range(len(a) - 3))
        assert fuzzyhash.alike([a], [b])[0] == pytest.approx(2 * row[-1] / (len(a) + len(b)) if shared else 0)


def test_fingerprints_odd(odd, none):
    rows = fuzzyhash.fingerprint_documents(odd).collect()
    assert len(rows) == 8 and {r["fingerprint"] for r in rows if r["doc_id"] in (3, 4)} == {"0:::"}
    assert fuzzyhash.fingerprint_documents(none).count() == 0


# 3 HTML
def test_common_lines_is_longest():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 12))] for _ in "12")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        found = sorted(htmldiff.common_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in found)


def test_common_lines_of_long_pages():
    import time

    start = time.perf_counter()
    a = [i % 997 for i in range(6000)] + [-1]
    b = [i % 991 for i in range(6000)] + [-2]
    found = sorted(htmldiff.common_lines(a, b))
    rest = iter(b)
    assert len(found) > 900 and all(any(a[i] == y for y in rest) for i in found) and time.perf_counter() - start < 30


def test_html_stray_tags_take_linear_time():
    import time

    for page in ("<b>" * 40_000 + "x" + "</i>" * 40_000, "<div><b>" * 20_000 + "x" + "</i></b></p>" * 20_000, "<li>x" * 20_000, "<head>" * 20_000 + "x", "<svg/>" * 20_000 + "x", "<p>x<i>" * 20_000):
        start = time.perf_counter()
        assert "x" in htmldiff.keep(htmldiff.blocks(page), None)
        assert time.perf_counter() - start < 3


def test_html_neighbours_against_brute_force(spark):
    rnd = random.Random(12)
    rows = [(i, f"h{rnd.randrange(3)}", "/" + "/".join(rnd.choice("abc") for _ in range(rnd.randint(0, 3))), True) for i in range(80)]
    rows += [(100 + i, f"lonely{i}", "/x", True) for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, host string, path string, asks boolean")
    got = {}
    for r in htmldiff.neighbours(frame).collect():
        got.setdefault(r["page_id"], {})[r["place"]] = r["other"]
    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    for at, (page, host, path, _) in enumerate(order):
        near = []
        for step in (*range(-htmldiff.NEAR, 0), *range(1, htmldiff.NEAR + 1)):
            if 0 <= at + step < len(order) and order[at + step][1] == host:
                other = order[at + step]
                same = 0
                for u, v in itertools.zip_longest(path.split("/"), other[2].split("/")):
                    if u != v:
                        break
                    same += 1
                near.append((-same, abs(step), step > 0, other[0]))
        assert [got.get(page, {})[k] for k in sorted(got.get(page, {}))] == [n[3] for n in sorted(near)]


def test_op3_contract(spark, sf_dir):
    got = htmldiff.op3_htmltext(spark, sf_dir)
    assert dict(got.dtypes) | {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"} == dict(got.dtypes)
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"]: r["url"] for r in got.collect()} == pages and all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_html_against_known_template(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in htmldiff.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?p>|</?h1>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def test_html_differencing_without_article(spark):
    page = "<html><body><div>Site name</div><div>Menu one</div><p>{}</p><div>All rights</div></body></html>"
    rows = [(i, f"http://h/a/{i}", page.format(f"Story number {i} &lt;b&gt;")) for i in range(4)] + [(9, None, None), (10, "http://x/1", ""), (None, "http://h/a/7", page.format("n")), (1, "http://h/a/1", page.format("Story number 1 &lt;b&gt;"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1)).withColumn("other", F.lit(2))
    got = [(r["page_id"], r["text"]) for r in htmldiff.extract(frame).collect()]
    assert len(got) == len(rows)
    assert {(i, f"Story number {i} <b>") for i in range(4)} <= set(got) and (9, "") in got and (10, "") in got
    assert htmldiff.extract(frame.filter("page_id = 77")).count() == 0


def test_html_copies_are_no_neighbours(spark):
    body = " and ".join(f"word{i}" for i in range(60))
    page = "<html><body><div>Site name</div><div>Menu one</div><p>{}</p><div>All rights</div></body></html>"
    rows = [(i, u, page.format(body)) for i, u in enumerate(["http://h/a/1", "http://h/a/1?print", "http://h/a/1", "http://m/a/1", "http://m/a/2"])]
    rows += [(10, "http://h/b/9", page.format("Another story altogether")), (11, "http://h/a/1/recrawl", page.format(body) + "<p>Read 2 May</p>")]
    got = {r["page_id"]: r["text"] for r in htmldiff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (0, 1, 2)] == [body] * 3 and got[10] == "Another story altogether" and got[11] == body + "\nRead 2 May"
    # Copies alone on a host have nothing to be compared with: the text stays.
    assert all(body in got[i] for i in (3, 4))


def test_html_alignment_decides_outside_articles():
    def text(page, *others):
        return htmldiff.keep(htmldiff.blocks(page), [htmldiff.doubtful(htmldiff.blocks(o)) for o in others])

    story, other = "A story of its own, told at some length", "Another story, quite unlike the first one"
    # Unmarked menus and notices in main go where a neighbour has them.
    main = "<main><div>Menu one</div><h1>Title {0}</h1><p>{0}</p><div>Notice</div></main>"
    assert text(main.format(story), main.format(other)) == f"Title {story}\n{story}"
    # A teaser in an article does not stand for the body.
    teaser = "<div>Menu one</div><div><p>{}</p></div><article><p>Read on</p></article>"
    assert text(teaser.format(story), teaser.format(other)) == f"{story}\nRead on"
    # A long article does: what is outside goes.
    assert text(f"<div>By A</div><article>{story}</article>", f"<div>By B</div><article>{other}</article>") == story
    for name in ("entry-header", "post-header", "article-header"):
        assert text(f"<article><header class='{name}'><h1>T</h1></header><p>{story}</p></article>") == f"T\n{story}"


def test_html_names_of_layouts():
    page = "<div class='page has-sidebar noCookie'><div id='main-content'><p>kept</p><div class='sidebarWidget'>gone</div></div></div>"
    assert htmldiff.keep(htmldiff.blocks(page), None) == "kept"


def test_html_furniture():
    page = (
        "<title>t</title><div class='cookie-notice'>c</div><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>a <b>b</b>\n c<p>d"
        "<script>var x='</p>'</script><aside>n</aside><form>f</form><ul><li>x<li>y</ul></article></main><div id=comments><article>r</article></div><footer>f</footer>"
    )
    assert htmldiff.keep(htmldiff.blocks(page), None) == "T\na b c\nd\nx\ny"


def test_html_comments_as_articles_and_anchors():
    page = (
        "<article class='post'><h2 id='social-history' class='header'>Social history</h2><p id='legal'>l</p><section id='related-work'><h3 id='notice'>N</h3><p>r</p></section>"
        "<div id='related-work'>w</div><div id='related-posts'>gone</div><ul class='commentlist'><li>gone</ul><ins class='adsbygoogle'>gone</ins><div class='topnav'>gone</div>"
        "<p class='commentary'>c</p><div class='advert'>gone</div></article><article class='comment'><h2>Reader</h2><p>gone</p></article><article id='comment-7'>gone</article><article class='reader-comments'>gone</article>"
    )
    assert htmldiff.keep(htmldiff.blocks(page), None) == "Social history\nl\nN\nr\nw\nc"
    for name in ("comment-list", "commentForm", "main-menu", "subnav", "leftSidebar", "cookie_notice"):
        assert htmldiff.marked(name)
    for name in ("post", "commentary", "has-sidebar", "menuetto", "navy", "story-body"):
        assert not htmldiff.marked(name)


# 4 toxicity
def test_maximal_segments_by_definition():
    rnd = random.Random(5)
    for _ in range(150):
        n = rnd.randint(1, 14)
        gains = {i: rnd.randint(1, 9) / 2 for i in range(n) if rnd.random() < 0.5}
        row = [gains.get(i, -1.0) for i in range(n)]

        def parts(lo, hi):
            spans = [(sum(row[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            total = max(spans)[0]
            # The longest span of the largest sum is no maximal segment; the shortest is.
            s, length, start = max(x for x in spans if x[0] == total)
            i, j = -start, -start - length
            return [*parts(lo, i), (i, j - 1, s), *parts(j, hi)]

        got = toxicity.maximal_segments(sorted(gains), [gains[i] for i in sorted(gains)], 1.0)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in parts(0, n)))


def test_toxicity_learns_and_holds_out(spark, none, odd):
    rnd = random.Random(2)
    words = [a + b for a in "bcdfghk" for b in ("ato", "eni", "ulo", "ira")]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        text = [rnd.choice(words) for _ in range(60)]
        if toxic:
            text[30:30] = ["vile", "rotten", "vile"]
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOC)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, marks).collect()}
    assert all((got[i]["predicted"] == 1) == (i % 5 == 0) for i in got)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert any(s["first"] == 30 and s["last"] == 32 for s in got[0]["segments"])
    assert toxicity.score(odd, marks).count() == 8 and toxicity.score(none, marks).count() == 0
    assert all(r["score"] == 0 for r in toxicity.score(odd, marks.limit(0)).collect())
    assert toxicity.reject_toxic(docs, marks).count() == 320


def test_toxicity_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    frame = toxicity.op4_toxicity(spark, big)
    assert dict(frame.dtypes) | {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"} == dict(frame.dtypes)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [r for r in frame.collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = ([r for r in rows if labels[r["doc_id"]] == k] for k in (1, 0))
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.03 * len(clean)
    assert all((s["evalue"] < toxicity.SIGNIFICANT) == s["significant"] for r in rows for s in r["segments"])
    assert sum(any(s["significant"] for s in r["segments"]) for r in toxic) > 0.7 * len(toxic)
    assert sum(any(s["significant"] for s in r["segments"]) for r in clean) < 0.05 * len(clean)


def test_scale_is_recovered():
    import numpy as np

    rng = np.random.default_rng(3)
    model = toxicity.Model({"bad": 2.0}, {"bad": 0.01})
    n = rng.integers(50, 500, 20_000)
    # Best scores of an extreme-value law with K = 0.02, none below zero.
    best = np.maximum(0, np.log(0.02 * n / rng.exponential(size=len(n))) / model.lam)
    model.set_scale(best, n)
    assert model.k == pytest.approx(0.02, rel=0.05)


def test_surprise_of_one_segment():
    import math

    assert toxicity.surprise_of([5.0], 100, 1.5, 0.1) == pytest.approx(1.5 * 5 - math.log(0.1 * 100)) and toxicity.surprise_of([0.1], 1000, 1.0, 0.1) == 0


# 5 near duplicates
def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited_group(rnd, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, most)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 16])
def test_neardup_against_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SHINGLES", block * 256)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    texts = texts_of(docs)
    more = edited_group(rnd, base, 120, 7) + ["A b", "a  B", "a b c", "x y z q r", "x y z q r s", " \t"] * 2
    texts |= {10_000 + i: t for i, t in enumerate(more)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.label_components(frame).collect()}
    assert got == brute_components(texts)


def test_neardup_odd(odd, none):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.label_components(odd).collect()]
    assert sorted(rows, key=str) == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True)], key=str)
    assert neardup.label_components(none).count() == 0
    assert sorted(r["doc_id"] for r in neardup.deduplicate(odd).collect()) == [1, 3, 4, 5, 5, 6, 7]


def test_neardup_ids_shared_by_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(words), "quite another text of at least five words"
    rows = [(5, far), (5, near), (7, near + " end"), (3, near + " and end"), (9, far + " "), (None, near), (3, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.label_components(frame).collect()), key=str)
    assert got == sorted([(5, 4, 5), (5, 56, 3), (7, 57, 3), (3, 58, 3), (9, 4, 5), (None, 56, None), (3, 1, 3)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.deduplicate(frame).collect()), key=str)
    assert kept == sorted([(5, far), (3, near + " and end"), (None, near), (3, "x")], key=str)


def test_long_texts_in_slices(monkeypatch):
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(3000)).encode() + b" \n "
    whole = neardup.shingle_sets([text])[0]
    monkeypatch.setattr(neardup, "CHUNK", 800)
    assert len(list(neardup.slices(text))) > 10 and (neardup.long_set(text) == whole).all()
    h, bounds = neardup.all_sets([b"a b", text, b""])
    assert (h[bounds[1] : bounds[2]] == whole).all() and bounds.tolist() == [0, 1, 1 + len(whole), 1 + len(whole)]


def test_estimate_is_corrected():
    rnd = random.Random(8)
    a = {rnd.getrandbits(60) for _ in range(600)}
    b = set(list(a)[:500]) | {rnd.getrandbits(60) for _ in range(50)}
    sets = [neardup.shingle_sets([" ".join(map(str, sorted(s))).encode()])[0] for s in (a, b)]
    import numpy as np

    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    regs = [neardup.registers_of(s, np.array([0, len(s)])) for s in sets]
    assert abs(neardup.estimate(regs[0], regs[1], np.array([len(sets[0])]), np.array([len(sets[1])]))[0] - true) < 0.2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_components_in_few_shuffles(spark, monkeypatch):
    """Any graph, in chunks of three edges, against union by hand; and hubs, chains and pairs in few levels, each of one shuffle."""
    rnd = random.Random(5)
    pairs = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(300)] + [(3000 + 2 * i, 3001 + 2 * i) for i in range(100)] + [(rnd.randrange(5000, 5300), rnd.randrange(5000, 5300)) for _ in range(200)]
    rnd.shuffle(pairs)
    want = {v: v for p in pairs if p[0] != p[1] for v in p}
    for _ in want:
        before = dict(want)
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    written, tables = components.written, []
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(df) or written(df, name))
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    assert {r["id"]: r["component"] for r in components.connected_components(edges).collect()} == want
    assert len(tables) <= 4 and all(t._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1 for t in tables[:-1])
    monkeypatch.setattr(components, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {r["id"]: r["component"] for r in components.connected_components(edges).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# 6 licences
def test_licences_inherit_from_the_nearest_directory(spark, none, odd):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/b/LICENSE", gpl), ("a/x.c", "int x;"), ("a/b/c/y.c", None), ("a/b/z.c", "code\n" * 20 + mit), ("q/w.c", ""), ("a/x.c", "int x;"), (None, mit), ("top", "x")]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("cosine", F.lit("x")).withColumn("word", F.lit("kept"))
    got = sorted(((r["path"], r["spdx"], r["origin"], r["from_path"], r["word"]) for r in licenses.scan_licenses(files).collect()), key=str)
    want = [
        ("a/LICENSE", "MIT", "own", "a/LICENSE"), ("a/b/LICENSE", "GPL-3.0", "own", "a/b/LICENSE"), ("a/b/c/y.c", "GPL-3.0", "inherited", "a/b/LICENSE"), ("a/b/z.c", "MIT", "own", "a/b/z.c"),
        ("a/x.c", "MIT", "inherited", "a/LICENSE"), ("a/x.c", "MIT", "inherited", "a/LICENSE"), ("q/w.c", None, "none", None), (None, None, "none", None), ("top", None, "none", None),
    ]
    assert got == sorted(((*w, "kept") for w in want), key=str)
    assert licenses.scan_licenses(licenses.document_files(none)).count() == 0
    assert licenses.scan_licenses(licenses.document_files(odd)).filter("origin = 'none'").count() == 8


def test_licences_of_wrapped_headers_long_lines_and_long_files(spark):
    long = {s: t for s, t in licenses.TEMPLATES if len(t) > 200}
    wrapped = "/*\n * " + long["GPL-2.0"].replace(" you ", "\n * you ").replace(" either ", "\n * either ") + "\n */\nint main() {}\n" * 30
    inside = "word " * 300 + "licensed under the Apache License, Version 2.0, " + "word " * 300
    full = "The MIT License\n\nCopyright (c) 2020 Someone\n\n" + long["MIT"] + "\n\nThe software is provided as is, without warranty of any kind." * 2
    prose = "She was released under the condition that no licence was needed, and the permission came late. " * 5
    rows = [("a/w.c", wrapped), ("a/l.txt", inside), ("b/COPY", full), ("b/c/x.c", "int x;"), ("d/p.txt", prose), ("a/x.c", "int y;")]
    got = {r["path"]: (r["spdx"], r["origin"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    # A header covers its own file; only a file that is a licence covers its directory, whatever its length.
    assert got == {"a/w.c": ("GPL-2.0", "own"), "a/l.txt": ("Apache-2.0", "own"), "b/COPY": ("MIT", "own"), "b/c/x.c": ("MIT", "inherited"), "d/p.txt": (None, "none"), "a/x.c": (None, "none")}
    assert len(full) > 200 and all(set(re.split(licenses.NOT_WORD, t.lower())) & set(licenses.CUES) for _, t in licenses.TEMPLATES)


# 7 languages
def test_languages(spark, sf_dir, odd, none):
    big = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = langid.identify(big).join(big.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    got = {r["doc_id"]: r for r in langid.identify(odd).collect()}
    assert got[4]["lang_pred"] == got[3]["lang_pred"] == got[7]["lang_pred"] == "und" and got[4]["score"] == 0
    assert langid.identify(none).count() == 0


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_slices_of_a_text_add_up(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    import pandas as pd

    grams = pd.concat(list(langid.count_grams(iter([pd.DataFrame({"lang": ["a", "b"], "text": ["the cat sat on the mat", "le chat est la"]})]))))
    trees = langid.Trees(grams.groupby(["lang", "gram"], as_index=False)["n"].sum())
    for text in ("", "a", "the chat", "the cat sat on the mat and le chat " * 5):
        data = langid.padded(text)
        parts = list(langid.slices(data))
        whole, sliced = trees.code_lengths([data])[0], trees.code_lengths(parts).sum(0)
        assert len(parts) == max(1, -(-len(text) // chunk)) and abs(whole - sliced).max() < 1e-3


def test_code_length_by_definition():
    import pandas as pd

    train = "abracadabra abracad"
    frames = list(langid.count_grams(iter([pd.DataFrame({"lang": ["x"], "text": [train]})])))
    trees = langid.Trees(pd.concat(frames))
    data = langid.padded(train)
    seen: dict[bytes, dict[int, int]] = {}
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER + 1):
            seen.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
            seen[data[i - k : i]][data[i]] += 1
    import math

    def cost(context, symbol):
        counts = seen.get(context, {})
        n, d = sum(counts.values()), len(counts)
        if symbol in counts:
            return -math.log2(counts[symbol] / (n + d))
        return (-math.log2(d / (n + d)) if d else 0) + (cost(context[1:], symbol) if context else 8.0)

    text = langid.padded("abraxas brac!")
    want = sum(cost(text[i - langid.ORDER : i], text[i]) for i in range(langid.ORDER, len(text)))
    assert trees.code_lengths([text])[0, 0] == pytest.approx(want, rel=1e-5)


# 8 decontamination
def test_decontamination(spark, odd, none):
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words[3:17]).upper() + " y", "en", "s", 1), (2, "nothing here", "en", "s", 1), (3, "say Short Item now, short item", "en", "s", 1), (4, None, "en", "s", 1)], DOC)
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "short, item"), (3, "!!"), (4, None), (10, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, bench).collect()}
    assert got[1]["hit_words"] == list(range(1, 15)) and got[1]["item_ids"] == ["1", "10"] and got[1]["n_words"] == 16
    assert got[3]["hit_words"] == [1, 2, 4, 5] and got[3]["item_ids"] == ["2"] and got[2]["hit_words"] == [] and got[4]["n_words"] == 0
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 4}
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()} == {1: "x y", 2: "nothing here", 3: "say now", 4: None}
    assert decontaminate.scan(odd, bench).count() == 8 and decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(odd, bench.limit(0)).filter("size(hit_words) > 0").count() == 0
    assert sorted((r["doc_id"], r["text"]) for r in decontaminate.decontaminate(odd, bench, remove="spans").collect() if r["doc_id"] in (1, 5)) == [(1, "alpha beta gamma delta epsilon zeta"), (5, "one two"), (5, "one two")]


def test_decontamination_without_broadcast(spark, docs, sf_dir):
    """The planner's other join gives the same rows, and time grows with the text's length and no faster."""
    import time

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(decontaminate.scan(docs, bench).collect())
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(decontaminate.scan(docs, bench).collect()) == want
        took = []
        for n in (8_000, 64_000):
            one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id long, text string")
            start = time.perf_counter()
            decontaminate.scan(one, bench).collect()
            took.append(time.perf_counter() - start)
        assert took[1] < 8 * took[0] + 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# 9 sharding
def test_sharding(spark, docs, odd, none):
    rows = sharding.shard(docs, fresh_path(spark, "t"), 16, bucket_bytes=20_000).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(texts_of(docs).items())
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order != sorted(order)
    keys = spark.range(2000).select(sharding.rendezvous(F.col("id"), 16).alias("a"), sharding.rendezvous(F.col("id"), 17).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 16 for r in keys) and 60 < sum(r["b"] == 16 for r in keys) < 180
    got = sharding.shard(odd, fresh_path(spark, "t"))
    assert set(odd.columns) <= set(got.columns) and got.filter("pos = 'x' and row = 'x'").count() == 8 and sharding.shard(none, fresh_path(spark, "t")).count() == 0


def test_sharding_orders_and_hot_shard(spark):
    # Null ids share a shard: it gets buckets by its own size, and buckets of equal size do not share an order.
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = sharding.shard(rows, fresh_path(spark, "t"), 4, bucket_bytes=200)
    hot = got.filter("doc_id is null").select("shard").distinct().collect()
    per = {r["shard"]: r["n"] for r in got.groupBy("shard").agg(F.count_distinct("bucket").alias("n")).collect()}
    assert len(hot) == 1 and per[hot[0]["shard"]] == max(per.values()) > 2 * min(per.values())
    orders = got.orderBy("bucket", "slot").groupBy("bucket").agg(F.collect_list(F.struct("slot", "text")).alias("rows")).collect()
    ranks = [tuple(sorted(range(len(t)), key=t.__getitem__)) for t in ([x["text"] for x in sorted(r["rows"])] for r in orders)]
    by_size = [[r for r in ranks if len(r) == n] for n in {len(r) for r in ranks if len(r) > 4}]
    assert all(len(set(g)) == len(g) for g in by_size)


def test_sharding_law_by_definition(spark, sf_dir):
    """The registered query: sizes, checksums, gapless slots, and one more shard that takes rows only into itself."""
    docs = texts_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = sharding.op9_sharding(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = {r["doc_id"]: r for r in got.collect()}
    assert sorted(rows) == sorted(docs)
    for i, r in rows.items():
        data = docs[i].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key") and 0 <= r["shard"] < 16
        assert r["grown_shard"] in (r["shard"], 16)
    for s in range(16):
        mine = sorted(r["slot"] for r in rows.values() if r["shard"] == s)
        assert mine == list(range(len(mine)))


# 10 mixing
def test_mixing(spark, docs, odd, none):
    plan = mixing.source_rates(docs, {"src0": 3.0, "src1": 1.0}).collect()
    assert {r["source"]: r["rate"] > 0 for r in plan} == {r["source"]: r["source"] in ("src0", "src1") for r in plan}
    flat = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    counts = [r["n"] for r in mixing.mix(flat, scale=2.5).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(sum(counts) / 20_000 - 2.5) < 0.05 and abs((20_000 - len(counts)) / 20_000 - 0.0821) < 0.01
    twice = [mixing.mix(docs.repartition(n)).select("doc_id", "copy", "shuffle_key").collect() for n in (1, 5)]
    assert twice[0] == twice[1]
    # Equal rows, and rows with the same id, are drawn alike; the null source is a source like the others.
    got = mixing.mix(odd).collect()
    counts = {(r["doc_id"], r["n_copies"]) for r in got}
    assert len(counts) == len({i for i, _ in counts}) and mixing.mix(none).count() == 0
    assert all(sum(r["doc_id"] == i for r in got) == n * (2 if i == 5 else 1) for i, n in counts)
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(odd).collect()}
    assert set(rates) == {None, "a", "b"} and all(r > 0 for r in rates.values())


def test_mixing_order_is_global(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    mixed = mixing.mix(rows, scale=1.5)
    keys = [r["shuffle_key"] for r in mixed.collect()]
    assert mixed.rdd.getNumPartitions() > 1 and keys == sorted(keys)


def test_mixing_reaches_the_share_of_a_small_source(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.when(F.col("id") < 20, "b").otherwise("a").alias("source"))
    got = {r["source"]: r for r in mixing.mix(rows, {"a": 0.5, "b": 0.5}).groupBy("source").agg(F.count("*").alias("n"), F.min("rate").alias("rate"), F.min("n_copies").alias("least"), F.max("n_copies").alias("most")).collect()}
    assert got["b"]["rate"] == 500 and abs(got["b"]["n"] - 10_000) < 400 and abs(got["a"]["n"] - 10_000) < 400
    assert 400 < got["b"]["least"] < got["b"]["most"] < 600

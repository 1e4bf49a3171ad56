"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of one with the same payload) and a metadata record. The
request and the metadata name the response in ``WARC-Concurrent-To``. Archives are gzip files of concatenated
WARC/1.1 records, written by Spark's text sink with the record end as line separator and read by content length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import fresh_path, load, written

CRLF = "\r\n"
END = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"
MIN_REVISIT_BYTES = 0
# Bytes of an archive before compression: a reading task holds one archive's.
ARCHIVE_BYTES = 128 << 20
# Fixed values of the WARC/1.1 standard.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 as 32 upper-case base32 letters: four groups of 40 bits."""
    digest = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0"), HEX32, BASE32) for i in (1, 11, 21, 31)])


def _headers(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines and the empty line; a null value leaves its header out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v.cast("string"), F.lit(CRLF)) for name, v in pairs]
    return F.concat(F.lit(VERSION + CRLF), *[F.coalesce(line, F.lit("")) for line in lines], F.lit(CRLF))


def _record_id(kind: str, name: str = "__id") -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", F.lit(kind), name)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write_archives(pages: DataFrame, out: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one capture (three records) for each row of ``page_id, url, html`` to gzip archives in ``out``.

    An archive takes as many captures as make ``archive_bytes`` at the mean size, and fewer where some are far larger: pages of
    over a hundredth of that go to archives of their own kind.

    Of rows whose payloads are equal and have at least ``min_revisit_bytes`` bytes, those with the largest ``page_id``
    are responses and the rest revisits; rows with a null ``page_id`` are revisits where any equal row has one. A
    null html is an empty payload, a null url leaves the target out. Repeated rows are captures of their own.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    per = rows.filter(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    last = per.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("n"))
    same = last.select("digest", F.col("last.page_id").alias("target"), (F.col("last.n") == 1).alias("single"), "n")
    # Only payloads that repeat; as a written table its size decides how the planner joins it.
    repeated = written(same.filter("n > 1 and target is not null").select("digest", "target", "single"), "warc-repeats")
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    # A response that others refer to is named by its payload and page, so that they can name it; any other row by its place.
    # Where that page is there several times, revisits leave the identifier out and are found by their digest.
    named = F.when(F.col("single") & ~revisit, F.concat_ws("|", "digest", "target")).otherwise(F.concat_ws("|", F.monotonically_increasing_id(), "page_id", "digest"))
    marked = joined.withColumn("revisit", revisit).withColumn("__id", named).withColumn("__to", F.concat_ws("|", "digest", "target"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "html"))
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[^:/?#]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    ask = F.concat(F.lit("GET "), path, F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:/?#]+://([^/?#]*)", 1), F.lit(END))
    about = F.concat(
        F.coalesce(F.concat(F.lit("pageId: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
        F.lit("fetchedWith: GET"), F.lit(CRLF),
    )
    main = _record_id("response")
    common = [("WARC-Date", date), ("WARC-Target-URI", F.col("url"))]
    request = F.concat(
        _headers(("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request")), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request"), ("Content-Length", F.octet_length(ask))), ask
    )
    response = F.concat(
        _headers(
            ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", main), *common,
            ("WARC-Profile", F.when(F.col("revisit"), REVISIT_PROFILE)), ("WARC-Refers-To", F.when(F.col("revisit") & F.col("single"), _record_id("response", "__to"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", F.octet_length(block)),
        ), block,
    )
    metadata = F.concat(
        _headers(("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata")), *common, ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields"), ("Content-Length", F.octet_length(about))), about
    )
    records = marked.select(F.concat_ws(END, request, response, metadata).alias("value"), "bytes")
    large = archive_bytes // 100
    small = F.col("bytes") <= large
    size = pages.select(F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes")).agg(F.avg(F.when(small, F.col("bytes"))).alias("mean"), F.max("bytes").alias("most")).first()
    per_file = max(1, int(archive_bytes // ((size["mean"] or 0) + 2_000)))  # besides its payload a capture takes under 2 kB
    for mode, rows_, count in (("error", records.filter(small), per_file), ("append", records.filter(~small), max(1, archive_bytes // max(1, size["most"] or 1)))):
        if mode == "error" or (size["most"] or 0) > large:
            rows_.select("value").write.mode(mode).option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", count).text(out)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names; a header may repeat) and block of each record of a plain WARC stream."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a WARC record: {line[:40]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a WARC record is cut off")
        yield headers, block


RECORD = (
    "record_id string, warc_type string, concurrent_to array<string>, refers_to string, target_uri string, warc_date string, header_digest string, "
    "http_head string, payload binary, payload_bytes long, payload_digest string, fields map<string,string>"
)


def _row(headers: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    kind, head, payload, n, digest, fields = one("warc-type"), None, None, None, None, None
    content = one("content-type") or ""
    if "application/http" in content:
        head_bytes, _, payload = block.partition(b"\r\n\r\n")
        head = head_bytes.decode("utf-8", "replace")
        if kind == "response":
            n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    elif "warc-fields" in content:
        fields = dict(tuple(x.strip() for x in line.partition(":")[::2]) for line in block.decode("utf-8", "replace").splitlines() if ":" in line)
    given = one("warc-payload-digest")
    return (
        one("warc-record-id"), kind, [x for x in headers.get("warc-concurrent-to", []) if x], one("warc-refers-to"), one("warc-target-uri"), one("warc-date"),
        given.partition(":")[2] if given else None, head, payload if payloads and kind == "response" else None, n, digest, fields,
    )


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the gzip archives under ``path``; ``payloads=False`` leaves the bytes out after measuring them.

    Headers that a record lacks are null, a folder without archives gives no rows, and an archive that is cut off or is no
    WARC file ends the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows, size = [], 0
                for headers, block in parse_records(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 20)):
                    rows.append(_row(headers, block, payloads))
                    size += len(block) if payloads else 400
                    if size > 4 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(parse, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, requests, metadata``.

    A request or metadata record belongs to every record that it names in ``WARC-Concurrent-To`` that is a response or revisit,
    and so do companions named by a response itself. A record that names nothing, or nothing that is there, is a capture by itself, under its own
    identifier (a null one: together with the others without). ``response`` is null where only companions were found; repeated
    responses of one identifier count once, repeated companions each.
    """
    main = F.col("warc_type").isin("response", "revisit")
    whole = F.struct("record_id", "warc_type", "refers_to", "target_uri", "warc_date", "header_digest", "http_head", "payload", "payload_bytes", "payload_digest")
    named = F.filter(F.coalesce("concurrent_to", F.array().cast("array<string>")), lambda x: x != "")
    # A response meets its companions at its own identifier; where it names them instead, they meet it at theirs.
    keys = F.when(main | (F.size(named) == 0), F.array("record_id")).otherwise(F.array_distinct(named))
    placed = records.withColumn("capture_id", F.explode(keys))
    met = placed.groupBy("capture_id").agg(
        F.first(F.when(main, whole), ignorenulls=True).alias("response"),
        F.array_distinct(F.flatten(F.collect_list(F.when(main, named)))).alias("names"),
        F.collect_list(F.when(F.col("warc_type") == "request", F.struct("record_id", "target_uri", "http_head"))).alias("requests"),
        F.collect_list(F.when(F.col("warc_type") == "metadata", F.struct("record_id", "fields"))).alias("metadata"),
    )
    # Few archives put the names on the response: only those captures go round again.
    owners = met.filter(F.col("response").isNotNull()).select(F.col("capture_id").alias("owner"), F.explode("names").alias("capture_id"))
    claimed = met.filter("response is null").join(owners, "capture_id").groupBy(F.col("owner").alias("capture_id")).agg(
        F.flatten(F.collect_list("requests")).alias("more_requests"), F.flatten(F.collect_list("metadata")).alias("more_metadata")
    )
    kept = met.join(owners.select("capture_id").distinct().withColumn("gone", F.lit(True)), "capture_id", "left").filter(F.col("response").isNotNull() | F.col("gone").isNull())
    out = kept.join(claimed, "capture_id", "left")
    join = lambda a, b: F.when(F.col(b).isNull(), F.col(a)).otherwise(F.concat(a, b)).alias(a)
    return out.select("capture_id", "response", join("requests", "more_requests"), join("metadata", "more_metadata"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri`` of the archives under ``path``.

    A revisit's length and page are those of the response that ``WARC-Refers-To`` names, or without one of that with the same
    digest (the largest page), wherever it is stored: the responses that are asked for are joined by identifier or digest. A
    capture without a metadata record has a null ``page_id``, and a revisit of a response that is not there has null
    ``payload_bytes`` and ``refers_to``.
    """
    response = F.col("response")
    digest = F.coalesce(response["payload_digest"], response["header_digest"])
    by_id, by_digest = F.concat(F.lit("i:"), F.nullif(response["refers_to"], F.lit(""))), F.concat(F.lit("d:"), digest)
    rows = transactions(read_records(spark, path, payloads=False)).filter("response is not null")
    rows = rows.select(
        "capture_id",
        F.get("metadata", F.lit(0))["fields"]["pageId"].try_cast("long").alias("page_id"),
        response["payload_bytes"].alias("payload_bytes"),
        digest.alias("payload_digest"),
        response["warc_type"].alias("record_type"),
        F.when(response["warc_type"] == "revisit", F.coalesce(by_id, by_digest)).alias("asked"),
        response["target_uri"].alias("target_uri"),
    )
    rows = written(rows, "captures")
    asked = rows.filter("asked is not null").select(F.col("asked").alias("name")).distinct()
    names = F.array(F.concat(F.lit("i:"), "capture_id"), F.concat(F.lit("d:"), "payload_digest"))
    named = rows.filter("record_type = 'response'").select(F.explode(names).alias("name"), "page_id", "payload_bytes").join(asked, "name", "left_semi")
    best = named.groupBy("name").agg(F.max(F.struct(F.col("page_id").alias("first"), F.col("payload_bytes").alias("size"))).alias("of"))
    found = rows.join(written(best.select(F.col("name").alias("asked"), "of.first", "of.size"), "referred"), "asked", "left")
    return found.select("page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", F.col("first").alias("refers_to"), "target_uri")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "warc")
    write_archives(load(spark, sf_dir, "pages"), out)
    return captures(spark, out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_warc": op1_warc}
ORACLES: dict[str, str] = {}

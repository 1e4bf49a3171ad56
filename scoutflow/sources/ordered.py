"""Fetching many sources at once with the order and the errors of one that asks them one by one."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import urls
from scoutflow.operators.extract import parsed_page

# Opens one client for each task: URL to (status, final URL, html); what it raises is the source's failure.
Client = Callable[[], Callable[[str], tuple[int, str, str]]]
GOT = "ord long, name string, url string, final_url string, html string, error string"
META = re.compile(r"<meta\b[^>]*>", re.I)
EQUIV = re.compile(r"""http-equiv\s*=\s*["']?\s*refresh""", re.I)
CONTENT = re.compile(r"""content\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
TARGET = re.compile(r"url=([^;\s]+)", re.I)
LEAST_ERROR = 400


def refresh_target(html: str, base: str) -> str | None:
    """Where the page's first refreshing meta element leads."""
    for tag in META.findall(html):
        if EQUIV.search(tag):
            content = CONTENT.search(tag)
            found = TARGET.search(next((g for g in content.groups() if g is not None), "") if content else "")
            return urljoin(base, found[1].strip("'\"")) if found else None
    return None


def read_source(get: Callable[[str], tuple[int, str, str]], url: str) -> tuple[str, str]:
    """Final URL and html of a source, after one refresh at most."""

    def sound(address: str) -> tuple[str, str]:
        status, final, html = get(address)
        if status >= LEAST_ERROR:
            raise OSError(f"HTTP {status} for {address}")
        return final or address, html or ""

    final, html = sound(url)
    target = refresh_target(html, final)
    return sound(target) if target and target != final else (final, html)


def collected(sources: DataFrame, client: Client, lanes: int = 1) -> DataFrame:
    """``ord, name, url, final_url, html, error`` for each row of ``sources`` (``ord, name, url``): html or error.

    A host's sources are asked in at most ``lanes`` tasks at a time, so its load does not grow with the cluster, and one host that has many takes no other's place. A landing page that refreshes is followed once.
    """

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = client()
        for batch in batches:
            out = []
            for at, name, url in zip(batch["ord"], batch["name"], batch["url"]):
                try:
                    out.append((at, name, url, *read_source(get, url), None))
                except Exception as e:  # one failing source never ends the scan
                    out.append((at, name, url, None, None, f"{name}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in GOT.split(", ")])

    rows = sources.select(F.col("ord").cast("long").alias("ord"), "name", "url", urls.host(F.col("url")).alias("host"))
    dealt = rows.withColumn("lane", F.pmod(F.xxhash64("url"), F.lit(lanes)))
    return dealt.repartition("host", "lane").sortWithinPartitions("host", "lane", "ord").select("ord", "name", "url").mapInPandas(fetch, GOT)


def pages_of(got: DataFrame) -> DataFrame:
    """``ord, name, url, title, text, html`` of the sources that answered; one without a title has its source's name. In the order of ``ord`` once sorted by it."""
    rows = got.filter("error is null").select("ord", "name", F.col("final_url").alias("url"), "html", parsed_page(F.col("html")).alias("p"))
    return rows.select("ord", "name", "url", F.coalesce(F.nullif("p.title", F.lit("")), "name").alias("title"), "p.text", "html")


def errors_of(got: DataFrame) -> DataFrame:
    """``ord, error`` of the sources that did not."""
    return got.filter("error is not null").select("ord", "error")

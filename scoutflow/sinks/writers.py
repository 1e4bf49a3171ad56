"""Writers: snapshots, tables, and rendered reports of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.functions import urls
from scoutflow.operators.filters import keep_first

FEED_ROWS, REPORT_ROWS, LIST_ROWS = 40, 10, 36


def write_snapshot(display: DataFrame, scanner: DataFrame, path: str, generated: str) -> None:
    """Both datasets as JSON under ``path``, partitioned by day; a day that is written again replaces itself."""
    for name, rows in (("opportunities", display), ("scanner_opportunities", scanner)):
        rows.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(f"{path}/{name}/generated={generated}")


def with_new_flag(rows: DataFrame, as_of: Column) -> DataFrame:
    return rows.withColumn("is_new", F.coalesce(F.col("first_seen") == as_of, F.lit(False)))


def feed_items(curated: DataFrame, ranked: DataFrame, most: int = FEED_ROWS) -> DataFrame:
    """RSS items, curated rows first: ``ord, title, link, guid, description`` without repeats of a guid (or link, or title), case aside."""
    columns = ["ord", "title", "link", "guid", "description"]
    both = curated.select(*columns, F.lit(0).alias("part")).unionByName(ranked.select(*columns, F.lit(1).alias("part")))
    key = F.lower(F.coalesce(F.nullif("guid", F.lit("")), F.nullif("link", F.lit("")), "title"))
    once = keep_first(both.withColumn("key", key), ["key"], ["part", "ord"])
    return once.orderBy("part", "ord").limit(most).drop("key")


def xml_escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def rss(items: DataFrame, title: str, link: str) -> str:
    """A feed of at most ``FEED_ROWS`` items as text."""
    line = F.concat(*[F.concat(F.lit(f"<{t}>"), xml_escape(F.col(t)), F.lit(f"</{t}>")) for t in ("title", "link", "guid", "description")])
    rows = [f"<item>{r['x']}</item>" for r in items.orderBy("part", "ord").limit(FEED_ROWS).select(line.alias("x")).collect()]
    return f'<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>{title}</title><link>{link}</link>{"".join(rows)}</channel></rss>'


def report(ranked: DataFrame, notes: list[str], rows: int = REPORT_ROWS) -> str:
    """A Markdown report: the first ``rows`` of each tier by score, and at most twenty notes."""
    out = ["# Report"]
    for tier in ("qualified", "high", "found"):
        line = F.concat(F.lit("- ["), tx.markdown_escape(F.col("title")), F.lit("]("), urls.safe_external(F.col("source_url")), F.lit("), "), F.format_string("%.1f", "score"))
        out += ["", f"## {tier}", *[r["x"] for r in ranked.filter(F.col("tier") == tier).orderBy(F.desc("score"), "title").limit(rows).select(line.alias("x")).collect()]]
    return "\n".join([*out, "", "## Notes", *[f"- {n}" for n in notes[:20]]]) + "\n"


def spliced(document: str, section: str, start: str, end: str) -> str | None:
    """The document with the part between two markers replaced; None where a marker is missing."""
    if start not in document or end not in document:
        return None
    head, _, rest = document.partition(start)
    return f"{head}{start}\n{section}\n{end}{rest.partition(end)[2]}"


def evaluation_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """The named columns in their order, missing ones empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns]).write.mode("overwrite").option("header", True).csv(path)


def write_sidecar(items: DataFrame, path: str, about: dict[str, str]) -> None:
    """Extraction items and what they were made with: ``items`` as JSON lines, ``about`` (provider, model, version of the schema) as one object beside them; a second run replaces both.

    A VARIANT is written as the JSON it holds. ``resilient.read_lines`` reads the items back whatever has become of single lines.
    """
    items.write.mode("overwrite").json(f"{path}/items")
    head = items.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in about.items()])
    head.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def calendar_event(title: Column, deadline: Column, url: Column) -> Column:
    """One all-day calendar entry for a deadline, as ICS text."""
    day = lambda d: F.date_format(d, "yyyyMMdd")
    return F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nBEGIN:VEVENT\r\nUID:"), F.sha1(url), F.lit("\r\nDTSTART;VALUE=DATE:"), day(deadline), F.lit("\r\nDTEND;VALUE=DATE:"), day(F.date_add(deadline, 1)), F.lit("\r\nSUMMARY:"), tx.ics_escape(title), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))


def item_list(rows: DataFrame, most: int = LIST_ROWS) -> DataFrame:
    """schema.org list entries of dated on-site events, numbered after filtering, as JSON."""
    first = rows.filter("start_date is not null and mode in ('in-person', 'hybrid')").orderBy(F.desc("score"), "title").limit(most)
    return first.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "title", "source_url", "start_date"))).alias("all")).select(
        F.posexplode("all").alias("pos", "e")
    ).select(F.to_json(F.struct(F.lit("ListItem").alias("@type"), (F.col("pos") + 1).alias("position"), F.struct(F.lit("Event").alias("@type"), F.col("e.title").alias("name"), F.col("e.source_url").alias("url"), F.col("e.start_date").alias("startDate")).alias("item"))).alias("json"))

"""How a scan went, source by source: notes on failures, health, the funnel of discovery, and small facts of records that are shown with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.operators.filters import keep_first

NOTE_CHARS, SHORT_DAYS = 180, 5
# What a failure that may pass on its own says.
TRANSIENT = ["timed out", "timeout", "max retries", "connection", "unreachable", "refused", "nameresolution", "temporary failure"]
VAGUE_PLACES = ["global", "europe", "continental europe", "uk and nearby"]
PRIORITY = ["uk", "continental europe", "east asia", "southeast asia"]
SUPPLEMENTARY = ["north america", "australia and new zealand", "south asia", "middle east", "africa", "latin america"]


def transient(error: Column) -> Column:
    return tx.any_term(error, TRANSIENT)


def collection_note(error: Column) -> Column:
    """What a reader is told of a failure; it names the source before the first colon."""
    source = F.coalesce(F.nullif(F.trim(F.split_part(error, F.lit(":"), F.lit(1))), F.lit("")), F.lit("Source"))
    low = F.lower(error)
    has = lambda s: F.contains(low, F.lit(s))
    return (
        F.when(has("browsertype.launch") | (has("playwright") & has("executable doesn't exist")), F.concat(source, F.lit(": browser rendering unavailable; install Playwright browsers or disable rendered scan for this source.")))
        .when(has("403 client error") | has("forbidden"), F.concat(source, F.lit(": access was blocked by the source website during this scan.")))
        .when(has("404 client error") | has("not found"), F.concat(source, F.lit(": configured page was not found during this scan.")))
        .when(F.length(error) > NOTE_CHARS, F.concat(F.rtrim(F.substring(error, 1, NOTE_CHARS - 3)), F.lit("...")))
        .otherwise(error)
    )


def collection_notes(errors: DataFrame, order: str, error: str = "error") -> DataFrame:
    """``order, note``: each note once, at its first place; empty errors give none."""
    notes = errors.select(order, collection_note(F.col(error)).alias("note")).filter("note <> ''")
    return keep_first(notes, ["note"], [order])


def with_health(sources: DataFrame, health: DataFrame) -> DataFrame:
    """``sources`` (``name``) with ``health``: a line on what the state (``name, status, last_success, consecutive_failures``) knows of each."""
    known = health.select("name", F.lit(True).alias("__seen"), "status", "last_success", F.coalesce("consecutive_failures", F.lit(0)).alias("__failures"))
    label = F.when(F.col("status") == "healthy", "Healthy").when(F.col("status") == "failed", F.concat(F.lit("Failed · "), F.col("__failures").cast("string"), F.lit(" consecutive"))).otherwise("Unknown")
    line = F.concat(label, F.lit(" · Last success: "), F.coalesce(F.col("last_success").cast("string"), F.lit("never")))
    return sources.join(known, "name", "left").withColumn("health", F.when(F.col("__seen"), line).otherwise("Not scanned yet")).drop("__seen", "status", "last_success", "__failures")


def funnel(results: DataFrame, ranked: DataFrame) -> DataFrame:
    """``counter, n`` of a discovery: results (``url, reason``; an empty reason accepts), and of ``ranked`` (``layer, fully_qualified``) those that came from it."""
    res = results.agg(
        F.count(F.lit(1)).alias("results"), F.count_distinct(F.nullif("url", F.lit(""))).alias("unique_results"), F.count_if(F.col("reason") == "").alias("results_accepted"), F.count_if(F.col("reason") != "").alias("results_rejected")
    )
    out = ranked.filter("layer = 'discovery'").agg(F.count(F.lit(1)).alias("candidates_ranked"), F.count_if("fully_qualified").alias("candidates_fully_qualified"))
    tall = lambda df: df.unpivot([], df.columns, "counter", "n")
    reasons = results.filter("reason <> ''").groupBy(F.concat(F.lit("rejected_"), "reason").alias("counter")).agg(F.count(F.lit(1)).alias("n"))
    return tall(res).unionByName(reasons).unionByName(tall(out))


def status_line(full: Column, near: Column, tracked: Column, sources: Column) -> Column:
    """The headline of a scan by its counts of full matches and near ones."""
    count = lambda n, what: F.concat(n.cast("string"), F.lit(f" {what}opportunit"), F.when(n == 1, "y").otherwise("ies"))
    cover = F.concat(F.lit("Tracking "), count(tracked, ""), F.lit(" across "), sources.cast("string"), F.lit(" trusted sources."))
    return (
        F.when(full > 0, F.concat(count(full, "fully qualified "), F.lit(" in the latest scan. "), cover))
        .when(near > 0, F.concat(F.lit("No fully qualified matches in the latest scan. "), cover, F.lit(" Additional opportunities from official sources are shown below.")))
        .otherwise(F.concat(F.lit("No open opportunities matched every rule in the latest scan. "), cover, F.lit(" New schools surface as their deadlines open, typically December to April.")))
    )


def with_earlier_notes(sources: DataFrame, earlier: DataFrame, column: str = "notes_zh") -> DataFrame:
    """``sources`` (``name, url, notes``) with the translated notes of the same source of an earlier run, where the notes have not changed since. A column that they have already wins."""
    old = earlier.filter(F.trim(column) != "").select("name", "url", F.coalesce("notes", F.lit("")).alias("__notes"), F.col(column).alias("__old")).dropDuplicates(["name", "url"])
    mine = F.col(column) if column in sources.columns else F.lit(None).cast("string")
    same = F.coalesce("notes", F.lit("")) == F.col("__notes")
    return sources.join(old, ["name", "url"], "left").withColumn(column, F.coalesce(mine, F.when(same, F.col("__old")))).drop("__notes", "__old")


def keeps_page(opportunity: Column, source_type: Column) -> Column:
    """Pages that look like an opportunity, and all of training providers."""
    return opportunity | F.coalesce(source_type == "research_training_provider", F.lit(False))


def looks_like_url(title: Column) -> Column:
    """Whether a title is a bare address or domain."""
    low = F.lower(F.trim(title))
    return low.rlike(r"^(https?://|www\.)") | (~F.contains(low, F.lit(" ")) & low.rlike(r"\.[a-z]{2,}$"))


def specific_place(place: Column, region: Column) -> Column:
    """Whether a place says more than its source's region or a continent."""
    low = lambda c: F.lower(tx.clean_space(F.coalesce(c, F.lit(""))))
    return (low(place) != "") & (low(place) != low(region)) & ~low(place).isin(*VAGUE_PLACES)


def too_short(days: Column) -> Column:
    return F.coalesce(days < SHORT_DAYS, F.lit(False))


def region_class(region: Column) -> Column:
    low = F.lower(region)
    return F.when(low.isin(*PRIORITY), "priority").when(low.isin(*SUPPLEMENTARY), "supplementary").when(low == "global", "global").otherwise("unclassified")


def listed(text: Column) -> Column:
    """The parts of a comma-separated text, trimmed, without empty ones; null is none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def listing_range(text: Column) -> Column:
    """``start, end`` of ``dd/mm/yy - dd/mm/yy``, of this century; null without one."""
    pattern = r"(\d{2})/(\d{2})/(\d{2})\s*-\s*(\d{2})/(\d{2})/(\d{2})"
    n = lambda i: F.regexp_extract(text, pattern, i).try_cast("int")
    day = lambda i: F.try_make_timestamp(n(i + 2) + 2000, n(i + 1), n(i), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")
    return F.when(text.rlike(pattern), F.struct(day(1).alias("start"), day(4).alias("end")))


def fee_table(text: Column) -> Column:
    """``label, amount`` of a listing's fees in EUR: of its early, regular and late rows the academic column, else the least that stands with students, else what is there; an empty label without any."""
    number = r"(\d+(?:[.,]\d+)?)"
    found = lambda p, i: F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(i)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    rows = rf"(?i)(?:Early Bird|Regular|Late Bird)\s+{number}\s*EUR\s+{number}\s*EUR"
    inside, outside = found(rows, 1), found(rows, 2)
    student = found(rf"(?i)(?:student|students|master'?s?|phd|doctoral)[^.\n]{{0,60}}?{number}\s*(?:EUR|€)", 1)
    every = found(rf"\b{number}\s*(?:EUR|€)", 1)
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    span = lambda a: F.concat(whole(F.array_min(a)), F.lit("-"), whole(F.array_max(a)))
    label = (
        F.when(F.size(inside) > 0, F.concat(F.lit("Academia EUR "), span(inside), F.lit("; non-academia up to EUR "), whole(F.array_max(outside))))
        .when(F.size(student) > 0, F.concat(F.lit("Student/PhD EUR "), whole(F.array_min(student))))
        .when(F.size(every) > 0, F.concat(F.lit("EUR "), span(every)))
        .otherwise("")
    )
    amount = F.when(F.size(inside) > 0, F.array_max(inside)).when(F.size(student) > 0, F.array_min(student)).otherwise(F.array_max(every))
    return F.struct(label.alias("label"), amount.alias("amount"))

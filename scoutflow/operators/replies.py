"""An extraction loop over recorded replies: requests keyed by what they ask, a log that keeps every reply, and items with their warnings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scoutflow.operators import evidence

LOG = "request_key string, page_url string, reply string, error string, asked_at timestamp"
# Opens one client for each task: prompt to reply. What it raises is the request's failure.
Client = Callable[[], Callable[[str], str]]


def requests(snippets: DataFrame, model: str, schema_version: str, instruction: str) -> DataFrame:
    """``page_url, request_key, prompt`` for each page of ``snippets`` (``page_url, id, text``).

    The key is a hash of all that the reply depends on: the page, its snippets in the order of their ids, the model, the version of the schema and the instruction.
    """
    number = F.regexp_extract("id", r"(\d+)", 1).try_cast("long")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), "id", "text"))), lambda s: F.concat(F.lit("["), s["id"], F.lit("] "), F.coalesce(s["text"], F.lit(""))))
    pages = snippets.groupBy("page_url").agg(F.array_join(lines, "\n").alias("lines"))
    prompt = F.concat_ws("\n", F.lit(instruction), F.concat(F.lit("Page: "), "page_url"), "lines")
    return pages.select("page_url", F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(schema_version), prompt), 256).alias("request_key"), prompt.alias("prompt"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log at ``path``; empty where there is none yet."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def latest(log: DataFrame) -> DataFrame:
    """One row a request: a reply where there is one, else its last failure."""
    best = F.max_by(F.struct("page_url", "reply", "error", "asked_at"), F.struct(F.col("reply").isNotNull(), "asked_at"))
    return log.groupBy("request_key").agg(best.alias("r")).select("request_key", "r.*")


def asked(rows: DataFrame, client: Client) -> DataFrame:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        complete = client()
        for batch in batches:
            out = []
            for key, url, prompt in zip(batch["request_key"], batch["page_url"], batch["prompt"]):
                try:
                    out.append((key, url, complete(prompt), None, pd.Timestamp.now()))
                except Exception as e:  # the model's failure is data: the page gets a warning
                    out.append((key, url, None, str(e), pd.Timestamp.now()))
            yield pd.DataFrame(out, columns=["request_key", "page_url", "reply", "error", "asked_at"])

    return rows.select("request_key", "page_url", "prompt").mapInPandas(ask, LOG)


def answer(wanted: DataFrame, path: str, client: Client, rounds: int = 1, retry_failures: bool = False) -> DataFrame:
    """The log at ``path`` with a row for each of ``wanted`` (see ``requests``); only requests without a reply there are sent, each once.

    Requests go out in ``rounds`` by their key, and a round's replies are appended when it is over: what ends a run loses the replies of one round, and the next run
    asks for these alone. Failures are kept like replies, and asked again with ``retry_failures``.
    """
    spark = wanted.sparkSession
    for at in range(rounds):
        known = read_log(spark, path)
        known = known.filter("reply is not null") if retry_failures else known
        mine = wanted.filter(F.pmod(F.conv(F.substring("request_key", 1, 8), 16, 10).cast("long"), F.lit(rounds)) == at).dropDuplicates(["request_key"])
        missing = mine.join(known.select("request_key").distinct(), "request_key", "left_anti")
        asked(missing, client).write.mode("append").parquet(path)
    return read_log(spark, path)


def items(wanted: DataFrame, log: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """``page_url, request_key, extraction, warnings`` of all requests: the reply as VARIANT, null where there is none.

    Warnings: ``llm_unavailable:`` and the failure, or ``llm_json_parse_failed`` for a reply that holds no object. Pages of ``empty`` (``page_url``) have no snippets and were
    not asked: ``no_evidence_snippets``.
    """
    rows = wanted.join(latest(log).select("request_key", "reply", "error"), "request_key", "left").withColumn("extraction", evidence.model_json(F.col("reply")))
    failed = F.when(F.col("reply").isNull(), F.concat(F.lit("llm_unavailable:"), F.coalesce("error", F.lit("not asked"))))
    unread = F.when((F.trim("reply") != "") & F.col("extraction").isNull(), "llm_json_parse_failed")
    out = rows.select("page_url", "request_key", "extraction", F.array_compact(F.array(failed, unread)).alias("warnings"))
    if empty is not None:
        nothing = empty.join(wanted.select("page_url"), "page_url", "left_anti")
        out = out.unionByName(nothing.select("page_url", F.lit("").alias("request_key"), F.lit(None).cast("variant").alias("extraction"), F.array(F.lit("no_evidence_snippets")).alias("warnings")))
    return out


def fields_of(extraction: Column, names: list[str]) -> Column:
    """A reply's fields as validation reads them: name to value and ids of evidence; plain values have no ids, fields that are missing are left out."""

    def one(name: str) -> Column:
        whole = F.try_variant_get(extraction, f"$.{name}", "variant")
        value = F.coalesce(F.try_variant_get(whole, "$.value", "string"), F.when(~F.schema_of_variant(whole).startswith("OBJECT"), F.try_variant_get(whole, "$", "string")))
        ids = F.coalesce(F.try_variant_get(whole, "$.evidence_ids", "array<string>"), F.array().cast("array<string>"))
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), F.struct(F.substring(value, 1, 500).alias("value"), evidence.evidence_ids(ids).alias("ids")).alias("value")))

    return F.map_from_entries(F.array_compact(F.array(*[one(n) for n in names])))

"""Queries that audit runs made of the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.operators import audit
from scoutflow.plans.scalars import table

FIELDS = "map<string,struct<value:string,ids:array<string>>>"
TOPICS = ["blue", "red", "green", "almond", "light", "dark blue"]


def _field(value: Column, ids: Column) -> Column:
    return F.struct(value.alias("value"), ids.alias("ids"))


def items(spark, sf_dir) -> DataFrame:
    """Orders as items of a run: odd ones lack evidence, dates, fees or confidence."""
    k = F.col("o_orderkey")
    some, none = F.array(F.lit("E1"), F.lit(" "), F.lit("E2")), F.array().cast("array<string>")
    start = _field(F.when(k % 5 == 0, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.when(k % 2 == 0, some).otherwise(none))
    fee = _field(F.when(k % 7 == 0, " Not stated ").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")), some)
    place = _field(F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")), none)
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("page_url"),
        F.when(k % 4 != 0, F.concat(F.lit("Order "), k)).otherwise("").alias("page_title"),
        F.when(k % 11 == 0, " ").when(k % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.when(k % 3 == 0, F.array(F.lit("missing_evidence_id:fee"), F.lit("deadline_past"))).when(k % 3 == 1, F.array(F.lit(":odd"))).alias("warnings"),
        F.map_from_arrays(F.array(F.lit("start_date"), F.lit("fee"), F.lit("location")), F.array(start, fee, place)).cast(FIELDS).alias("fields"),
        F.when(k % 2 == 0, F.array(F.lit("fee"), F.lit("location"))).alias("missing_before"),
        (k % 4 == 0).alias("re_extracted"),
    )


def audit_histograms(spark, sf_dir):
    return audit.histograms(items(spark, sf_dir))


def audit_fields(spark, sf_dir):
    return audit.field_audit(items(spark, sf_dir))


def run_disagreements(spark, sf_dir):
    """The run against a second one that writes places in capitals and knows no fee of every sixth order."""
    left = items(spark, sf_dir)
    fee = F.when(F.col("page_url").cast("long") % 6 == 0, F.lit(None)).otherwise(F.col("fields")["fee"]["value"])
    place = F.when(F.col("page_url").cast("long") % 13 == 0, F.lit("Elsewhere")).otherwise(F.upper(F.col("fields")["location"]["value"]))
    none = F.array().cast("array<string>")
    other = F.map_from_arrays(F.array(F.lit("start_date"), F.lit("fee"), F.lit("location")), F.array(F.col("fields")["start_date"], _field(fee, none), _field(place, none)))
    return audit.disagreements(left, left.withColumn("fields", other.cast(FIELDS)))


def publish_gate(spark, sf_dir):
    """Each customer's orders as a run of three outputs, by the order's number; the last of a kind counts."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), F.element_at(F.array(*[F.lit(x) for x in audit.KINDS]), (k % 3 + 1).cast("int")).alias("kind"),
        F.struct(k, F.to_date("o_orderdate").alias("generated"), F.when(k % 10 == 0, "Other").otherwise(" Model ").alias("provider"), (k % 7 != 0).alias("enabled"),
            F.when(k % 13 != 0, F.when(k % 5 == 0, F.array(F.lit("llm_skipped: no key"), F.lit("semantic_ranking_skipped:x"))).otherwise(F.array().cast("array<string>"))).alias("warnings"),
            (k % 4).alias("n_items"), (k % 8).alias("n_usable")).alias("x"),
    )
    last = rows.groupBy("run", "kind").agg(F.max("x").alias("x")).select("run", "kind", "x.*").withColumn("generated", F.when(F.col("o_orderkey") % 9 != 0, F.lit("2026-01-01").cast("date")).otherwise(F.col("generated")))
    return audit.publish_gate(last, F.lit("2026-01-01").cast("date"), "model")


def decoded_records(spark, sf_dir):
    """Orders as JSON records with texts for numbers, impossible dates and sessions that end before they begin, read back."""
    k = F.col("o_orderkey")
    session = lambda a, b: F.concat(F.lit('{"name":" S ","start_date":"'), a, F.lit('","end_date":"'), b, F.lit('"}'))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.when(k % 17 == 0, F.lit("no record")).otherwise(
        F.concat(
            F.lit('{"title":"Order","start_date":"'), F.when(k % 5 == 0, "2020-02-31").otherwise(day), F.lit('","duration_days":'), F.when(k % 4 == 0, '"many"').when(k % 4 == 1, "null").otherwise((k % 90).cast("string")),
            F.lit(',"funding_type":'), F.when(k % 3 == 0, '["grant","waiver"]').otherwise('"grant"'), F.lit(',"sessions":['), session(day, F.when(k % 2 == 0, day).otherwise("1990-01-01")), F.lit("]}"),
        )
    )
    out = audit.decoded(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")))
    return out.select("o_orderkey", "title", "start_date", "duration_days", F.size("funding_type").alias("n_funding"), F.size("sessions").alias("n_sessions"), F.array_join("bad", ",").alias("bad"))


def part_topics(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(audit.topics_in(F.col("p_name"), TOPICS), ",").alias("topics"))


def snapshot_checks(spark, sf_dir):
    """Suppliers as snapshots of two versions with lists of different sizes."""
    k = F.col("s_suppkey")
    reason = audit.snapshot_reason((k % 3).cast("int"), F.when(k % 7 != 0, k % 5), F.when(k % 4 != 0, k % 6), True)
    return table(spark, sf_dir, "supplier").select("s_suppkey", reason.alias("reason"))


_ITEMS = """i AS (SELECT o_orderkey AS k, CASE WHEN k % 5 <> 0 THEN strftime(o_orderdate::DATE, '%Y-%m-%d') END AS start, CASE WHEN k % 7 <> 0 THEN o_totalprice::DECIMAL(18,2)::VARCHAR END AS fee,
  CASE WHEN k % 3 <> 0 THEN o_orderpriority END AS place FROM orders)"""

QUERIES = {
    "audit_histograms": (
        audit_histograms,
        """SELECT 'warning' AS kind, w AS name, count(*) AS n FROM (SELECT unnest(CASE o_orderkey % 3 WHEN 0 THEN ['missing_evidence_id', 'deadline_past'] WHEN 1 THEN ['unknown_warning'] END) AS w FROM orders) GROUP BY w
        UNION ALL SELECT 'confidence', CASE WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS c, count(*) FROM orders GROUP BY c""",
    ),
    "audit_fields": (
        audit_fields,
        f"""WITH {_ITEMS}, f AS (SELECT k, 'start_date' AS field, start AS v, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS e FROM i UNION ALL SELECT k, 'fee', fee, 2 FROM i UNION ALL SELECT k, 'location', place, 0 FROM i
          UNION ALL SELECT k, unnest(['application_deadline', 'funding', 'application_url', 'end_date']), NULL, 0 FROM i)
        SELECT field, count(v) AS n_known, count(v) FILTER (e = 0) AS n_bare, coalesce(sum(e) FILTER (v IS NOT NULL), 0)::BIGINT AS n_ids, count(v) FILTER (k % 4 = 0 AND field IN ('fee', 'location')) AS n_gained FROM f GROUP BY field""",
    ),
    "run_disagreements": (
        run_disagreements,
        """WITH i AS (SELECT o_orderkey AS k, CASE WHEN k % 4 <> 0 THEN 'Order ' || k ELSE k::VARCHAR END AS t, CASE WHEN k % 7 = 0 THEN 'Not stated' ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS fee, CASE WHEN k % 3 <> 0 THEN o_orderpriority ELSE '' END AS place FROM orders)
        SELECT k::VARCHAR AS page_url, t AS page_title, 'fee' AS field, fee AS left_value, '' AS right_value FROM i WHERE k % 6 = 0
        UNION ALL SELECT k::VARCHAR, t, 'location', place, 'Elsewhere' FROM i WHERE k % 13 = 0""",
    ),
    "publish_gate": (
        publish_gate,
        f"""WITH l AS (SELECT o_custkey AS run, o_orderkey % 3 AS m, max(o_orderkey) AS k FROM orders GROUP BY 1, 2), a AS (SELECT run, m FROM (SELECT DISTINCT run FROM l), range(3) r(m))
        SELECT run, ['semantic', 'extraction', 'translation'][m + 1] AS kind, CASE WHEN k IS NULL THEN 'missing' WHEN k % 9 = 0 THEN 'stale' WHEN m = 2 AND k % 7 = 0 THEN 'disabled' WHEN m > 0 AND k % 10 = 0 THEN 'wrong_provider' WHEN k % 13 = 0 THEN 'invalid_warnings'
          WHEN m = 0 AND (k % 4 = 0 OR k % 5 = 0) THEN 'operational_failure' WHEN m = 1 AND k % 5 = 0 THEN 'operational_failure' WHEN m = 1 AND k % 8 = 0 THEN 'nothing_usable' ELSE '' END AS reason FROM a LEFT JOIN l USING (run, m)""",
    ),
    "decoded_records": (
        decoded_records,
        """SELECT o_orderkey, CASE WHEN bad THEN '' ELSE 'Order' END AS title, CASE WHEN NOT bad AND k % 5 <> 0 THEN d END AS start_date, CASE WHEN NOT bad AND k % 4 >= 2 THEN (k % 90)::INT END AS duration_days,
          CASE WHEN NOT bad AND k % 3 = 0 THEN 2 ELSE 0 END AS n_funding, CASE WHEN NOT bad AND k % 2 = 0 THEN 1 ELSE 0 END AS n_sessions,
          CASE WHEN bad THEN 'record' ELSE concat_ws(',', CASE WHEN k % 5 = 0 THEN 'start_date' END, CASE WHEN k % 4 = 0 THEN 'duration_days' END) END AS bad
        FROM (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 17 = 0 AS bad, o_orderdate::DATE AS d FROM orders)""",
    ),
    "part_topics": (
        part_topics,
        f"SELECT p_partkey, array_to_string(list_filter({TOPICS}, lambda t: regexp_matches(lower(p_name), '(^|[^a-z0-9_])' || t || '([^a-z0-9_]|$)')), ',') AS topics FROM part",
    ),
    "snapshot_checks": (
        snapshot_checks,
        """SELECT s_suppkey, CASE WHEN k % 3 = 0 THEN 'unsupported_version' WHEN k % 7 = 0 THEN 'invalid_opportunities' WHEN k % 5 = 0 THEN 'no_opportunities' WHEN k % 4 <> 0 AND k % 6 = 0 THEN 'no_scanner_opportunities'
          WHEN k % 4 = 0 AND k % 3 = 2 THEN 'missing_scanner_opportunities' ELSE '' END AS reason FROM (SELECT s_suppkey, s_suppkey AS k FROM supplier)""",
    ),
}

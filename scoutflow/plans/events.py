"""Queries over ``events``: state, streaks, caches, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.operators import state
from scoutflow.streaming import streams

CUT = "2024-01-16"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _seen(spark, sf_dir) -> DataFrame:
    rows = events(spark, sf_dir)
    per = lambda df: df.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("state_key"))
    old = rows.filter(F.col("ts") < CUT)
    previous = per(old).agg(F.to_date(F.min("ts")).alias("first_seen"), F.to_date(F.max("ts")).alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.lit("old").alias("status"))
    current = per(rows.filter((F.col("ts") >= CUT) & (F.col("user_id") % 3 != 0))).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("title"), F.lit("new").alias("status")).withColumn("url", F.concat(F.lit("http://"), "state_key"))
    return state.upsert_seen(previous, current, F.lit("2024-01-31").cast("date"))


def seen_state_upsert(spark, sf_dir):
    return _seen(spark, sf_dir)


def is_new_flag(spark, sf_dir):
    return _seen(spark, sf_dir).select("state_key", (F.col("first_seen") == F.lit("2024-01-31").cast("date")).alias("is_new"))


def status_refresh(spark, sf_dir):
    from scoutflow.functions.dates import refreshed_status

    day = F.to_date("ts")
    status = F.when(F.col("event_id") % 5 == 0, "not_open").when(F.col("event_id") % 5 == 1, "uncertain").otherwise("open")
    return events(spark, sf_dir).select("event_id", refreshed_status(status, F.when(F.col("event_id") % 4 != 0, day), F.lit(CUT).cast("date")).alias("status"))


def failure_streak_incremental(spark, sf_dir):
    """Health after a run: users are sources, and a run fails for a user whose last event is an odd one."""
    rows = events(spark, sf_dir)
    name = F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("name")
    previous = rows.filter(F.col("ts") < CUT).groupBy(name).agg((F.count(F.lit(1)) % 4).cast("int").alias("consecutive_failures"), F.to_date(F.max("ts")).alias("last_success"))
    attempts = rows.filter(F.col("ts") >= CUT).groupBy(name).agg((F.max("event_id") % 2 == 0).alias("ok"))
    return state.next_streaks(previous, attempts, F.lit("2024-01-31").cast("date"))


def failure_streak_islands(spark, sf_dir):
    return state.failure_islands(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_id") % 3 == 0).select("user_id", F.col("streak").cast("long").alias("streak"), "n")


def _exchange() -> tuple:
    k = F.col("event_id")
    status = F.when(k % 6 == 0, 304).when(k % 6 == 1, 500).when(k % 6 == 2, 429).when(k % 6 == 3, 404).otherwise(200)
    return status, k % 13 == 0, k % 2 == 0, F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))


def cache_outcome_machine(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", state.cache_outcome(*_exchange()).alias("outcome"))


def cache_prune(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.to_date("ts").alias("validated_at"))
    return state.pruned(rows, F.lit("2024-03-10").cast("date")).groupBy("validated_at").agg(F.count(F.lit(1)).alias("n"))


def json_props_keys(spark, sf_dir):
    """How often each key of the JSON properties is there."""
    keys = events(spark, sf_dir).select(F.explode(F.json_object_keys("props")).alias("key"))
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def manifest_rollup(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("event_id") % 10 != 0).alias("succeeded"), F.count_distinct("user_id").alias("users"))
    return rows.select("event_type", "attempted", "succeeded", "users", F.round(F.col("succeeded") / F.col("attempted"), 4).alias("ratio"))


def streaming_seen_state(spark, sf_dir):
    return streams.seen_state(spark, f"{sf_dir}/events.parquet")


def streaming_tumbling_counts(spark, sf_dir):
    return streams.tumbling_counts(spark, f"{sf_dir}/events.parquet")


def session_windows(spark, sf_dir):
    """Sessions of each user with gaps of six hours: an extension, on the batch side."""
    rows = events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


_SEEN = f"""WITH o AS (SELECT 'u' || user_id AS state_key, min(ts)::DATE AS first_seen, max(ts)::DATE AS last_seen, arg_max(event_type, (ts, event_id)) AS title FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1),
n AS (SELECT 'u' || user_id AS state_key, arg_max(event_type, (ts, event_id)) AS title FROM events WHERE ts >= TIMESTAMP '{CUT}' AND user_id % 3 <> 0 GROUP BY 1),
seen AS (SELECT coalesce(n.state_key, o.state_key) AS state_key, coalesce(o.first_seen, DATE '2024-01-31') AS first_seen, CASE WHEN n.state_key IS NOT NULL THEN DATE '2024-01-31' ELSE o.last_seen END AS last_seen,
  coalesce(n.title, o.title) AS title, CASE WHEN n.state_key IS NOT NULL THEN 'new' ELSE 'old' END AS status FROM o FULL JOIN n ON o.state_key = n.state_key)"""

QUERIES = {
    "seen_state_upsert": (seen_state_upsert, f"{_SEEN} SELECT * FROM seen"),
    "is_new_flag": (is_new_flag, f"{_SEEN} SELECT state_key, first_seen = DATE '2024-01-31' AS is_new FROM seen"),
    "status_refresh": (
        status_refresh,
        f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'not_open' WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 5 = 1 THEN 'uncertain' ELSE 'open' END WHEN ts::DATE < DATE '{CUT}' THEN 'closed' ELSE 'open' END AS status FROM events",
    ),
    "failure_streak_incremental": (
        failure_streak_incremental,
        f"""WITH p AS (SELECT 's' || user_id AS name, (count(*) % 4)::INT AS c, max(ts)::DATE AS ls FROM events WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1),
        a AS (SELECT 's' || user_id AS name, max(event_id) % 2 = 0 AS ok FROM events WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1)
        SELECT name, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, DATE '2024-01-31' AS last_attempt, CASE WHEN ok THEN DATE '2024-01-31' ELSE ls END AS last_success, (CASE WHEN ok THEN 0 ELSE coalesce(c, 0) + 1 END)::INT AS consecutive_failures
        FROM a LEFT JOIN p USING (name)""",
    ),
    "failure_streak_islands": (
        failure_streak_islands,
        """SELECT user_id, streak, count(*) AS n FROM (SELECT user_id, event_id % 3 = 0 AS failed, (sum((event_id % 3 <> 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS streak FROM events) WHERE failed GROUP BY 1, 2""",
    ),
    "cache_outcome_machine": (
        cache_outcome_machine,
        """SELECT event_id, CASE WHEN event_id % 13 <> 0 AND event_id % 6 IN (4, 5) THEN 'fresh' WHEN event_id % 13 <> 0 AND event_id % 6 = 0 AND event_id % 2 = 0 THEN 'revalidated'
        WHEN (event_id % 13 = 0 OR event_id % 6 IN (1, 2)) AND event_id % 2 = 0 AND DATE '2024-01-31' - ts::DATE <= 14 THEN 'stale' ELSE 'error' END AS outcome FROM events""",
    ),
    "cache_prune": (cache_prune, "SELECT ts::DATE AS validated_at, count(*) AS n FROM events WHERE DATE '2024-03-10' - ts::DATE <= 45 GROUP BY 1"),
    "json_props_keys": (json_props_keys, "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1"),
    "manifest_rollup": (manifest_rollup, "SELECT event_type, count(*) AS attempted, count(*) FILTER (event_id % 10 <> 0) AS succeeded, count(DISTINCT user_id) AS users, round(count(*) FILTER (event_id % 10 <> 0) / count(*), 4) AS ratio FROM events GROUP BY 1"),
    "streaming_seen_state": (streaming_seen_state, "SELECT user_id, floor(epoch(min(ts)))::BIGINT AS first_seen, floor(epoch(max(ts)))::BIGINT AS last_seen, count(*) AS n FROM events GROUP BY 1"),
    "streaming_tumbling_counts": (streaming_tumbling_counts, "SELECT epoch(date_trunc('day', ts))::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "session_windows": (
        session_windows,
        """WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true))::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    ),
}

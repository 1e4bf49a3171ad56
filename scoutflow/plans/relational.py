"""Queries over the order tables, read as opportunity records: orders are candidates, customers organisers, nations places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.functions import money
from scoutflow.operators import browse as br
from scoutflow.operators import compare, filters, scoring
from scoutflow.operators.topk import best_per_key, keep_if_better, round_robin, soonest_upcoming

AS_OF = "1998-06-01"
FX = [(0, 1.0), (1, 2.0), (2, 3.0)]
OVERRIDES = [("Customer#000000005", "", "exclude", ""), ("", "00001", "note", "seen by hand"), ("", "00007", "note", "listed")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def candidates(spark, sf_dir) -> DataFrame:
    """Orders in the shape of candidates. Amounts and days come from keys, so that every rule has rows."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return rows.select(
        k.alias("rid"),
        F.concat(F.lit("Order "), k.cast("string")).alias("title"),
        F.col("c_name").alias("organizer"),
        F.col("n_name").alias("location"),
        F.col("n_regionkey").alias("region"),
        day.alias("start_date"),
        F.when(k % 3 == 0, day).alias("deadline"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("uncertain").alias("deadline_status"),
        F.when(k % 11 != 0, (k % 25 + 1).cast("int")).alias("duration_days"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("funding_available"),
        F.when(k % 5 == 0, F.array(F.lit("travel grant"))).otherwise(F.array().cast("array<string>")).alias("funding_type"),
        F.when(k % 4 != 0, F.floor(F.col("o_totalprice") / 5) / 100).alias("fee_eur"),
        F.when(k % 8 == 0, "see page").otherwise("").alias("fee"),
        F.when(k % 7 == 0, "online").when(k % 7 == 1, "uncertain").otherwise("in-person").alias("mode"),
        F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.split("c_mktsegment", "(?=[AEIOU])")).alias("topic_keywords"),
        F.when(F.col("n_regionkey") == 3, "priority").when(F.col("n_regionkey") == 1, "supplementary").otherwise("unclassified").alias("region_priority"),
        F.when(F.col("o_orderpriority").startswith("1"), "1").when(F.col("o_orderpriority").startswith("2"), "2").otherwise("discovery").alias("source_layer"),
        F.when(k % 9 == 0, "uncertain").otherwise("doctoral").alias("target_level"),
    )


def _filtered(spark, sf_dir) -> DataFrame:
    return filters.apply_hard_filters(candidates(spark, sf_dir), as_of())


def hard_filter_reasons(spark, sf_dir):
    return _filtered(spark, sf_dir).select("rid", "deadline_status", "financial_access_status", F.array_join("failed_hard_conditions", "; ").alias("reasons"))


def weighted_score_rank(spark, sf_dir):
    """The fifty best candidates by score; ties by id."""
    return scoring.scored(_filtered(spark, sf_dir)).orderBy(F.desc("score"), "rid").limit(50).select("rid", F.round("score", 4).alias("score"))


def candidate_scores(spark, sf_dir):
    return scoring.scored(_filtered(spark, sf_dir)).select("rid", F.round("score", 4).alias("score"))


def _tiers(spark, sf_dir) -> DataFrame:
    per_day = money.fee_per_day(F.col("fee_eur"), F.col("duration_days"))
    public = filters.public_candidate(F.col("deadline_status") == "closed", F.col("mode") == "online", F.col("title"), F.col("duration_days"))
    return _filtered(spark, sf_dir).withColumn("tier", filters.tier(public, F.size("failed_hard_conditions") == 0, F.col("duration_days"), F.col("funding_available"), per_day))


def tier_classify(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("tier", "region").agg(F.count(F.lit(1)).alias("n"))


def tier_topn(spark, sf_dir):
    from scoutflow.operators.topk import top_per_group

    rows = scoring.scored(_tiers(spark, sf_dir)).filter("tier <> 'hidden'")
    return top_per_group(rows, ["tier"], [F.desc("score"), F.asc("rid")], 10).select("tier", "rid", F.round("score", 4).alias("score"), "rank")


def review_queue(spark, sf_dir):
    rows = scoring.scored(_filtered(spark, sf_dir)).filter("size(failed_hard_conditions) > 0 and deadline_status <> 'closed' and coalesce(duration_days, 5) >= 5")
    return rows.withColumn("priority", scoring.review_priority()).orderBy(F.desc("priority"), F.desc("score"), "rid").limit(40).select("rid", "priority", F.round("score", 4).alias("score"))


def fee_per_day(spark, sf_dir):
    per = money.fee_per_day(F.col("fee_eur"), F.col("duration_days"))
    return candidates(spark, sf_dir).select("rid", F.when(per < float("inf"), F.round(per, 6)).otherwise(-1.0).alias("per_day"))


def fx_fee_to_eur(spark, sf_dir):
    """Balances written as fees, read back and converted by the rate of the nation's currency; others stay unknown."""
    fx = spark.createDataFrame(FX, "cur int, rate double")
    rows = table(spark, sf_dir, "customer").withColumn("cur", F.col("c_nationkey") % 5)
    fee = F.concat(F.lit("fee "), F.format_string("%.2f", F.abs("c_acctbal")))
    return rows.join(F.broadcast(fx), "cur", "left").select("c_custkey", money.fee_to_eur(fee, F.col("rate")).alias("fee_eur"))


def overrides_theta_apply(spark, sf_dir):
    """Customers with hand-made overrides, found by name or part of it: any exclusion drops the row, notes are joined in order."""
    over = spark.createDataFrame([(i, *o) for i, o in enumerate(OVERRIDES)], "ord int, name string, part string, action string, note string")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    hit = rows.join(F.broadcast(over), (F.col("c_name") == F.col("name")) | ((F.col("part") != "") & F.contains("c_name", "part")), "left")
    got = hit.groupBy("c_custkey").agg(F.coalesce(F.max(F.col("action") == "exclude"), F.lit(False)).alias("out"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("action") == "note", F.struct("ord", "note")))), lambda s: s["note"]), "; ").alias("notes"))
    return got.filter(~F.col("out")).select("c_custkey", "notes")


def round_robin_interleave(spark, sf_dir):
    """Parts by brand in turn, the first three turns."""
    return round_robin(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")]).filter("turn <= 3").select("p_partkey", "p_brand", "turn")


def soonest_future_edition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return soonest_upcoming(rows, ["o_custkey"], "day", as_of(), "o_orderkey")


def best_item_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    return best_per_key(rows, ["l_orderkey"], [F.col("qty"), -F.col("disc")], "l_linenumber")


def keep_if_better_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("worth"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.max("l_extendedprice") * 3, 2).alias("worth"))
    return keep_if_better(o, sums, "o_orderkey", "worth")


def facet_browse_page(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.concat_ws(" ", "p_name", "p_type").alias("search_text"), F.concat_ws("|", "p_brand", F.split("p_type", " ")[0]).alias("topics"), (F.col("p_size") > 25).alias("is_new"))
    return br.browse(rows, [F.asc("p_partkey")], page=2, search="e", fresh=True).select("p_partkey", "brand")


def topic_facet(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_brand", F.split("p_type", " ")[0]).alias("topics"))
    return br.topic_facet(rows)


def coverage_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("o_orderstatus") != "P").alias("succeeded"))
    return rows.select("year", compare.coverage(F.col("attempted"), F.col("succeeded")).alias("coverage"), compare.coverage_gate(F.col("attempted"), F.col("succeeded")).alias("gate"))


def retention_gate(spark, sf_dir):
    """Each year's orders against the year before."""
    n = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    before = n.select((F.col("year") + 1).alias("year"), F.col("n").alias("before"))
    return n.join(before, "year").select("year", "before", "n", compare.retention_gate(F.col("before"), F.col("n")).alias("gate"))


def critical_completion(spark, sf_dir):
    fields = ["deadline", "duration_days", "fee_eur", "funding_available"]
    rows = candidates(spark, sf_dir).agg(*[F.count_if(F.col(f).isNotNull()).alias(f) for f in fields], F.count(F.lit(1)).alias("total"))
    return rows.select("total", *fields)


_CAND = f"""cand AS (
  SELECT o_orderkey AS rid, c_name, n_regionkey AS region, o_orderdate::DATE AS start_date, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS deadline,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'uncertain' END AS status0,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 25 + 1)::INT END AS days, o_orderkey % 5 = 0 AS funded,
    CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice / 5) / 100 END AS fee_eur, CASE WHEN o_orderkey % 8 = 0 THEN 'see page' ELSE '' END AS fee,
    CASE o_orderkey % 7 WHEN 0 THEN 'online' WHEN 1 THEN 'uncertain' ELSE 'in-person' END AS mode,
    CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 1 + length(regexp_replace(substr(c_mktsegment, 2), '[^AEIOU]', '', 'g')) END AS topics,
    CASE n_regionkey WHEN 3 THEN 12 WHEN 1 THEN 5 ELSE 0 END AS region_points,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 10 WHEN '2' THEN 5 ELSE 0 END AS layer_points, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 8 END AS level_points,
    o_orderkey % 5 IN (0, 1) AS funding_known
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
settled AS (SELECT *, CASE WHEN status0 = 'uncertain' AND deadline IS NULL AND start_date <= DATE '{AS_OF}' + 15 THEN 'closed' ELSE status0 END AS status FROM cand),
judged AS (SELECT *, list_filter([
    CASE status WHEN 'closed' THEN 'application deadline has passed' WHEN 'uncertain' THEN 'application deadline is uncertain' END,
    CASE WHEN days IS NULL THEN 'duration is uncertain' WHEN days < 5 THEN 'duration is below 5 days' END,
    CASE WHEN NOT funded AND NOT coalesce(fee_eur <= 400, false) THEN CASE WHEN fee_eur IS NOT NULL THEN 'fee exceeds EUR 400 without explicit funding' WHEN fee <> '' THEN 'funding is not explicit and fee equivalence is uncertain' ELSE 'funding is not explicit and fee is uncertain' END END,
    CASE mode WHEN 'online' THEN 'online-only' WHEN 'uncertain' THEN 'in-person status is uncertain' END,
    CASE WHEN topics = 0 THEN 'topic relevance is uncertain' END], lambda x: x IS NOT NULL) AS failed FROM settled),
scored AS (SELECT *, round(greatest(least(topics * 6, 30) + CASE WHEN funded THEN 25 WHEN fee_eur IS NOT NULL THEN 12 ELSE 0 END + CASE status WHEN 'open' THEN 15 WHEN 'uncertain' THEN 4 ELSE 0 END
    + CASE WHEN coalesce(days, 0) >= 5 THEN least(days, 20) ELSE coalesce(days, 0) / 2 END + region_points + layer_points + CASE mode WHEN 'in-person' THEN 10 ELSE 0 END + level_points - 8 * len(failed), 0)::DOUBLE, 4) AS score FROM judged),
tiered AS (SELECT *, CASE WHEN len(failed) = 0 THEN 'qualified' WHEN status = 'closed' OR mode = 'online' OR coalesce(days < 5, false) THEN 'hidden'
    WHEN coalesce(days, 0) >= 5 AND (funded OR coalesce(fee_eur / days <= 70, false)) THEN 'high' ELSE 'found' END AS tier FROM scored)"""

QUERIES = {
    "hard_filter_reasons": (hard_filter_reasons, f"WITH {_CAND} SELECT rid, status AS deadline_status, CASE WHEN funded THEN 'funded' WHEN fee_eur <= 400 THEN 'low-fee' ELSE 'unresolved' END AS financial_access_status, array_to_string(failed, '; ') AS reasons FROM judged"),
    "weighted_score_rank": (weighted_score_rank, f"WITH {_CAND} SELECT rid, score FROM scored ORDER BY score DESC, rid LIMIT 50"),
    "candidate_scores": (candidate_scores, f"WITH {_CAND} SELECT rid, score FROM scored"),
    "tier_classify": (tier_classify, f"WITH {_CAND} SELECT tier, region, count(*) AS n FROM tiered GROUP BY 1, 2"),
    "tier_topn": (tier_topn, f"WITH {_CAND} SELECT tier, rid, score, (row_number() OVER (PARTITION BY tier ORDER BY score DESC, rid))::INT AS rank FROM tiered WHERE tier <> 'hidden' QUALIFY rank <= 10"),
    "review_queue": (
        review_queue,
        f"""WITH {_CAND}, p AS (SELECT rid, score, (4 * (len(list_filter(failed, lambda x: contains(x, 'funding is not explicit'))) > 0)::INT + 2 * (len(list_filter(failed, lambda x: contains(x, 'fee'))) > 0)::INT
          + 2 * (len(list_filter(failed, lambda x: contains(x, 'deadline is uncertain'))) > 0)::INT + (len(list_filter(failed, lambda x: contains(x, 'duration is uncertain'))) > 0)::INT)::INT AS priority
          FROM scored WHERE len(failed) > 0 AND status <> 'closed' AND coalesce(days, 5) >= 5)
        SELECT rid, priority, score FROM p ORDER BY priority DESC, score DESC, rid LIMIT 40""",
    ),
    "fee_per_day": (fee_per_day, f"WITH {_CAND} SELECT rid, coalesce(round(fee_eur / days, 6), -1.0) AS per_day FROM cand"),
    "fx_fee_to_eur": (fx_fee_to_eur, "SELECT c_custkey, round(round(abs(c_acctbal), 2) * CASE c_nationkey % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE END, 2) AS fee_eur FROM customer"),
    "overrides_theta_apply": (
        overrides_theta_apply,
        """SELECT c_custkey, concat_ws('; ', CASE WHEN contains(c_name, '00001') THEN 'seen by hand' END, CASE WHEN contains(c_name, '00007') THEN 'listed' END) AS notes FROM customer WHERE c_name <> 'Customer#000000005'""",
    ),
    "round_robin_interleave": (round_robin_interleave, "SELECT p_partkey, p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey))::INT AS turn FROM part QUALIFY turn <= 3"),
    "soonest_future_edition": (soonest_future_edition, f"SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE >= DATE '{AS_OF}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey) = 1"),
    "best_item_per_key": (best_item_per_key, "SELECT l_orderkey, l_linenumber, l_quantity AS qty, l_discount AS disc FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount, l_linenumber) = 1"),
    "keep_if_better_merge": (
        keep_if_better_merge,
        """WITH r AS (SELECT l_orderkey AS o_orderkey, round(max(l_extendedprice) * 3, 2) AS w FROM lineitem GROUP BY 1)
        SELECT o_orderkey, CASE WHEN w >= round(o_totalprice, 2) THEN w ELSE round(o_totalprice, 2) END AS worth, coalesce(w >= round(o_totalprice, 2), false) AS replaced FROM orders LEFT JOIN r USING (o_orderkey)""",
    ),
    "facet_browse_page": (facet_browse_page, "SELECT p_partkey, p_brand AS brand FROM part WHERE contains(lower(p_name || ' ' || p_type), 'e') AND p_size > 25 ORDER BY p_partkey LIMIT 15 OFFSET 15"),
    "topic_facet": (topic_facet, "SELECT min(t) AS topic, count(*) AS n FROM (SELECT unnest([p_brand, string_split(p_type, ' ')[1]]) AS t FROM part) WHERE t <> '' GROUP BY lower(t)"),
    "coverage_gate": (
        coverage_gate,
        """SELECT year, round(s / a, 4) AS coverage, CASE WHEN round(s / a, 4) < 0.7 THEN 'error: low coverage' ELSE 'ok' END AS gate
        FROM (SELECT year(o_orderdate)::INT AS year, count(*) AS a, count(*) FILTER (o_orderstatus <> 'P') AS s FROM orders GROUP BY 1)""",
    ),
    "retention_gate": (
        retention_gate,
        """WITH n AS (SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1)
        SELECT n.year, b.n AS before, n.n, CASE WHEN b.n >= 10 AND n.n < b.n * 0.35 THEN 'error: low retention' ELSE 'ok' END AS gate FROM n JOIN n b ON n.year = b.year + 1""",
    ),
    "critical_completion": (critical_completion, f"WITH {_CAND} SELECT count(*) AS total, count(deadline) AS deadline, count(days) AS duration_days, count(fee_eur) AS fee_eur, count(*) FILTER (funding_known) AS funding_available FROM cand"),
}

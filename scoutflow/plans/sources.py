"""Queries that read through sources: damaged files written from a table, searches, and texts that must keep what another says."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutflow.functions import preserve
from scoutflow.plans.candidates import table
from scoutflow.sources import ordered, resilient, search
from scoutflow.streaming.streams import shared_folder


def damaged_payloads(spark, sf_dir):
    """Suppliers of each nation as a JSON document: sound, cut off, a list, without its list, or not there."""
    s = table(spark, sf_dir, "supplier")
    items = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name", "s_acctbal"))), lambda x: F.struct(x["s_name"].alias("page_url"), x["s_acctbal"].alias("balance")))
    n = F.col("s_nationkey")
    body = lambda name: F.to_json(F.struct(F.lit("2026-01-01").alias("generated"), F.col("items").alias(name)))
    text = F.when(n % 5 == 0, body("items")).when(n % 5 == 1, F.substring(body("items"), 1, 50)).when(n % 5 == 2, F.to_json("items")).otherwise(body("rows"))
    folder = shared_folder(spark, "payloads")
    s.groupBy("s_nationkey").agg(items.alias("items")).filter(n % 5 != 4).select(text.alias("value"), n.alias("n")).repartition("n").write.partitionBy("n").text(folder)
    nations = [r["n_nationkey"] for r in table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # a dimension of fixed size
    got = resilient.read_payloads(spark, [f"{folder}/n={k}" for k in nations], "items")
    counts = resilient.items_by_key(got, "items", "page_url").groupBy("path").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.try_variant_get("item", "$.balance", "double").cast("decimal(18,2)")).alias("balance"))
    key = F.regexp_extract("path", r"n=(\d+)$", 1).cast("long")
    return got.join(counts, "path", "left").select(key.alias("n_nationkey"), "outcome", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce(F.col("balance").cast("double"), F.lit(0.0)).alias("balance"))


def _search():
    def find(query: str) -> list[dict]:
        n = int(query.split()[-1])
        if n % 7 == 3:
            raise ValueError("no answer")
        site = f"http://www.s{n}.example"
        return [{"url": u, "title": query} for u in (f"{site}/p1", f"http://other.example/{n}", f"{site}/p2#x", f"{site}/p3", f"{site}/f.pdf", f"{site}/p4")]

    return find


def search_results(spark, sf_dir):
    """Orders' pages that search for their customer, two queries each with one provider that is not there; what a page has seen is not read again."""
    o = table(spark, sf_dir, "orders")
    cust = F.col("o_custkey").cast("string")
    parent = F.concat(F.lit("http://s"), cust, F.lit(".example/"), F.col("o_orderkey").cast("string"))
    asked = o.select(parent.alias("parent"), F.explode(F.array(F.struct(F.concat(F.lit("find "), cust).alias("query"), F.lit("a").alias("provider"), F.lit(1).alias("ord")), F.struct(F.concat(F.lit("more "), cust).alias("query"), F.lit("b").alias("provider"), F.lit(2).alias("ord")))).alias("q"))
    asked = asked.select("parent", "q.*")
    seen = o.filter("o_orderkey % 2 = 0").select(parent.alias("parent"), F.concat(F.lit("http://www.s"), cust, F.lit(".example/p2")).alias("url"))
    results = search.searched(asked, {"a": _search}, spacing=0.0)
    return search.results_of_parents(results, asked.select("parent", "query", "ord"), seen, 2).select("parent", "url", F.col("ord").cast("int").alias("ord"))


def kept_words(spark, sf_dir):
    """Turns of conversations and the answers to them: names and words that the answer does not keep."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    answer = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("changed"))
    pairs = c.select("conv_id", "turn", F.col("text").alias("original"), F.concat_ws("-", "conv_id", "turn").alias("id")).join(answer, ["conv_id", "turn"])
    lost = preserve.lost_tokens(F.col("original"), F.col("changed"), "[A-Z][a-z]{2,}")
    rows = pairs.select("id", F.size(lost).alias("n_names"), F.coalesce(F.get(lost, F.lit(0)), F.lit("")).alias("first_name"), preserve.has_han(F.col("changed")).alias("han"))
    words = preserve.missing_words(pairs, "id").groupBy("id").agg(F.sum("n").alias("n_words"), F.max("word").alias("last_word"))
    return rows.join(words, "id", "left").select("id", "n_names", "first_name", "han", F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("last_word", F.lit("")).alias("last_word"))


def _web():
    def get(url: str) -> tuple[int, str, str]:
        kind, _, key = url.rpartition("/")
        n = int(key)
        if n % 5 == 1:
            raise TimeoutError("no answer")
        if n % 5 == 2:
            return 503, url, "busy"
        if n % 5 == 3 and not kind.endswith("/now"):
            return 200, url + "?landing", f"<title>Old</title><META content=\"0; URL='/now/{n + 5}'\" http-equiv=refresh><p>old</p>"
        return 200, url, f"<html><title>{'' if n % 2 else 'T  ' + key}</title><script>x</script><p>Page {key}</p></html>"

    return get


def ordered_fetch(spark, sf_dir):
    """Customers as sources of ten hosts, a third of them on one, some failing, some refreshing: pages and errors with the order of the list."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    host = F.when(k % 3 == 0, F.lit("big")).otherwise(F.concat(F.lit("h"), (k % 9).cast("string")))
    sources = c.select(k.alias("ord"), F.col("c_name").alias("name"), F.concat(F.lit("http://"), host, F.lit(".example/"), k.cast("string")).alias("url"))
    got = ordered.collected(sources, _web, lanes=2)
    pages = ordered.pages_of(got).select("ord", "url", "title", "text", F.lit("").alias("error"))
    return pages.unionByName(ordered.errors_of(got).select("ord", F.lit("").alias("url"), F.lit("").alias("title"), F.lit("").alias("text"), "error"))


QUERIES = {
    "ordered_fetch": (
        ordered_fetch,
        """WITH a AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'big' ELSE 'h' || c_custkey % 9 END AS h, CASE WHEN c_custkey % 5 = 3 THEN c_custkey + 5 ELSE c_custkey END AS n, c_custkey % 5 IN (1, 2) AS bad FROM customer)
        SELECT k AS ord, CASE WHEN bad THEN '' ELSE 'http://' || h || '.example/' || CASE WHEN n <> k THEN 'now/' ELSE '' END || n END AS url, CASE WHEN bad THEN '' WHEN n % 2 = 1 THEN c_name ELSE 'T ' || n END AS title, CASE WHEN bad THEN '' ELSE 'Page ' || n END AS text,
          CASE k % 5 WHEN 1 THEN c_name || ': no answer' WHEN 2 THEN c_name || ': HTTP 503 for http://' || h || '.example/' || k ELSE '' END AS error FROM a""",
    ),
    "damaged_payloads": (
        damaged_payloads,
        """WITH s AS (SELECT s_nationkey AS k, count(DISTINCT s_name) AS n, sum(s_acctbal::DECIMAL(18, 2))::DOUBLE AS b FROM supplier GROUP BY 1)
        SELECT n_nationkey, CASE WHEN n IS NULL OR n_nationkey % 5 = 4 THEN 'missing' ELSE ['ok', 'invalid', 'not_object', 'no_items'][n_nationkey % 5 + 1] END AS outcome,
          CASE WHEN n_nationkey % 5 = 0 THEN coalesce(n, 0) ELSE 0 END AS n_items, CASE WHEN n_nationkey % 5 = 0 THEN coalesce(b, 0) ELSE 0 END AS balance FROM nation LEFT JOIN s ON k = n_nationkey""",
    ),
    "search_results": (
        search_results,
        """WITH a AS (SELECT 's' || o_custkey || '.example/' AS site, o_orderkey % 2 = 0 AS even, o_orderkey FROM orders WHERE o_custkey % 7 <> 3)
        SELECT 'http://' || site || o_orderkey AS parent, 'http://www.' || site || 'p1' AS url, 1 AS ord FROM a UNION ALL SELECT 'http://' || site || o_orderkey, 'http://www.' || site || CASE WHEN even THEN 'p3' ELSE 'p2' END, 2 FROM a""",
    ),
    "kept_words": (
        kept_words,
        """WITH p AS (SELECT a.conv_id || '-' || a.turn AS id, a.text AS o, b.text AS c FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL),
        l AS (SELECT id, o, c, list_filter(regexp_extract_all(o, '[A-Z][a-z]{2,}'), lambda t: NOT contains(c, t)) AS lost FROM p),
        w AS (SELECT id, unnest(string_split_regex(lower(o), '[^\\p{L}\\p{N}]+')) AS w, 1 AS s FROM p UNION ALL SELECT id, unnest(string_split_regex(lower(c), '[^\\p{L}\\p{N}]+')), -1 FROM p),
        m AS (SELECT id, w, sum(s) AS n FROM w WHERE w <> '' GROUP BY ALL HAVING sum(s) > 0), g AS (SELECT id, sum(n)::BIGINT AS n_words, max(w) AS last_word FROM m GROUP BY 1)
        SELECT id, len(list_distinct(lost))::INT AS n_names, coalesce(lost[1], '') AS first_name, regexp_matches(c, '[㐀-鿿]') AS han, coalesce(n_words, 0) AS n_words, coalesce(last_word, '') AS last_word FROM l LEFT JOIN g USING (id)""",
    ),
}

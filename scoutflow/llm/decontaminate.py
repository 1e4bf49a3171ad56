"""Benchmark decontamination: broadcast n-gram set, scanned token windows, exact verification.

A window is ``n`` consecutive words of a benchmark item (a shorter item is one window). Words are hashed once
and windows from their words' hashes; every document's windows probe the set of window hashes, which is broadcast when
small; what is found is verified word by word. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import ascii_lower, let, load, written

N = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words: runs of ASCII letters, digits and any non-ASCII character. Null: no words."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def window_set(benchmark: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: ``len, hash, gram`` (the words) and ``items``, the sorted ids that hold it."""
    toks = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(n - 1), F.lit(1)))
    grams = toks.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram"))
    per = grams.groupBy("gram").agg(F.sort_array(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
    chain = lambda k: F.xxhash64(*[F.xxhash64(F.get("gram", F.lit(j))) for j in range(k)])
    hashes = F.element_at(F.array(*[chain(k) for k in range(1, n + 1)]), F.size("gram"))
    return per.select(F.size("gram").alias("len"), hashes.alias("hash"), "gram", "items")


def window_hashes(k: int) -> Column:
    """Structs ``len, pos, hash`` of all windows of ``k`` words, from the array ``h`` of word hashes."""
    starts = F.when(F.size("h") >= k, F.sequence(F.lit(0), F.size("h") - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(k).alias("len"), i.alias("pos"), F.xxhash64(*[F.get("h", i + j) for j in range(k)]).alias("hash")))


def text_key() -> Column:
    """What tells apart rows that share a ``doc_id``."""
    return F.xxhash64("text")


def likely_hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Places whose window hash is in the set: ``doc_id, key, len, pos, gram, items``, not yet verified.

    One pass over the documents, whatever the window lengths. The scan explodes a fixed number of bytes for each window and
    probes the distinct hashes; the planner broadcasts these when the written table is small and shuffles otherwise.
    """
    lens = sorted(r["len"] for r in grams.select("len").distinct().collect())  # at most n rows
    hashed = docs.select("doc_id", text_key().alias("key"), F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    if not lens:
        return hashed.select("doc_id", "key", F.lit(0).alias("len"), F.lit(0).alias("pos"), F.array(F.lit("")).alias("gram"), F.array(F.lit("")).alias("items")).filter(F.lit(False))
    each = [window_hashes(k) for k in lens]
    windows = hashed.select("doc_id", "key", F.inline(F.concat(*each)))
    found = windows.join(written(grams.select("len", "hash").distinct(), "window-hashes"), ["len", "hash"])
    return found.join(grams, ["len", "hash"]).select("doc_id", "key", "len", "pos", "gram", "items")


def verified_hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The columns of ``docs`` with ``__hits``: verified occurrences ``pos`` (0-based word), ``len``, ``items``; null without any likely one.

    Rows sharing a ``doc_id`` keep their own hits. The words are taken from each row again where its hits are compared with
    them, so no window carries text through a shuffle.
    """
    grams = written(window_set(benchmark, n), "windows")
    per = likely_hits(docs, grams).groupBy("doc_id", "key").agg(F.collect_set(F.struct("pos", "len", "gram", "items")).alias("__likely"))
    # Written: few documents have any, and a table of known size is broadcast where it is small, so that texts stay where they are.
    per = written(per.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "__likely"), "likely-hits")
    joined = docs.join(per, docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__k")), "left")

    def true(w: Column) -> Column:
        return F.filter("__likely", lambda h: F.forall(F.sequence(F.lit(0), h["len"] - 1), lambda j: F.get(w, h["pos"] + j) == F.get(h["gram"], j)))

    return joined.withColumn("__hits", F.when(F.col("__likely").isNotNull(), let(words(F.col("text")), true))).drop("__d", "__k", "__likely")


def hit_words(hits: Column) -> Column:
    """Sorted distinct 0-based positions of the words inside any hit."""
    return F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))), F.array().cast("array<int>"))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row a document: ``doc_id, key, n_words, hit_words`` (sorted 0-based word positions), ``item_ids``.

    Null or empty texts have no words and no hits; repeated rows are each returned; an empty benchmark hits
    nothing. Every word inside any occurrence counts once.
    """
    found = verified_hits(docs.select("doc_id", "text"), benchmark, n)
    items = F.coalesce(F.sort_array(F.array_distinct(F.flatten(F.transform("__hits", lambda h: h["items"])))), F.array().cast("array<string>"))
    return found.select("doc_id", text_key().alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"), hit_words(F.col("__hits")).alias("hit_words"), items.alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` without what the benchmark holds: whole documents, or (``remove="spans"``) the hit words.

    Spans are cut with the characters between hit words; what remains of a text is joined by single spaces in
    words as they were written. Clean rows come back unchanged, null and empty texts too.
    """
    found = verified_hits(docs, benchmark, n)
    dirty = F.size(F.coalesce("__hits", F.array().cast(dict(found.dtypes)["__hits"]))) > 0
    if remove == "documents":
        return found.filter(~dirty).select(*docs.columns)
    original = F.filter(F.split("text", NOT_WORD), lambda w: w != "")
    rest = let(original, lambda w: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), hit_words(F.col("__hits"))), lambda i: F.get(w, i)), " "))
    return found.withColumn("text", F.when(dirty, rest).otherwise(F.col("text"))).select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


_WORDS = r"list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
DECON_CTES = (
    "bench_words AS MATERIALIZED (SELECT item_id::VARCHAR AS item, "
    + _WORDS.format(t="text")
    + """ AS w FROM benchmark),
bench_grams AS MATERIALIZED (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS gram, len(list_slice(w, i, i + 9)) AS k
  FROM (SELECT item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bench_words WHERE len(w) > 0)),
doc_words AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, """
    + _WORDS.format(t="text")
    + """ AS w FROM {docs}),
doc_grams AS (
  SELECT rid, i, k, list_slice(w, i, i + k - 1) AS gram
  FROM (SELECT rid, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM doc_words, (SELECT DISTINCT k FROM bench_grams) WHERE len(w) >= k)),
doc_hits AS MATERIALIZED (SELECT rid, i, d.k, item FROM doc_grams d JOIN bench_grams b ON d.gram = b.gram)
"""
)
ORACLE = (
    "WITH "
    + DECON_CTES.format(docs="documents")
    + """,
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + k - 1)) AS p FROM doc_hits) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM doc_hits GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (rid) LEFT JOIN hit_items t USING (rid)
"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_decontamination": op8_decontamination}
ORACLES: dict[str, str] = {"op8_decontamination": ORACLE}

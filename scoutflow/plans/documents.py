"""Queries over ``documents``, ``labels``, ``benchmark``, ``conversations`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.operators import compare, filters, semantic
from scoutflow.operators.topk import best_per_key, capped_top, char_budget, top_per_group

TOPICS = [("licence", "licen"), ("address", "@"), ("gnu", "gnu"), ("apache", "apache"), ("mit", "mit license")]
CORE, FILLER = r"(?i)(?:the|and|der|die|les|las) ", ["license", "@", "%%%"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark, sf_dir) -> DataFrame:
    return semantic.chunks(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", 800, 100)


def text_chunks_overlap(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


def _useful(spark, sf_dir) -> DataFrame:
    hits, filler = F.regexp_count("chunk", F.lit(CORE)), tx.count_terms(F.col("chunk"), FILLER)
    return _chunks(spark, sf_dir).withColumn("hits", hits).withColumn("filler", filler).filter("hits > 0 and not (filler >= 1 and hits < 20)")


def chunk_useful_filter(spark, sf_dir):
    return _useful(spark, sf_dir).select("doc_id", "chunk_index", "hits", "filler")


def chunk_topk_per_doc(spark, sf_dir):
    return top_per_group(_useful(spark, sf_dir), ["doc_id"], [F.desc("hits"), F.asc("chunk_index")], 2).select("doc_id", "chunk_index", "hits", "rank")


def select_top_docs_source_cap(spark, sf_dir):
    best = _useful(spark, sf_dir).groupBy("doc_id", "source").agg(F.max("hits").alias("best"))
    return capped_top(best, "source", [F.desc("best"), F.asc("doc_id")], 3, 30)


def char_budget_running(spark, sf_dir):
    cut = char_budget(_chunks(spark, sf_dir).select("doc_id", "chunk_index", "chunk"), ["doc_id"], [F.asc("chunk_index")], "chunk", 300, 1000)
    return cut.select("doc_id", "chunk_index", F.length("chunk").alias("size"))


def sentence_snippets(spark, sf_dir):
    """Distinct sentences of four words or more, at most five a document, the longest first."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n"), tx.clean_space)).alias("pos", "line"))
    kept = rows.filter(F.size(F.split("line", " ")) >= 4).groupBy("doc_id", F.lower("line").alias("low")).agg(F.min("pos").alias("pos"))
    top = top_per_group(kept.withColumn("size", F.length("low")), ["doc_id"], [F.desc("size"), F.asc("pos")], 5)
    return top.select("doc_id", F.concat(F.lit("E"), F.col("rank").cast("string")).alias("label"), "size", "pos")


def topic_theta_join(spark, sf_dir):
    """Documents by the topics whose mark they hold: a join on containment with a fixed list of five."""
    topics = spark.createDataFrame(TOPICS, "topic string, mark string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return docs.join(F.broadcast(topics), F.contains(F.col("low"), F.col("mark"))).select("doc_id", "topic")


def first_matching_type(spark, sf_dir):
    kind = F.lit("none")
    for name, mark in reversed(TOPICS):
        kind = F.when(F.contains(F.lower("text"), F.lit(mark)), name).otherwise(kind)
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


def multi_label_join(spark, sf_dir):
    marks = F.array(*[F.when(F.contains(F.lower("text"), F.lit(m)), F.lit(n)) for n, m in TOPICS])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.nullif(F.array_join(F.array_compact(marks), ", "), F.lit("")), F.lit("uncertain")).alias("labels"))


def exact_dup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def labelled_docs_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi").select("doc_id", "lang", "source")


def missed_docs_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def run_compare_full_outer(spark, sf_dir):
    return compare.run_diff(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


def field_agreement_pivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 7 == 0, "unknown").otherwise(F.col("lang")).alias("lang"), "source")
    other = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.upper("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")).alias("source"))
    return compare.field_agreement(docs, other, "doc_id", ["lang", "source"])


def yes_no_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    return compare.yes_rate(rows, ["lang"], "quality").select("lang", "yes", "no", F.round("rate", 6).alias("rate"))


def conversation_turn_budget(spark, sf_dir):
    cut = char_budget(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], [F.asc("turn"), F.asc("role"), F.asc("text")], "text", 80, 200)
    return cut.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


def cosine_topk(spark, sf_dir):
    """The five vectors most like vector 0, of each label."""
    rows = table(spark, sf_dir, "embeddings")
    query = rows.filter("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    near = rows.filter("vec_id <> 0").join(F.broadcast(query), F.lit(True)).withColumn("score", F.round(semantic.cosine(F.col("embedding"), F.col("q")), 6))
    return top_per_group(near, ["label"], [F.desc("score"), F.asc("vec_id")], 5).select("label", "vec_id", "score", "rank")


def cosine_best_per_label(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    query = rows.filter("vec_id = 1").select(F.col("embedding").alias("q")).limit(1)
    near = rows.filter("vec_id <> 1").join(F.broadcast(query), F.lit(True)).select("label", "vec_id", F.round(semantic.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return best_per_key(near, ["label"], [F.col("score")], "vec_id")


_CHUNKS = r"""clean AS (SELECT doc_id, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
chunks AS (SELECT doc_id, source, i::INT AS chunk_index, trim(substring(t, i * 700 + 1, 800)) AS chunk
  FROM (SELECT *, unnest(generate_series(0, greatest(ceil((length(t) - 800) / 700.0), 0)::BIGINT)) AS i FROM clean WHERE t <> ''))"""
_USEFUL = (
    _CHUNKS
    + r""", hits AS (SELECT *, len(regexp_extract_all(chunk, '(?i)(?:the|and|der|die|les|las) '))::INT AS hits,
  (contains(lower(chunk), 'license')::INT + contains(chunk, '@')::INT + contains(chunk, '%%%')::INT) AS filler FROM chunks),
useful AS (SELECT * FROM hits WHERE hits > 0 AND NOT (filler >= 1 AND hits < 20))"""
)
_MARK = "[" + ", ".join(f"CASE WHEN contains(lower(text), '{m}') THEN '{n}' END" for n, m in TOPICS) + "]"
_COSINE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {q} LIMIT 1)), 6)"

QUERIES = {
    "text_chunks_overlap": (text_chunks_overlap, f"WITH {_CHUNKS} SELECT doc_id, chunk_index, length(chunk)::INT AS size, md5(chunk) AS digest FROM chunks"),
    "chunk_useful_filter": (chunk_useful_filter, f"WITH {_USEFUL} SELECT doc_id, chunk_index, hits, filler FROM useful"),
    "chunk_topk_per_doc": (chunk_topk_per_doc, f"WITH {_USEFUL} SELECT doc_id, chunk_index, hits, (row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk_index))::INT AS rank FROM useful QUALIFY rank <= 2"),
    "select_top_docs_source_cap": (
        select_top_docs_source_cap,
        f"""WITH {_USEFUL}, b AS (SELECT doc_id, source, max(hits) AS best FROM useful GROUP BY 1, 2),
        c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source ORDER BY best DESC, doc_id) <= 3) SELECT * FROM c ORDER BY best DESC, doc_id LIMIT 30""",
    ),
    "char_budget_running": (
        char_budget_running,
        f"""WITH {_CHUNKS}, r AS (SELECT doc_id, chunk_index, length(chunk) AS n, coalesce(sum(least(length(chunk), 300)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM chunks)
        SELECT doc_id, chunk_index, least(n, 300, 1000 - before)::INT AS size FROM r WHERE least(300, 1000 - before) > 0""",
    ),
    "sentence_snippets": (
        sentence_snippets,
        r"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS s FROM documents)),
        k AS (SELECT doc_id, lower(line) AS low, min(pos) AS pos FROM l WHERE len(string_split(line, ' ')) >= 4 GROUP BY 1, 2)
        SELECT doc_id, 'E' || row_number() OVER (PARTITION BY doc_id ORDER BY length(low) DESC, pos) AS label, length(low)::INT AS size, pos::INT AS pos FROM k
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(low) DESC, pos) <= 5""",
    ),
    "topic_theta_join": (topic_theta_join, f"SELECT doc_id, topic FROM documents JOIN (VALUES {', '.join(f'{t}' for t in TOPICS)}) t(topic, mark) ON contains(lower(text), mark)"),
    "first_matching_type": (first_matching_type, f"SELECT doc_id, coalesce(list_filter({_MARK}, lambda x: x IS NOT NULL)[1], 'none') AS kind FROM documents"),
    "multi_label_join": (multi_label_join, f"SELECT doc_id, coalesce(nullif(array_to_string(list_filter({_MARK}, lambda x: x IS NOT NULL), ', '), ''), 'uncertain') AS labels FROM documents"),
    "exact_dup_keep_first": (exact_dup_keep_first, "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "labelled_docs_semi": (labelled_docs_semi, "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"),
    "missed_docs_anti": (missed_docs_anti, "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"),
    "run_compare_full_outer": (
        run_compare_full_outer,
        """WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right' WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    ),
    "field_agreement_pivot": (
        field_agreement_pivot,
        """WITH x AS (
          SELECT 'lang' AS field, CASE WHEN n_chars % 7 = 0 THEN 'unknown' ELSE lang END AS l, CASE WHEN n_chars % 5 = 0 THEN '' ELSE upper(lang) END AS r FROM documents
          UNION ALL SELECT 'source', source, CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END FROM documents),
        k AS (SELECT field, lower(trim(l)) AS l, lower(trim(r)) AS r, lower(trim(coalesce(l, ''))) NOT IN ('', 'unknown', 'none', 'null', 'n/a') AS lk, lower(trim(coalesce(r, ''))) NOT IN ('', 'unknown', 'none', 'null', 'n/a') AS rk FROM x)
        SELECT field, count(*) FILTER (lk AND rk AND l = r) AS agree, count(*) FILTER (lk AND rk AND l <> r) AS differ, count(*) FILTER (lk AND NOT rk) AS left_only,
          count(*) FILTER (rk AND NOT lk) AS right_only, count(*) FILTER (NOT lk AND NOT rk) AS both_missing FROM k GROUP BY field""",
    ),
    "yes_no_rate": (yes_no_rate, "SELECT lang, count(*) FILTER (quality = 1) AS yes, count(*) FILTER (quality = 0) AS no, round(count(*) FILTER (quality = 1) / count(*), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY lang"),
    "conversation_turn_budget": (
        conversation_turn_budget,
        """WITH r AS (SELECT conv_id, length(text) AS n, coalesce(sum(least(length(text), 80)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations)
        SELECT conv_id, count(*) AS turns, sum(least(n, 80, 200 - before))::BIGINT AS chars FROM r WHERE least(80, 200 - before) > 0 GROUP BY conv_id""",
    ),
    "cosine_topk": (cosine_topk, f"SELECT label, vec_id, {_COSINE.format(q=0)} AS score, (row_number() OVER (PARTITION BY label ORDER BY {_COSINE.format(q=0)} DESC, vec_id))::INT AS rank FROM embeddings WHERE vec_id <> 0 QUALIFY rank <= 5"),
    "cosine_best_per_label": (cosine_best_per_label, f"SELECT label, vec_id, {_COSINE.format(q=1)} AS score FROM embeddings WHERE vec_id <> 1 QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_COSINE.format(q=1)} DESC, vec_id) = 1"),
}

"""The pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F
from scoutflow.llm import decontaminate, toxicity
from tests.llm.test_operators import brute_components


def test_stages_take_effect(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    docs, kept = raw, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        kept[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == raw.columns
    ids = {name: ({r["doc_id"] for r in a.select("doc_id").collect()}, {r["doc_id"] for r in b.select("doc_id").collect()}) for name, (a, b) in kept.items()}
    scores = toxicity.score(raw, labels).filter("predicted = 0").collect()
    assert ids["toxicity"][1] == {r["doc_id"] for r in scores}
    before, after = kept["near_dedup"]
    want = brute_components({r["doc_id"]: r["text"] for r in before.collect()})
    assert ids["near_dedup"][1] == {i for i, (_, root) in want.items() if i == root}
    clean = decontaminate.scan(kept["decontamination"][0], bench).filter("size(hit_words) = 0").collect()
    assert ids["decontamination"][1] == {r["doc_id"] for r in clean}
    assert ids["mixing"][1] <= ids["mixing"][0] and kept["mixing"][1].count() == kept["sharding"][1].count()
    assert {"shard", "slot"} <= set(kept["sharding"][1].columns)


def test_no_task_holds_two_python_workers(spark, sf_dir, monkeypatch):
    """Executors keep every worker that a task of theirs has had, so each plan of the first two stages has one Python step between exchanges at most."""
    from pyspark.sql.pandas.conversion import PandasConversionMixin
    from scoutflow.llm import components, neardup

    def steps(node):
        """Python steps in this node's stage, and the most that a stage below has."""
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return steps(node.executedPlan())
        below = [steps(node.children().apply(i)) for i in range(node.children().size())]
        here, most = sum(x[0] for x in below), max((x[1] for x in below), default=0)
        if "Exchange" in name:
            return 0, max(most, here)
        return here + bool("Python" in name or "InPandas" in name or "InArrow" in name), most

    seen = []

    def noted(df):
        seen.append((max(steps(df._jdf.queryExecution().executedPlan())), df))
        return df

    to_pandas = PandasConversionMixin.toPandas
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda df: to_pandas(noted(df)))
    for module in (toxicity, neardup, components):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: f(noted(df), name))
    docs = noted(corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))
    noted(corpus_pipeline.drop_near_duplicates(spark, docs.cache(), sf_dir))
    assert len(seen) > 10 and max(n for n, _ in seen) == 1


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_stages_on_odd_documents(spark, sf_dir):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table and clashing columns: each stage's stated result."""
    long = "lorem ipsum " * 30_000
    toxic = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1"), "doc_id").select("text").collect()]
    bench = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(1).collect()]
    plain = "a plain text of more than five words"
    rows = [(1, plain, "en", "a", 1), (2, plain, "en", "a", 1), (2, plain, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, plain, "en", "b", 1), (5, long, "en", "b", 1), (6, bench[0], "en", "a", 1), (7, max(toxic, key=len), "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    wide = docs.withColumn("score", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("key", F.lit("y"))
    for frame in (docs, wide):
        ids = {name: sorted((r["doc_id"] for r in stages[name](spark, frame, sf_dir).collect()), key=str) for name in ("toxicity", "near_dedup", "decontamination")}
        assert set(ids["toxicity"]) >= {None, 1, 2, 3, 4, 5} and ids["toxicity"].count(2) == 2
        assert ids["near_dedup"] == sorted([None, 1, 3, 4, 5, 6, 7], key=str)
        assert 6 not in ids["decontamination"] and ids["decontamination"].count(2) == 2 and None in ids["decontamination"]
        assert all(stages[name](spark, frame, sf_dir).columns == corpus_pipeline.COLUMNS for name in ("toxicity", "near_dedup", "decontamination", "mixing"))
    shards = stages["sharding"](spark, docs, sf_dir).collect()
    assert len(shards) == len(rows) and sorted((r["doc_id"] for r in shards), key=str) == sorted((r[0] for r in rows), key=str)
    none = docs.limit(0)
    assert [stages[name](spark, none, sf_dir).count() for name, _ in corpus_pipeline.STAGES] == [0] * 5

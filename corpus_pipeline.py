"""From raw documents to training shards: five stages, each working on all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. Stages hand
over Parquet tables in the shared folder, so a lost executor never costs more than the stage that it was in. A stage reads
the columns of ``documents`` and no others, so further columns, whatever their names, are left behind; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoutflow.llm import decontaminate, mixing, neardup, sharding, toxicity
from scoutflow.llm.common import drop_table, fresh_path, load, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score as toxic; every other row stays as it is.

    Null, empty and wordless texts score 0 and stay; rows with equal texts share their fate, whatever their ids, null ones too.
    """
    return toxicity.reject_toxic(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least ``doc_id`` of each component of near duplicates.

    Texts without words are linked with nothing and stay, as do rows with a null id; a kept row that is repeated with its id and text stays as often.
    """
    return neardup.deduplicate(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold any window of a benchmark item; null and wordless texts hold none and stay, repeated rows each."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources, in shuffled order; copies are equal rows.

    A null source is a source; rows of equal id get equal counts, rows with a null id are drawn by their text.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes 16 shuffled shards and returns them with ``shard`` and ``slot``; every row once, null ids together in one shard."""
    return sharding.shard(docs.select(*COLUMNS), fresh_path(spark, "training-shards")).select(*COLUMNS, "shard", "slot")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]

# Learned scores and similarity components have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of ``documents`` after all stages. Each stage's table is deleted once the next one is written."""
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)

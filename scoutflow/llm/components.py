"""Connected components of an edge table, by contraction inside tasks and between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoutflow.llm.common import drop_table, written
from scoutflow.llm.fuzzyhash import mixed

# Edges that a task contracts at a time: what bounds its memory.
CHUNK = 1 << 19


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """Least member of each one's component in a small graph given as index pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def contraction(level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges to ``id, root``: each vertex of a chunk of edges with the first member of its component there, in an order by hash that the level decides."""

    def contract(edges: np.ndarray) -> pa.RecordBatch:
        ids, place = np.unique(edges, return_inverse=True)
        order = np.argsort(mixed(mixed(ids.view(np.uint64)) + np.uint64(level)))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        root = roots_of(len(ids), rank[place.reshape(-1, 2)])
        return pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ids[order][root])], ["id", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
            n += len(held[-1])
            if n >= CHUNK:
                yield contract(np.concatenate(held))
                held, n = [], 0
        if n:
            yield contract(np.concatenate(held))

    return run


def component_labels(edges: DataFrame) -> DataFrame:
    """``edges`` has longs ``a, b``; a written table ``id, component`` for each vertex, the component being one of its members.

    Each level contracts the edges of each task without a shuffle, then vertices meet the roots that they got in several tasks (at
    most one a chunk, so no key is hot); those roots are the edges of the next level. The order of roots is by hash, so a level leaves
    two thirds of a chain's vertices on average, whatever their numbers, and most chains far fewer. Then labels go back down the levels.
    """
    levels, now = [], edges.select("a", "b").filter("a <> b")
    while True:
        local = now.mapInArrow(contraction(len(levels)), "id long, root long")
        met = written(local.groupBy("id").agg(F.collect_set("root").alias("roots")), "roots")
        levels.append(met)
        several = met.filter("size(roots) > 1").select(F.array_min("roots").alias("b"), F.explode("roots").alias("a"))
        now = several.select("a", "b").filter("a <> b")
        if not now.head(1):
            break
    parents = [met.select("id", F.array_min("roots").alias("component")) for met in levels]
    labels = parents.pop()
    while parents:
        above = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        labels = parents.pop().join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    out = written(labels, "components")
    for met in levels:
        drop_table(met)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has longs ``a, b``; returns ``id, component`` for each vertex, the component being its least id."""
    labels = component_labels(edges)
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(least, "component").select("id", F.col("least").alias("component"))

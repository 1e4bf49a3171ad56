"""N-gram Jaccard join over count vectors, by R-trees.

A document is its set of distinct four-word shingles; its point counts them in hashed groups. Sets whose Jaccard
likeness reaches ``PERCENT`` differ in few shingles, so their points are near: the overlap is at most the sum of coordinate minima,
against a point as against the upper corner of an R-tree's box. The join finds every pair that passes this bound:

1. The directory. Two linked sets differ in at most ``6 m / 37`` shingles, ``m`` being the larger size. Groups are dealt into one block more
   than that, so the counts of at least one block agree in full. Each set is filed under the counts of each block; sets of one size band and the
   next one below share a division into blocks. Files with one set are dropped.
2. The trees. In a file each set meets one centre first. Where that leaves its sets in several components, those outside the largest one search
   R-trees over all of the file's points, in blocks.
3. The check. What the bound connects is checked on full sets, again with centres first. Only that links two documents.

Equal sets are one vertex throughout, so copies cost nothing after the first step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutflow.llm.common import drop_table, load, written
from scoutflow.llm.components import component_labels
from scoutflow.llm.fuzzyhash import mixed
from scoutflow.llm.neardup import ODD, _spanning, all_sets, links_of_few, pieces, verifier, versus

WORDS = 4
PERCENT = 85
# Shingles of a group on average, at most; least groups of a point.
PER_GROUP, LEAST_GROUPS = 8, 16
# Groups of a block in the directory, points of a tree's node, points of a tree, shingles of a block of texts.
BLOCK_GROUPS = np.uint64(64)
FAN, POINTS, SHINGLES = 16, 1024, 1 << 16
# Sets of a small file; rows of small files that one task call gets on average; pairs that are compared at once.
SMALL, ROWS, PAIRS = 32, 4096, 1 << 15
# Sets that a task remembers as filed.
REMEMBERED = 1 << 20


def size_bands() -> np.ndarray:
    """Least sizes of the bands, each about 100 / ``PERCENT`` times the one before. Sets of fewer than seven shingles link with equal sets only."""
    bands = [7]
    while bands[-1] < 1 << 40:
        bands.append(bands[-1] * 100 // PERCENT + 1)
    return np.array(bands)


BANDS = size_bands()
# Shingles in which two linked sets differ at most, the larger one being in the band; blocks are one more.
BLOCKS = 2 * (100 - PERCENT) * (BANDS[1:] - 1) // (100 + PERCENT) + 1


def passes(bound: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles that share ``bound`` of them would be linked."""
    return (100 + PERCENT) * bound >= PERCENT * (n + m)


def points_of(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each set's point: its shingles counted in hashed groups, a byte each.

    The groups are a power of two that grows with the set, so that counts stay near ``PER_GROUP`` (far from what a byte
    holds) and the bound keeps its strength; neighbouring groups add up to the groups of a point of half as many.
    """
    size = np.diff(bounds)
    bits = np.ceil(np.log2(np.maximum(size, 1) / PER_GROUP)).astype(np.int64).clip(LEAST_GROUPS.bit_length() - 1)
    first = np.concatenate([[0], np.cumsum(1 << bits)])
    owner = np.repeat(np.arange(len(size)), size)
    group = (mixed(h * ODD[2]) >> (64 - bits[owner]).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(first[owner] + group, minlength=first[-1]).clip(max=255).astype(np.uint8)
    return [counts[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]


def matrix(points: np.ndarray, groups: int) -> np.ndarray:
    """Points of equal length as rows of ``groups`` counts."""
    rows = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)
    return rows.reshape(len(points), groups, -1).sum(2, dtype=np.uint16)


def in_reach_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether paired points, of sets of ``n`` and ``m`` shingles, pass the bound."""
    good = np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT
    lengths = np.array([[len(x), len(y)] for x, y in zip(a, b)]).reshape(-1, 2)
    for la, lb in np.unique(lengths[good], axis=0):
        chosen = np.flatnonzero(good & (lengths == (la, lb)).all(1))
        step = max(1, PAIRS * 64 // max(la, lb))
        for i in range(0, len(chosen), step):
            part = chosen[i : i + step]
            groups = min(la, lb)
            overlap = np.minimum(matrix(a[part], groups), matrix(b[part], groups)).sum(1, dtype=np.int64)
            good[part] = passes(overlap, n[part], m[part])
    return good


def files_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set numbers and directory keys: of each block of each division that a set takes part in, a hash of the block's counts."""
    size = np.diff(bounds)
    low = np.maximum(np.searchsorted(BANDS, size, side="right") - 1, 0)
    high = np.searchsorted(BANDS, size * 100 // PERCENT, side="right") - 1
    owners, keys = [], []
    for step in range(int((high - low).max(initial=-1)) + 1):
        who = np.flatnonzero((size > 0) & (low + step <= high))
        band = low[who] + step
        blocks = BLOCKS[band]
        first = np.concatenate([[0], np.cumsum(blocks)])
        at = np.repeat(np.arange(len(who)), size[who])
        shingle = h[np.repeat(bounds[:-1][who] - np.concatenate([[0], np.cumsum(size[who])])[:-1], size[who]) + np.arange(len(at))]
        spread = mixed((shingle + band[at].astype(np.uint64)) * ODD[3])
        block = ((spread >> np.uint64(32)) * blocks[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = np.zeros(first[-1], np.uint64)  # the counts times the groups' random weights: equal where the counts are
        np.add.at(counts, first[at] + block, mixed((spread % BLOCK_GROUPS + np.uint64(1)) * ODD[4]))
        owner = np.repeat(np.arange(len(who)), blocks)
        place = (band[owner].astype(np.uint64) << np.uint64(40)) + (np.arange(first[-1]) - first[owner]).astype(np.uint64)
        owners.append(who[owner])
        keys.append(mixed(mixed(counts) + place * ODD[1]))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(keys).view(np.int64)


def set_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; zeros for an empty one."""
    some = np.diff(bounds) > 0
    total, mix = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
    if some.any():
        total[some] = np.add.reduceat(h, bounds[:-1][some])
        mix[some] = np.bitwise_xor.reduceat(h * ODD[1], bounds[:-1][some])
    return total.view(np.int64), mix.view(np.int64)


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch["text"]]
        for a, b in pieces(texts):
            h, bounds = all_sets(texts[a:b], WORDS)
            set_a, set_b = set_hashes(h, bounds)
            rows = batch.iloc[a:b]
            yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy(), "text_key": rows["text_key"].to_numpy(), "n": np.diff(bounds), "set_a": set_a, "set_b": set_b, "point": points_of(h, bounds)})


SKETCH = "doc_id long, text_key long, n long, set_a long, set_b long, point binary"


def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Directory keys of each set that the task has not filed already."""
    known: set[int] = set()
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        for a, b in pieces(texts):
            h, bounds = all_sets(texts[a:b], WORDS)
            set_a = set_hashes(h, bounds)[0]
            owner, key = files_of(h, bounds)
            fresh = np.zeros(b - a, bool)
            for i, s in enumerate(set_a.tolist()):
                fresh[i] = s not in known
                known.add(s)
            if len(known) > REMEMBERED:
                known.clear()
            keep = fresh[owner]
            if keep.any():
                yield pa.record_batch({"key": pa.array(key[keep]), "set_a": pa.array(set_a[owner[keep]])})


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, set_a`` in order, those of keys with several sets, each once. Keeps one row between batches."""
    key, held, shown = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        key, held = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False)]) for x, c in ((key, "key"), (held, "set_a")))
        if not len(key):
            continue
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (held[1:] != held[:-1])])
        key, held = key[new], held[new]
        same = key[1:] == key[:-1]
        group = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        before, shown = shown, bool(group[-1]) or (shown and len(key) == 1)
        if before:  # the first row went out with the last batch
            group[0] = False
        yield pa.record_batch({"key": pa.array(key[group]), "set_a": pa.array(held[group])})
        key, held = key[-1:], held[-1:]


class CountTree:
    """An R-tree over count vectors, packed by halving at the coordinate of the largest spread. A node keeps its box's upper corner and least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.arange(len(points))
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= FAN:
                continue
            part = points[self.order[a:b]]
            spread = np.ptp(part, axis=0)
            half = a + (b - a + 2 * FAN - 1) // (2 * FAN) * FAN  # nodes are full but for the last
            self.order[a:b] = self.order[a:b][np.argsort(part[:, spread.argmax()], kind="stable")]
            todo += [(a, half), (half, b)]
        self.levels = [(points[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > 1:
            corner, least = self.levels[-1]
            starts = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(least, starts)))

    def near(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the searched point, number of the tree's point) that pass the bound."""
        found_q, found_p = [], []
        todo = [(np.arange(len(points)), np.zeros(len(points), np.int64), len(self.levels) - 1)]
        while todo:
            q, node, level = todo.pop()
            if len(q) > PAIRS:
                todo += [(q[i : i + PAIRS], node[i : i + PAIRS], level) for i in range(0, len(q), PAIRS)]
                continue
            corner, least = self.levels[level]
            good = passes(np.minimum(points[q], corner[node]).sum(1), sizes[q], least[node])
            q, node = q[good], node[good]
            if not level:
                found_q.append(q)
                found_p.append(self.order[node])
            elif len(q):
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = child < len(self.levels[level - 1][1])
                todo.append((np.repeat(q, FAN)[there], child[there], level - 1))
        empty = [np.zeros(0, np.int64)]
        return np.concatenate(found_q or empty), np.concatenate(found_p or empty)


@F.pandas_udf(T.BooleanType())
def in_reach(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(in_reach_of(a.to_numpy(), b.to_numpy(), n.to_numpy(), m.to_numpy()))


def near_in_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Within one block of a large file, or in many small files: the few search the rest, and what they find of other components is linked.

    In a large file the rest is a tree.
    """
    rows = rows.sort_values("key", ignore_index=True)
    key, ids, component, few = (rows[c].to_numpy() for c in ("key", "id", "component", "few"))
    point, n = rows["point"].to_numpy(), rows["n"].to_numpy()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(start, [*start[1:], len(key)]):
        mine, rest = a + np.flatnonzero(few[a:b]), a + np.flatnonzero(~few[a:b])
        if len(mine) and len(rest) > SMALL:
            groups = min(map(len, point[a:b]))
            fold = lambda at: np.concatenate([matrix(point[i : i + 1], groups) for i in at])
            q, p = CountTree(fold(rest), n[rest]).near(fold(mine), n[mine])
            left.append(mine[q])
            right.append(rest[p])
        else:
            left.append(np.repeat(mine, len(rest)))
            right.append(np.tile(rest, len(mine)))
    i, j = np.concatenate(left), np.concatenate(right)
    other = component[i] != component[j]
    i, j = i[other], j[other]
    good = in_reach_of(point[i], point[j], n[i], n[j])
    return _spanning(ids, ids, np.column_stack([i[good], j[good]]))


def links_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    return links_of_few(rows, WORDS, PERCENT)


def in_components(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """``ids`` with the ``component`` of ``labels``; those that have none are their own."""
    return ids.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def reach(classes: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a, b`` (a file's centre and a member) that pass the bound, and ``id, component`` of what all passing pairs connect."""
    centres = files.groupBy("key").agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("a"), F.col("n").alias("na"))).alias("c")).select("key", "c.a", "c.na")
    pairs = files.join(centres, "key").filter("id <> a").filter(F.least("na", "n") * 100 >= F.greatest("na", "n") * PERCENT)
    pairs = pairs.select("a", "na", F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
    side = lambda x: classes.select(F.col("id").alias(x), F.col("point").alias(f"p{x}"))
    likely = written(pairs.join(side("b"), "b").join(side("a"), "a").filter(in_reach("pa", "pb", "na", "nb")).select("a", "b"), "likely")
    kin = component_labels(likely)
    placed = written(in_components(files, kin), "placed")
    who = F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("sets"), who)
    # The centre has met each member, so pairs are settled. Files repeat each other: of those with the same members one is enough.
    open_files = spread.filter("lo <> hi and sets > 2").groupBy("sets", "who").agg(F.min("key").alias("key")).select("key", "sets")
    opened = written(placed.join(open_files, "key"), "open-files")
    calls = max(1, opened.filter(F.col("sets") <= SMALL).count() // ROWS)
    dealt = versus(opened, "key", F.lit(1), POINTS).join(classes.select("id", "point"), "id")
    call = F.when(F.col("sets") <= SMALL, F.pmod(F.xxhash64("key"), F.lit(calls))).otherwise(F.col("key"))
    more = written(dealt.groupBy(call.alias("call"), "bi", "bj").applyInPandas(near_in_blocks, "a long, b long").distinct(), "reach")
    if more.head(1):
        drop_table(kin)
        kin = component_labels(likely.union(more))
    for table in (placed, opened, more):
        drop_table(table)
    return likely, kin


def labelled(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs`` (``doc_id, text``).

    Rows without words or with a null text have no shingles and are linked with nothing. Rows with a null id get a null component and are
    linked with nothing. Equal sets are one vertex, whatever their ids; rows that share an id but not a set are vertices of their own. Texts of any
    length are read whole, in slices. ``component_id`` is the least ``doc_id`` reachable over links. Other columns play no part.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    sketches = written(keyed.mapInPandas(sketch, SKETCH), "points")
    group = ["n", "set_a", "set_b"]
    grouped = sketches.filter("n > 0 and doc_id is not null").groupBy(*group).agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("point").alias("point"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("id"), *group, "of.doc_id", "of.text_key", "point"), "classes")
    keys = keyed.filter("doc_id is not null").select("text").mapInArrow(filed, "key long, set_a long")
    several = written(keys.repartition("key").sortWithinPartitions("key", "set_a").mapInArrow(shared, "key long, set_a long"), "shared")
    files = written(several.join(classes.select("set_a", "id", "n"), "set_a").select("key", "id", "n"), "files")
    drop_table(several)
    named = classes.select("id", *group, F.col("doc_id").alias("first"))
    used, labels = [files], None
    if files.head(1):
        likely, kin = reach(classes, files)
        wanted = classes.join(kin.select("id"), "id", "left_semi").select("id", "doc_id", "text_key")
        texts = written(keyed.join(wanted, ["doc_id", "text_key"]).select("id", "text").dropDuplicates(["id"]), "texts")
        side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t{x}"))
        met = likely.join(side("b"), "b").join(side("a"), "a")
        edges = written(met.filter(verifier(WORDS, PERCENT)("ta", "tb")).select("a", "b"), "links")
        known = component_labels(edges)
        sized = in_components(kin.withColumnRenamed("component", "kin"), known).join(classes.select("id", F.col("n").alias("size")), "id")
        dealt = versus(sized, "kin", F.col("size") + 8, SHINGLES).drop("size").join(texts, "id")
        more = written(dealt.groupBy("kin", "bi", "bj").applyInPandas(links_in_block, "a long, b long"), "more-links")
        labels = component_labels(edges.union(more)) if more.head(1) else known
        used += [likely, kin, texts, edges, more]
    if labels is not None:
        rooted = in_components(named, labels)
        least = rooted.groupBy("component").agg(F.min("first").alias("component_id"))
        named = written(rooted.join(least, "component").select(*group, "component_id"), "named")
    else:
        named = named.select(*group, F.col("first").alias("component_id"))
    for table in used:
        drop_table(table)
    found = sketches.select("doc_id", *group).join(named, group, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op13_countjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(load(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(s) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {PERCENT} * (x.n + y.n - shared)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY ALL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_countjoin": op13_countjoin}
ORACLES: dict[str, str] = {"op13_countjoin": SQL}

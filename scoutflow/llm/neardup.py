"""Near duplicates by HyperMinHash.

A document is its set of distinct five-word shingles. Its hashes are dealt into ``REGISTERS`` buckets; a
register keeps the bucket's least hash as a count of leading zeros and ``MANTISSA`` bits (empty buckets borrow
from others). Documents that agree on a band of ``ROWS`` registers are candidates. In a bucket of candidates each
is first compared with one centre; where that leaves members unconnected, those outside the bucket's largest component are compared with
all of it, in blocks. Collision-corrected estimates go before every comparison of full sets, and only that
comparison links two documents. Equal sets are one vertex throughout.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoutflow.llm.common import drop_table, load, written
from scoutflow.llm.components import component_labels, roots_of
from scoutflow.llm.fuzzyhash import POWERS, mixed

WORDS = 5
PERCENT = 75
REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
# Five standard deviations below the threshold, for registers that agree with chance PERCENT / 100.
CUT = PERCENT / 100 - 5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
# Rows of registers in a block, and shingles of texts.
BLOCK, SHINGLES = 256, 1 << 16
CHUNK = 1 << 18
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
DONORS = np.random.default_rng(7).integers(0, REGISTERS, (4096, REGISTERS))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted by text and hash, and where each text's begin (with the end).

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a text of fewer than ``words`` words is one shingle.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    raw = b" ".join(t.translate(LOWER) for t in texts)
    data = np.frombuffer(b" " + raw + b" ", np.uint8)
    space = SPACES[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:])
    POWERS.reach(len(data) + 1)
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)])
    word = mixed((sums[end] - sums[begin - 1]) * POWERS.down[begin] + (end - begin).astype(np.uint64))
    text_end = np.cumsum([len(t) + 1 for t in texts]) + 1
    owner = np.searchsorted(text_end, begin, side="right")
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n_words)])
    hashes, owners = [], []
    if len(word) >= words:
        run = np.zeros(len(word) - words + 1, np.uint64)
        for j in range(words):
            run += word[j : len(word) - words + 1 + j] * ODD[j]
        whole = owner[: len(run)] == owner[words - 1 :]
        hashes.append(mixed(run[whole]))
        owners.append(owner[: len(run)][whole])
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        total = n_words[short].astype(np.uint64) << np.uint64(32)
        for j in range(words - 1):
            there = n_words[short] > j
            total[there] += word[first[short[there]] + j] * ODD[j]
        hashes.append(mixed(total + np.uint64(1)))
        owners.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    h = mixed(h * ODD[0])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


WORD_END = re.compile(rb"[\x20\x09-\x0D]")
WORD = re.compile(rb"[^\x20\x09-\x0D]")


def slices(text: bytes, words: int = WORDS) -> Iterator[bytes]:
    """Parts of a long text, of about ``CHUNK`` bytes and cut between words, that hold each run of ``words`` words at least once."""
    last_words = re.compile(rb"(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}\Z" % (words - 1))
    start = 0
    while start < len(text):
        cut = WORD_END.search(text, start + CHUNK) if start + CHUNK < len(text) else None
        if cut is None or WORD.search(text, cut.end()) is None:
            yield text[start:]
            return
        back = max(start, cut.end() - (CHUNK >> 3))
        tail = last_words.search(text, back, cut.end())
        if tail is None or tail.start() == back:  # words too long for the look back: no cut here
            yield text[start:]
            return
        yield text[start : cut.end()]
        start = tail.start()


def long_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """The set of one long text, slice by slice, so that memory holds the set and one slice's arrays."""
    parts = list(slices(text, words))
    if len(parts) < 2:
        return shingle_sets([text], words)[0]
    return np.unique(np.concatenate([shingle_sets([p], words)[0] for p in parts]))


def all_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, long texts in slices."""
    if all(len(t) <= 2 * CHUNK for t in texts):
        return shingle_sets(texts, words)
    sets = [long_set(t, words) for t in texts]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def registers_of(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HyperMinHash registers, one row of 16-bit numbers for each set (zeros for an empty one)."""
    n = len(bounds) - 1
    out, full = np.zeros((n, REGISTERS), np.uint16), np.zeros((n, REGISTERS), bool)
    if len(h):
        owner = np.repeat(np.arange(n), np.diff(bounds))
        bucket = (h >> np.uint64(64 - 7)).astype(np.int64)
        least = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])])
        rest = (h[least] << np.uint64(7)) | np.uint64(1)
        zeros = np.clip(63 - np.floor(np.log2(rest.astype(np.float64))), 0, 62).astype(np.uint64)
        mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[owner[least], bucket[least]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
        full[owner[least], bucket[least]] = True
    rows, empty = np.nonzero(~full & full.any(1, keepdims=True))
    for t in range(len(DONORS)):  # each empty bucket borrows from the first full one in its own random order
        if not len(rows):
            break
        donor = DONORS[t, empty]
        got = full[rows, donor]
        out[rows[got], empty[got]] = out[rows[got], donor[got]]
        rows, empty = rows[~got], empty[~got]
    for r, e in zip(rows, empty):
        out[r, e] = out[r, np.flatnonzero(full[r])[0]]
    return out


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree between unrelated sets of ``n`` and ``m`` shingles."""
    edges = 0.5 ** np.arange(0, 64)
    def spread(k: np.ndarray) -> np.ndarray:
        per = np.maximum(k / REGISTERS, 1.0)[:, None]
        reach = -np.expm1(per * np.log1p(-np.minimum(edges, 1 - 1e-12)))  # P(least hash <= edge)
        return reach[:, :-1] - reach[:, 1:]
    return (spread(n) * spread(m)).sum(1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard likeness of paired register rows, without what chance agreement adds."""
    c = chance_agreement(n.astype(float), m.astype(float))
    return np.maximum(0.0, ((a == b).mean(1) - c) / (1 - c))


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [(t or "").encode() for t in batch["text"]]
        for a, b in pieces(texts):
            h, bounds = all_sets(texts[a:b])
            n = np.diff(bounds)
            regs = registers_of(h, bounds)
            some = n > 0
            total, mix = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if some.any():
                total[some] = np.add.reduceat(h, bounds[:-1][some])
                mix[some] = np.bitwise_xor.reduceat(h * ODD[1], bounds[:-1][some])
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].astype("Int64").to_numpy(), "text_key": batch["text_key"].iloc[a:b].to_numpy(), "n": n, "set_a": total.view(np.int64), "set_b": mix.view(np.int64), "regs": [r.tobytes() for r in regs]})


SKETCH = "doc_id long, text_key long, n long, set_a long, set_b long, regs binary"


def _matrix(regs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(regs), np.uint16).reshape(-1, REGISTERS)


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(regs: pd.Series) -> pd.Series:
    x = _matrix(regs).reshape(-1, BANDS, ROWS).astype(np.uint64)
    packed = x[:, :, 0] << np.uint64(48) | x[:, :, 1] << np.uint64(32) | x[:, :, 2] << np.uint64(16) | x[:, :, 3]
    return pd.Series(list(mixed(packed * ODD[2] + np.arange(BANDS, dtype=np.uint64) * ODD[3]).view(np.int64)))


@F.pandas_udf(T.DoubleType())
def estimated(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series(estimate(_matrix(a), _matrix(b), n.to_numpy(), m.to_numpy()) if len(a) else np.zeros(0))


def verifier(words: int, percent: int) -> Callable[..., Column]:
    """Whether two texts' full shingle sets are alike enough."""

    @F.pandas_udf(T.BooleanType())
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}
        out = []
        for x, y in zip(a, b):
            for t in (x, y):
                if t not in known:
                    if len(known) > 64:
                        known.clear()
                    known[t] = long_set(t.encode(), words)
            p, q = known.get(x), known.get(y)
            p = long_set(x.encode(), words) if p is None else p
            q = long_set(y.encode(), words) if q is None else q
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= percent * (len(p) + len(q) - both) and both > 0)
        return pd.Series(out, dtype=bool)

    return verified


verified = verifier(WORDS, PERCENT)


def near_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Within one block of a bucket: members that seem near one of another component, linked to one of their own kind."""
    few, rest = rows[rows["few"]].reset_index(drop=True), rows[~rows["few"]].reset_index(drop=True)
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(few) or not len(rest):
        return none
    regs, n, comp = _matrix(rest["regs"]), rest["n"].to_numpy(float), rest["component"].to_numpy()
    mine, m, kind = _matrix(few["regs"]), few["n"].to_numpy(float), few["component"].to_numpy()
    pairs = []
    for at in range(0, len(few), 64):
        part = slice(at, at + 64)
        agree = np.zeros((len(mine[part]), len(regs)), np.int16)
        for r in range(REGISTERS):
            agree += mine[part, r][:, None] == regs[None, :, r]
        size = np.minimum(m[part][:, None], n[None, :]) * 100 >= PERCENT * np.maximum(m[part][:, None], n[None, :])
        # The chance term is below 0.001, so the cut on bare agreement keeps all that the estimate keeps.
        i, j = np.nonzero((agree >= CUT * REGISTERS) & (kind[part][:, None] != comp[None, :]) & size)
        pairs.append(np.column_stack([i + at, j]))
    return _spanning(few["id"].to_numpy(), rest["id"].to_numpy(), np.concatenate(pairs))


def _spanning(left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> pd.DataFrame:
    """Edges ``a, b`` that connect what the index pairs of ``left`` and ``right`` connect."""
    ids, place = np.unique(np.concatenate([left[pairs[:, 0]], right[pairs[:, 1]]]), return_inverse=True)
    root = roots_of(len(ids), place.reshape(2, -1).T)
    return pd.DataFrame({"a": ids, "b": ids[root]})


def links_in_block(rows: pd.DataFrame) -> pd.DataFrame:
    return links_of_few(rows, WORDS, PERCENT)


def links_of_few(rows: pd.DataFrame, words: int, percent: int) -> pd.DataFrame:
    """Within one block of texts: full sets of the few against the rest, and a spanning set of the links found."""
    rows = rows.sort_values("few", ascending=False, ignore_index=True)
    ids, comp, n_few = rows["id"].to_numpy(), rows["component"].to_numpy(), int(rows["few"].sum())
    h, bounds = all_sets([(t or "").encode() for t in rows["text"]], words)
    size = np.diff(bounds).astype(float)
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
    kind = np.unique(h, return_inverse=True)[1]
    both = np.zeros((n_few, len(ids) - n_few), np.float32)
    order = np.argsort(kind, kind="stable")
    kind, owner = kind[order], owner[order]
    n_kinds = int(kind[-1]) + 1 if len(kind) else 0
    for at in range(0, n_kinds, 4096):
        a, b = np.searchsorted(kind, [at, at + 4096])
        held = np.zeros((len(ids), min(4096, n_kinds - at)), np.float32)
        held[owner[a:b], kind[a:b] - at] = 1
        both += held[:n_few] @ held[n_few:].T
    near = (both > 0) & (100 * both >= percent * (size[:n_few, None] + size[None, n_few:] - both)) & (comp[:n_few, None] != comp[None, n_few:])
    return _spanning(ids[:n_few], ids[n_few:], np.argwhere(near))


def versus(rows: DataFrame, key: str, weight: Column, block: int) -> DataFrame:
    """Deal the rows of each key (``id, component``) so that those outside its largest component meet every row of the key.

    Pairs within that component need no look, so only the others are repeated over all the key's blocks, as ``few``; the
    whole key is repeated once for each block of the few. A block holds rows of about ``block`` of ``weight``.
    """
    weighed = rows.withColumn("__w", weight)
    per = weighed.groupBy(key, "component").agg(F.sum("__w").alias("w"))
    whole = per.groupBy(key).agg(F.max(F.struct("w", "component")).alias("most"), F.sum("w").alias("all"))
    open_ = whole.filter(F.col("all") > F.col("most.w")).select(
        key,
        F.col("most.component").alias("__big"),
        F.ceil((F.col("all") - F.col("most.w")) / block).cast("int").alias("__nf"),
        F.ceil(F.col("all") / block).cast("int").alias("__na"),
    )
    placed = rows.join(open_, key).withColumn("__f", F.pmod(F.xxhash64("id"), "__nf").cast("int")).withColumn("__a", F.pmod(F.xxhash64("id", F.lit(1)), "__na").cast("int"))
    spot = lambda i, j, few: F.struct(i.cast("int").alias("bi"), j.cast("int").alias("bj"), F.lit(few).alias("few"))
    rest = F.transform(F.sequence(F.lit(0), F.col("__nf") - 1), lambda i: spot(i, F.col("__a"), False))
    few = F.transform(F.sequence(F.lit(0), F.col("__na") - 1), lambda j: spot(F.col("__f"), j, True))
    spots = F.when(F.col("component") == F.col("__big"), rest).otherwise(F.concat(rest, few))
    return placed.select(*rows.columns, F.explode(spots).alias("__s")).select(*rows.columns, "__s.bi", "__s.bj", "__s.few")


def label_components(docs: DataFrame) -> DataFrame:
    """The labels of ``labelled`` without its key."""
    return labelled(docs).drop("text_key")


def labelled(docs: DataFrame) -> DataFrame:
    """``text_key`` (a hash of the text) and ``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id, text``).

    Rows without words or with a null text have no shingles and are linked with nothing; rows with a null id
    are returned with null component and are linked with nothing. Equal sets are one vertex, whatever their ids; rows that
    share an id but not a set are vertices of their own. ``component_id`` is the least ``doc_id`` reachable over links.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    sketches = written(keyed.mapInPandas(sketch, SKETCH), "sketches")
    group = ["n", "set_a", "set_b"]
    usable = sketches.filter("n > 0 and doc_id is not null")
    # One row a set, numbered as it is written; its registers, and a row whose text stands for it.
    grouped = usable.groupBy(*group).agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("regs").alias("regs"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("id"), *group, "of.doc_id", "of.text_key", "regs"), "classes")
    banded = classes.select("id", F.explode(band_keys("regs")).alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(banded.join(buckets, "key").select("key", "id", "centre"), "buckets")
    labels, used = None, [members]
    if members.head(1):
        wanted = classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "text_key")
        # A set has one id and key here, so that repeated rows are dropped where the join has dealt them.
        texts = written(keyed.join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]).select("id", "text"), "texts")
        pairs = members.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        left, right = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
        sized = pairs.join(right, "b").join(left, "a").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
        # Written, so that no task holds two Python workers, which executors would keep, and the planner sees how few pairs meet texts.
        likely = written(sized.filter(estimated("ra", "rb", "na", "nb") >= CUT).select("a", "b"), "likely")
        with_b = likely.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        with_both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        edges = written(with_both.filter(verified("ta", "tb")).select("a", "b"), "links")
        labels = component_labels(edges)
        # Buckets whose members are not yet one component: what their centres did not settle.
        placed = members.select("key", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        placed = written(placed, "placed")
        spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
        # Bands repeat each other: of buckets with the same members one is enough.
        open_keys = spread.filter("lo <> hi").groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
        rows = versus(placed.join(open_keys, "key", "left_semi"), "key", F.lit(1), BLOCK).join(classes.select("id", "n", "regs"), "id")
        seem = written(rows.groupBy("key", "bi", "bj").applyInPandas(near_in_block, "a long, b long").distinct(), "seem")
        used += [texts, likely, edges, placed, seem]
        if seem.head(1):
            kin = component_labels(seem)
            sized = kin.withColumnRenamed("component", "kin").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")).join(classes.select("id", F.col("n").alias("size")), "id")
            dealt = versus(sized, "kin", F.col("size") + 8, SHINGLES).drop("size").join(texts, "id")
            more = written(dealt.groupBy("kin", "bi", "bj").applyInPandas(links_in_block, "a long, b long"), "more-links")
            used += [kin, more, labels]
            labels = component_labels(edges.union(more))
    named = classes.select("id", *group, F.col("doc_id").alias("first"))
    if labels is not None:
        rooted = named.join(labels, "id", "left").withColumn("root", F.coalesce("component", "id"))
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        named = written(rooted.join(least, "root").select(*group, "component_id"), "named")
        for table in used:
            drop_table(table)
    else:
        named = named.select(*group, F.col("first").alias("component_id"))
    # Written, so that the join with it can be split where one set is a third of all rows.
    found = sketches.select("doc_id", "text_key", *group).join(named, group, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the least id.

    Rows with a null id all stay, as do rows that repeat the id and the text of the one that stays; of rows that share an
    id but not a text each is judged by its own text. Other columns are kept as they are.
    """
    gone = labelled(docs).filter("not kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_anti")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_components(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_neardup": op5_neardup}
ORACLES: dict[str, str] = {}

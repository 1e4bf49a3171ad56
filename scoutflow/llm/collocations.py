"""Phrase collocations by generalised suffix automata.

Each shard (some megabytes of one language's pieces) becomes one suffix automaton over words, bounded to
``DEPTH`` of them: a state is a class of phrases that end at the same places, with the longest and the shortest length
of its members, the number of its end positions and a suffix link to the class of the next shorter suffix. Shards are
walked twice. The first walk sums the phrases' counts in a table of ``SLOTS`` hashed counters, which says of a slot
only whether its phrases reach ``LEAST`` together; the second one writes out the phrases whose slots do, so that Spark adds
up exact counts of few phrases beside the frequent ones. Parts, scores and subsumption are joins on the counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoutflow.llm.common import drop_table, load, written
from scoutflow.llm.fuzzyhash import mixed

DEPTH = 3
LEAST = 10
SHARE = 50
TOP = 2000
# Bytes of one shard, and of the texts that wait in a task for their shards.
CHUNK, WAITING = 1 << 22, 1 << 25
BITS = 21  # of a word's number in a shard: CHUNK bytes hold fewer different words
# Counters of the first walk, a byte each in a task; as bits, 16 MB for each worker whatever the input.
SLOTS, SECTION = 1 << 27, 1 << 16
SALTS = 64
NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
GAP = re.compile(rb"[ \n]")
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class SuffixAutomaton:
    """The suffix automaton of word sequences, bounded to ``DEPTH`` words.

    ``codes`` numbers the words of all sequences, with -1 between two of them; the first ``skip`` words are context only.
    States come from end positions sorted by the words before them: a run of equal last words is a node of the tree
    of suffix links, and nodes with the same end positions are one state. Per state: ``words`` (the longest member, right
    aligned), ``longest``, ``shortest``, ``endpos`` (how many end positions) and ``link`` (-1: the root).
    """

    def __init__(self, codes: np.ndarray, skip: int = 0) -> None:
        at = np.flatnonzero(codes >= 0)
        at = at[np.searchsorted(at, skip) :]
        key, before = (codes[at] + 1).astype(np.int64), np.ones(len(at), bool)
        for back in range(1, DEPTH):
            word = np.where(at >= back, codes[np.maximum(at - back, 0)], -1) + 1
            before &= word > 0
            key = key << BITS | np.where(before, word, 0)
        key = np.sort(key)
        # Nodes of each length, in key order: where they start in the sorted positions, and how many positions they have.
        starts, counts = [], []
        for length in range(1, DEPTH + 1):
            part = key >> (BITS * (DEPTH - length))
            there = part & ((1 << BITS) - 1) > 0
            new = there & np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]])
            starts.append(np.flatnonzero(new))
            counts.append(np.bincount((np.cumsum(new) - 1)[there], minlength=len(starts[-1])))
        self.words, self.longest, self.shortest, self.endpos, self.link = (np.zeros((0, DEPTH), np.int64), *(np.zeros(0, np.int64) for _ in range(4)))
        state = None  # of the nodes one word longer
        for length in range(DEPTH, 0, -1):
            start, count = starts[length - 1], counts[length - 1]
            own = np.full(len(start), -1)
            if length < DEPTH and len(starts[length]):
                child = np.minimum(np.searchsorted(starts[length], start), len(starts[length]) - 1)
                merged = (starts[length][child] == start) & (counts[length][child] == count)
                own[merged] = state[child[merged]]
                self.shortest[own[merged]] = length
            fresh = np.flatnonzero(own < 0)
            own[fresh] = len(self.endpos) + np.arange(len(fresh))
            if length < DEPTH and state is not None:
                parent = own[np.searchsorted(start, starts[length], side="right") - 1]
                apart = parent != state
                self.link[state[apart]] = parent[apart]
            first = key[start[fresh]]
            shown = np.column_stack([(first >> (BITS * (DEPTH - 1 - back))) & ((1 << BITS) - 1) if back < length else np.zeros(len(first), np.int64) for back in range(DEPTH - 1, -1, -1)])
            self.words = np.concatenate([self.words, shown - 1])
            self.longest = np.concatenate([self.longest, np.full(len(fresh), length)])
            self.shortest = np.concatenate([self.shortest, np.full(len(fresh), length)])
            self.endpos = np.concatenate([self.endpos, count[fresh]])
            self.link = np.concatenate([self.link, np.full(len(fresh), -1)])
            state = own

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (one row a phrase) and end positions of every different phrase of ``length`` words."""
        held = np.flatnonzero((self.shortest <= length) & (length <= self.longest))
        return self.words[held, DEPTH - length :], self.endpos[held]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, SuffixAutomaton, np.ndarray]]:
    """Language, automaton and words of each shard of a task's rows (``lang, text``).

    A text longer than a shard goes on in the next one, with the last words of its piece as context.
    """
    waiting: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def emptied(lang: str) -> Iterator[tuple[str, SuffixAutomaton, np.ndarray]]:
        blob = b"\n".join(waiting.pop(lang))
        size.pop(lang)
        start, context = 0, []
        while start < len(blob):
            cut = GAP.search(blob, start + CHUNK) if start + CHUNK < len(blob) else None
            end = cut.start() if cut else len(blob)
            part = blob[start:end]
            start = end
            tokens = np.array([*context, *part.replace(b"\n", b" \n ").split(b" ")], dtype=object)
            codes, vocabulary = pd.factorize(tokens)
            codes = codes.astype(np.int64)
            for odd, becomes in ((b"\n", -1), (b"", -2)):
                if len(known := np.flatnonzero(vocabulary == odd)):
                    codes[codes == known[0]] = becomes
            yield lang, SuffixAutomaton(codes[codes > -2], len(context)), vocabulary
            _, broken, tail = part.rpartition(b"\n")
            last = [w for w in tail.split(b" ") if w]
            context = (last if broken else [*context, *last])[1 - DEPTH :]

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            text = text.as_py()
            if not text:
                continue
            waiting.setdefault(lang, []).append(text.translate(NORMAL))
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                yield from emptied(lang)
            elif sum(size.values()) >= WAITING:
                yield from emptied(max(size, key=size.get))
    for lang in list(waiting):
        yield from emptied(lang)


def slots_of(lang: str, words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Counter of each phrase, from the hashes of its words."""
    total = np.full(len(words), words.shape[1] + xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    for j in range(words.shape[1]):
        total = mixed(total + hashes[words[:, j]] * ODD[j])
    return (total >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def word_hashes(vocabulary: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)


def count_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counters, up to ``LEAST`` each, in sections of those that are not zero."""
    held = np.zeros(SLOTS, np.uint8)
    for lang, automaton, vocabulary in shards(batches):
        hashes = word_hashes(vocabulary)
        for length in range(1, DEPTH + 1):
            words, n = automaton.phrases(length)
            slot = slots_of(lang, words, hashes)
            order = np.argsort(slot)
            slot, n = slot[order], n[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(slot)), bool), slot[1:] != slot[:-1]]))
            if len(first):
                slot, n = slot[first], np.minimum(np.add.reduceat(n, first), LEAST)
                held[slot] = np.minimum(held[slot] + n, LEAST)
    for section in range(SLOTS // SECTION):
        part = held[section * SECTION : (section + 1) * SECTION]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.record_batch({"section": pa.array([section], pa.int32()), "at": [at.astype(np.uint16).tobytes()], "n": [part[at].tobytes()]})


def merge_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each section of counters, a bit for every counter that reaches ``LEAST``. Holds one array a section, however many tasks counted."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            total = held.setdefault(row["section"], np.zeros(SECTION, np.uint8))
            at = np.frombuffer(row["at"], np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(row["n"], np.uint8), LEAST)
    for section, total in held.items():
        yield pa.record_batch({"section": pa.array([section], pa.int32()), "bits": [np.packbits(total >= LEAST).tobytes()]})


def frequent_slots(texts: DataFrame) -> Broadcast:
    """The counters that reach ``LEAST``, as ``SLOTS`` bits."""
    spark = texts.sparkSession
    counted = texts.mapInArrow(count_slots, "section int, at binary, n binary")
    bits = np.zeros(SLOTS // 8, np.uint8)
    for row in counted.repartition("section").mapInArrow(merge_slots, "section int, bits binary").toLocalIterator():
        width = SECTION // 8
        bits[row["section"] * width : (row["section"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return spark.sparkContext.broadcast(bits.tobytes())


def phrase_counts(docs: DataFrame) -> DataFrame:
    """``lang, k, phrase, f`` of ``docs`` (``lang, text``): the phrases of up to ``DEPTH`` words that occur ``LEAST`` times; with ``k`` 0, the language's words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    frequent = frequent_slots(texts)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(frequent.value, np.uint8)
        is_set = lambda slot: (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)
        for lang, automaton, vocabulary in shards(batches):
            hashes = word_hashes(vocabulary)
            names = pa.array(vocabulary, pa.binary())
            for length in range(1, DEPTH + 1):
                words, n = automaton.phrases(length)
                if length == 1:
                    yield pa.record_batch({"lang": [lang], "k": pa.array([0], pa.int32()), "phrase": [""], "f": pa.array([int(n.sum())], pa.int64())})
                keep = np.flatnonzero(is_set(slots_of(lang, words, hashes)))
                for part in (words[:, 1:], words[:, :-1]) if length > 1 else ():
                    keep = keep[is_set(slots_of(lang, part[keep], hashes))]
                if len(keep):
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(words[keep, j])) for j in range(length)), b" ").cast(pa.string())
                    yield pa.record_batch({"lang": pa.array([lang] * len(keep), pa.string()), "k": pa.array(np.full(len(keep), length, np.int32)), "phrase": phrase, "f": pa.array(n[keep].astype(np.int64))})

    rows = texts.mapInArrow(write, "lang string, k int, phrase string, f long")
    return rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("k") == 0) | (F.col("f") >= LEAST))


def scored(counts: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of the phrases of two and more words: their lowest-scoring cut."""
    known = counts.filter("k > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = counts.filter("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", cut)
    part = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("__left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("__right"))
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("__left", "l"), ("__right", "r")))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * cast(1000000 as decimal(7, 0))) div ({wide('l')} * {wide('r')})")
    least = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.join(left, ["lang", "__left"]).join(right, ["lang", "__right"]).groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """``lang, phrase, longer`` of the phrases inside longer ones: the largest count of a longer phrase that holds them.

    A phrase one word shorter is the suffix link's phrase of a longer one, or what that one goes on from; every phrase
    inside has at least the count of one of these, so that the chain from length to length misses none.
    """
    rows = counts.filter("k > 2")
    inside = [F.substring_index("phrase", " ", -(DEPTH - 1)), F.substring_index("phrase", " ", DEPTH - 1)]
    return rows.select("lang", F.explode(F.array(*inside)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def top_ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each ``lang`` with their ``rank``; a language is first cut in ``SALTS`` parts, so one task ranks ``SALTS * n`` rows at most."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for by in (["lang", "__salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= n)
    return salted.drop("__salt")


def collocations(docs: DataFrame) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``TOP`` phrases of two to ``DEPTH`` words, from ``docs`` (``lang, text``).

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they occur. Texts of any length
    are read whole, in shards. Ties in score and count are settled by the phrase, so the result is fixed. Other columns of ``docs``
    play no part; an empty table gives no rows.
    """
    counts = written(phrase_counts(docs), "phrase-counts")
    longer = subsumed(counts)
    kept = scored(counts).join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a"))).drop("longer")
    best = written(top_ranked(kept, [F.desc("score"), F.desc("a"), F.asc("phrase")], TOP), "phrase-ranks")
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    out = written(best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for table in (counts, best):
        drop_table(table)
    return out


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(list_concat(w,
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS phrase FROM w),
f AS (SELECT lang, phrase, len(string_split(phrase, ' ')) AS k, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a FROM f WHERE k > 1 AND f >= {LEAST}),
x AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT x.lang, x.phrase, x.a, x.cut, l.f AS l, r.f AS r, 1000000 * x.a * x.a // (l.f * r.f) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE k = 3) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM m LEFT JOIN o USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < {SHARE} * a
QUALIFY rank <= {TOP}
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_collocations": op11_collocations}
ORACLES: dict[str, str] = {"op11_collocations": SQL}

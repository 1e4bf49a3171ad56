"""Interaction of corpus filters, by a fingerprint-routed RDD.

Texts are routed by their xxhash to the partition that settles whether an equal text has a smaller id: there they
arrive sorted by fingerprint and id, and a fingerprint's collision chain holds its different full texts with the least id of
each. A task sends a text once, for the least id that it has seen, and settles the larger ids itself, so a text that a third of all
rows share does not gather in one partition. What a row fails is then a mask of five bits; ``combineByKey`` merges vectors of
mask counts per part, and every order of the filters is worked out from its part's vector.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import load, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
REPEATED = 1 << FILTERS.index("E")
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SIGNS = re.compile(rb"[#$%&*|]")
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
# Bytes of texts that a task remembers as its own, and of texts in a routed partition.
REMEMBERED, ROUTED = 1 << 25, 1 << 26

# One row (or several equal ones): id, part, mask, how many.
Masked = tuple[int | None, str, int, int]
# What is sent: fingerprint and id; the text (None: nothing left to settle) and the rows.
Sent = tuple[tuple[int, int], tuple[str | None, list[Masked]]]


def failures(text: str) -> int:
    """The filters A to D that ``text`` fails, as bits."""
    raw = text.encode()
    words = raw.split()  # of bytes: at 0x20 and 0x09 to 0x0D
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    fails = (len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITAL_PERCENT * len(text), SIGNS.search(raw) is not None)
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def sent(rows: Iterator[Row]) -> Iterator[Sent]:
    """A task's rows (id, text, part). Of the rows of one text those of the least id wait, counted by part, and go out with the text; the others repeat it.

    Where the texts that wait take ``REMEMBERED`` bytes, all are sent; a text that comes again is then sent again.
    """
    waiting: dict[str, tuple[int, int, Counter[str]]] = {}
    room, seen = REMEMBERED, itertools.count()

    def plain(*row) -> Sent:  # dealt by a running number
        return (xxhash.xxh64_intdigest(str(next(seen))), -1), (None, [row])

    def emptied() -> Iterator[Sent]:
        for text, (doc_id, mask, parts) in waiting.items():
            yield (xxhash.xxh64_intdigest(text.encode()), doc_id), (text, [(doc_id, part, mask, n) for part, n in parts.items()])
        waiting.clear()

    for doc_id, text, part in rows:
        text = text or ""
        if doc_id is None:
            yield plain(None, part, failures(text), 1)
        elif text not in waiting:
            waiting[text] = (doc_id, failures(text), Counter([part]))
            room -= len(text) + 200
            if room < 0:
                yield from emptied()
                room = REMEMBERED
        else:
            least, mask, parts = waiting[text]
            if doc_id > least:
                yield plain(doc_id, part, mask | REPEATED, 1)
            elif doc_id == least:
                parts[part] += 1
            else:
                for p, n in parts.items():
                    yield plain(least, p, mask | REPEATED, n)
                waiting[text] = (doc_id, mask, Counter([part]))
    yield from emptied()


def settled(rows: Iterator[Sent]) -> Iterator[Masked]:
    """Rows sorted by fingerprint and id: in the fingerprint's chain the first id of a text is its least one, and larger ids repeat it."""
    at, chain = None, {}
    for (fingerprint, doc_id), (text, members) in rows:
        if text is None:
            yield from members
            continue
        if fingerprint != at:
            at, chain = fingerprint, {}
        repeats = REPEATED if doc_id > chain.setdefault(text, doc_id) else 0
        for member, part, mask, n in members:
            yield member, part, mask | repeats, n


def masked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n`` for the rows of ``docs`` (``doc_id, text, lang``): bit i of ``mask`` is set where the row fails filter i; ``n`` equal rows are one.

    A null text is an empty one, a null language the part ``""``. Rows with a null id repeat nothing and are repeated by nothing;
    of rows that share the least id of a text none repeats it. Other columns play no part.
    """
    spark = docs.sparkSession
    # Nothing sizes an RDD's partitions at run time, so they are sized by the texts.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(size // ROUTED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("lang", F.lit(""))).rdd.mapPartitions(sent)
    routed = rows.repartitionAndSortWithinPartitions(partitions, partitionFunc=lambda key: key[0])
    return spark.createDataFrame(routed.mapPartitions(settled), "doc_id long, part string, mask int, n long", verifySchema=False)


def repeated_ids(docs: DataFrame) -> DataFrame:
    """``doc_id`` of the rows of ``docs`` whose text a smaller id has too."""
    return masked(docs).filter(F.col("mask").bitwiseAND(REPEATED) > 0).select("doc_id").distinct()


def add_row(vector: np.ndarray, row: tuple[int, int, bool, bool]) -> np.ndarray:
    mask, n, good, toxic = row
    vector[mask] += (n, n * good, n * toxic)
    return vector


def steps_table() -> tuple[list[tuple[str, int]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each order's steps, and which masks are kept after one, removed by it, or fail its filter after their removal; the filter's number."""
    masks = np.arange(MASKS)
    names, kept, removed, redundant, number = [], [], [], [], []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            gone, fails = masks & before > 0, masks & bit > 0
            names.append((order, step))
            kept.append(~gone & ~fails)
            removed.append(~gone & fails)
            redundant.append(gone & fails)
            number.append(FILTERS.index(letter))
            before |= bit
    return names, np.array(kept), np.array(removed), np.array(redundant), np.array(number)


def report(rows: Iterator[tuple[str, np.ndarray]]) -> Iterator[tuple]:
    names, kept, removed, redundant, number = steps_table()
    for part, vector in rows:
        counts = vector[:, 0]
        lost = removed @ vector
        shapley = np.bincount(number, lost[:, 0], len(FILTERS)).astype(np.int64)
        values = np.column_stack([kept @ counts, lost[:, 0], redundant @ counts, counts[1 << number], lost[:, 1], lost[:, 2], shapley[number]])
        for (order, step), row in zip(names, values.tolist()):
            yield (part, order, step, *row)


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what that filter keeps, removes and would remove, and what is lost by it.

    ``labels`` (``doc_id, quality, toxic``) may cover some rows and name one several times: a document is good or toxic if any of its labels says so.
    An empty table has no parts and gives no rows. See ``masked`` for nulls and repeats.
    """
    rows = written(masked(docs), "audit-masks")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False))
    labelled = rows.join(marks, "doc_id", "left").select("part", "mask", "n", flag("quality"), flag("toxic"))
    pairs = labelled.rdd.map(lambda r: (r[0], tuple(r[1:])))
    vectors = pairs.combineByKey(lambda row: add_row(np.zeros((MASKS, 3), np.int64), row), add_row, lambda a, b: a + b)
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return docs.sparkSession.createDataFrame(vectors.mapPartitions(report), schema, verifySchema=False)


def op12_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


SQL = f"""
WITH least AS (SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY ALL),
marks AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY ALL),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {{'A': len(w) < {MIN_WORDS}, 'B': 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w),
          'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)}} AS fails
      FROM d LEFT JOIN least USING (text) LEFT JOIN marks USING (doc_id)),
m AS (SELECT part, fails.A::INT + 2 * fails.B::INT + 4 * fails.C::INT + 8 * fails.D::INT + 16 * fails.E::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e
      WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step]::INT AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_filteraudit": op12_filteraudit}
ORACLES: dict[str, str] = {"op12_filteraudit": SQL}

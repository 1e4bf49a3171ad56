"""Language identification by prediction by partial matching.

Each language has a context tree of orders 0 to ``ORDER`` over the bytes of lower-cased UTF-8 text, with
frozen counts and escape method C: a symbol seen c times in a context with n symbols of d kinds costs
``-log2(c / (n + d))``, an unseen one the escape ``-log2(d / (n + d))`` and what the next shorter context asks.
The language with the shortest code for the whole text wins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import load, unit_hash

ORDER = 4
# Bound of the fit: about so many documents a language, drawn by a hash of their id, whole texts.
TRAIN_DOCS = 250
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 19
TAG = np.uint64(40)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def padded(text: str | None) -> bytes:
    return b" " * ORDER + (text or "").lower().encode("utf-8", "replace")


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """For each byte, the last ``size`` bytes up to it as a number with its size in the high bits."""
    code = np.zeros(len(data), np.uint64)
    for j in range(size):
        code[j:] |= data[: len(data) - j].astype(np.uint64) << np.uint64(8 * j)
    return code | (np.uint64(size) << TAG)


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            data = [np.frombuffer(padded(t), np.uint8) for t in texts]
            joined = np.concatenate(data)
            real = np.concatenate([np.arange(len(d)) >= ORDER for d in data])
            for size in range(1, ORDER + 2):
                code, n = np.unique(grams(joined, size)[real], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": code.astype(np.int64), "n": n.astype(np.int64)})


def parents(keys: np.ndarray) -> np.ndarray:
    """The context of each gram: all but its last byte."""
    size = keys >> TAG
    low = keys & np.uint64((1 << 40) - 1)
    return np.where(size > 0, (low >> np.uint64(8)) | (np.maximum(size, np.uint64(1)) - np.uint64(1)) << TAG, np.uint64(0))


def closed(grams: np.ndarray) -> np.ndarray:
    """The grams with all their contexts and endings, sorted: what stands only at a text's start was not counted itself."""
    keys = np.unique(np.append(grams.astype(np.uint64), np.uint64(0)))
    while True:
        size = np.maximum(keys >> TAG, np.uint64(1)) - np.uint64(1)
        endings = (keys & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1))) | size << TAG
        more = np.unique(np.concatenate([keys, parents(keys), endings]))
        if len(more) == len(keys):
            return keys.astype(np.int64)
        keys = more


class Trees:
    """All languages' trees as one hash table from a gram to its cost and its escape cost by language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        if not self.langs:
            return
        wide = counts.pivot_table(index="gram", columns="lang", values="n", aggfunc="sum", fill_value=0)[self.langs]
        wide = wide.reindex(closed(wide.index.to_numpy()), fill_value=0)
        keys, n = wide.index.to_numpy().astype(np.uint64), wide.to_numpy(np.float64)
        self.keys = keys
        size = (keys >> TAG).astype(int)
        low = keys & np.uint64((1 << 40) - 1)
        above = np.searchsorted(keys, parents(keys))
        use = size > 0
        total, kinds = np.zeros_like(n), np.zeros_like(n)
        np.add.at(total, above[use], n[use])
        np.add.at(kinds, above[use], n[use] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
        cost = np.full_like(n, 8.0)
        for k in range(1, ORDER + 2):
            rows = np.flatnonzero(size == k)
            if k > 1:
                mask = np.uint64((1 << (8 * (k - 1))) - 1)
                shorter = cost[np.searchsorted(keys, (low[rows] & mask) | (np.uint64(k - 1) << TAG))]
            else:
                shorter = np.full((len(rows), n.shape[1]), 8.0)
            up = above[rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = -np.log2(n[rows] / (total[up] + kinds[up]))
            cost[rows] = np.where(n[rows] > 0, seen, shorter + escape[up])
        self.cost, self.escape = cost.astype(np.float32), escape.astype(np.float32)
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            placed = self.slots[at] == todo
            todo, at = todo[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        at = self._home(keys)
        out = self.slots[at].copy()
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.slots[at]
            out[open_] = got
            going = (got >= 0) & (self.keys[got] != keys[open_])
            open_, at = open_[going], at[going]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each padded text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        data = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
        left = np.arange(len(data))[np.arange(len(data)) - starts[owner] >= ORDER]
        codes = [grams(data, size) for size in range(ORDER + 2)]
        acc = np.zeros((len(data), len(self.langs)), np.float32)
        for k in range(ORDER, -1, -1):
            row = self.find(codes[k + 1][left])
            hit = row >= 0
            acc[left[hit]] += self.cost[row[hit]]
            left = left[~hit]
            context = self.find(codes[k][left - 1])
            hit = context >= 0
            acc[left[hit]] += self.escape[context[hit]]
        acc[left] += 8.0
        for lang in range(len(self.langs)):
            out[:, lang] = np.bincount(owner, acc[:, lang], len(texts))
        return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, seed: str = "lang-1") -> Trees:
    """Learn the trees from about ``train_docs`` documents of each non-null ``lang`` outside the held-out fifth."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, train_docs / n)).otherwise(share)
    sample = known.filter(unit_hash(seed, F.col("doc_id"), F.length("text")) < share).select("lang", "text")
    counts = sample.mapInPandas(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Trees(counts.toPandas())


def slices(text: bytes) -> Iterator[bytes]:
    """Parts of a padded text of about ``CHUNK`` bytes, each with the ``ORDER`` bytes before it: their code lengths add up to the text's."""
    for start in range(ORDER, max(len(text), ORDER + 1), CHUNK):
        yield text[start - ORDER : start + CHUNK]


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def predictor(spark: SparkSession, trees: Trees) -> Callable[[Column | str], Column]:
    """A column function: text to ``struct<lang_pred, score, bits>`` (``und`` without a letter)."""
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<lang_pred:string,score:double,bits:double>")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for series in batches:
            texts = series.tolist()
            data = [padded(t) for t in texts]
            bits = np.zeros((len(data), max(1, len(trees.langs))))
            if trees.langs:
                parts = [(i, p) for i, d in enumerate(data) for p in slices(d)]
                for a, b in pieces([p for _, p in parts]):
                    np.add.at(bits, [i for i, _ in parts[a:b]], trees.code_lengths([p for _, p in parts[a:b]]))
            best = bits.argmin(1)
            gap = (bits - bits.min(1, keepdims=True)) / np.sqrt([[max(1, len(d) - ORDER)] for d in data] or np.ones((0, 1)))
            score = 1 / np.exp2(-gap).sum(1)
            known = [bool(trees.langs) and t is not None and LETTER.search(t) is not None for t in texts]
            yield pd.DataFrame(
                {
                    "lang_pred": [trees.langs[i] if k else "und" for i, k in zip(best, known)],
                    "score": np.where(known, score, 0.0),
                    "bits": bits[np.arange(len(data)), best] if len(data) else np.zeros(0),
                }
            )

    return language


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits`` for each row, repeated rows included.

    Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing was learned. Texts of any length are
    scored whole, in slices: memory holds the text and one slice's arrays.
    """
    language = predictor(docs.sparkSession, fit(docs, train_docs))
    rows = docs.select("doc_id", language("text").alias("p"))
    return rows.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score", "p.bits")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_langid": op7_langid}
ORACLES: dict[str, str] = {}

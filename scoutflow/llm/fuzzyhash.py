"""Context-triggered piecewise hashing.

A hash of the last seven bytes ends a chunk wherever its low bits are all ones; each chunk gives one of 64
letters. The number of bits is the least that leaves under 64 chunk ends, so a text's block size follows
from its content. A fingerprint is ``level:letters`` and the letters of the next two levels. Fingerprints
compare at the block sizes they share (up to two doublings apart) by edit distance with insertions and deletions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import load

WINDOW = 7
LETTERS = 64
RUN = 4
SIZES = 3
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
CHUNK = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of STEP and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(n - 1, STEP, np.uint64)]))
            self.down = np.cumprod(np.concatenate([one, np.full(n - 1, BACK, np.uint64)]))


POWERS = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprints_of(texts: list[bytes]) -> list[str]:
    """Fingerprints of a list of byte strings that fits in memory."""
    if not texts:
        return []
    sizes = np.array([len(t) for t in texts])
    pad = bytes(WINDOW)
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    n = len(data)
    owner = np.repeat(np.arange(len(texts)), sizes + WINDOW)
    starts = np.concatenate([[0], np.cumsum(sizes + WINDOW)[:-1]]) + WINDOW
    real = np.arange(n) >= starts[owner]
    rolling = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolling[j:] += (data[: n - j] + np.uint64(1)) * np.uint64(pow(31, j) + 2 * j)
    rolling = mixed(rolling * STEP)
    low = (~rolling) & np.uint64(0xFFFFFFFF) | np.uint64(1 << 32)
    level = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)  # trailing ones, 0 to 32
    level[~real] = -1
    table = np.bincount(owner[real] * 34 + level[real], minlength=len(texts) * 34).reshape(-1, 34)
    at_least = table[:, ::-1].cumsum(1)[:, ::-1]
    chosen = (at_least >= LETTERS).sum(1)  # the least level with fewer ends
    POWERS.reach(n + 1)
    sums = np.cumsum((data + np.uint64(1)) * POWERS.up[:n])
    out = []
    for extra in range(SIZES):
        end = real & (level >= (chosen + extra)[owner])
        last = starts + sizes - 1
        end[last[sizes > 0]] = True
        ends = np.flatnonzero(end)
        mine = owner[ends]
        first = np.concatenate([[True], mine[1:] != mine[:-1]]) if len(ends) else np.zeros(0, bool)
        begin = np.where(first, starts[mine], np.concatenate([[0], ends[:-1] + 1])[: len(ends)])
        # starts are at least WINDOW, so begin - 1 is always a place
        chunk = (sums[ends] - sums[begin - 1]) * POWERS.down[begin]
        letter = ALPHABET[(mixed(chunk ^ rolling[ends]) >> np.uint64(58)).astype(np.int64)].tobytes()
        cuts = np.searchsorted(mine, np.arange(len(texts) + 1))
        out.append([letter[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:])])
    return [":".join((str(k), *parts)) for k, *parts in zip(chosen, *out)]


def levels_of(text: bytes, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice of a text: each byte, its rolling hash over the bytes before it, and how many low ones that ends in."""
    part = text[max(0, start - WINDOW) : start + CHUNK]
    data = np.frombuffer(bytes(WINDOW - min(start, WINDOW)) + part, np.uint8).astype(np.uint64)
    n = len(data)
    rolling = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolling[j:] += (data[: n - j] + np.uint64(1)) * np.uint64(pow(31, j) + 2 * j)
    rolling = mixed(rolling * STEP)
    low = (~rolling) & np.uint64(0xFFFFFFFF) | np.uint64(1 << 32)
    level = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)
    return data[WINDOW:], rolling[WINDOW:], level[WINDOW:]


def long_fingerprint(text: bytes) -> str:
    """The fingerprint of one long text, by slices: memory holds one slice's arrays. The first pass finds the level, the second the chunks."""
    counts = np.zeros(34, np.int64)
    for start in range(0, len(text), CHUNK):
        counts += np.bincount(levels_of(text, start)[2], minlength=34)
    chosen = int((counts[::-1].cumsum()[::-1] >= LETTERS).sum())
    POWERS.reach(CHUNK + 1)
    total, ends = 0, []  # ends: place, level, hash of the last bytes, sum of all before and here
    for start in range(0, len(text), CHUNK):
        data, rolling, level = levels_of(text, start)
        sums = np.cumsum((data + np.uint64(1)) * POWERS.up[: len(data)])
        scale = pow(int(STEP), start, 1 << 64)
        if start + CHUNK >= len(text):
            level[-1] = 64  # the text's end ends its last chunk
        for i in np.flatnonzero(level >= chosen):
            ends.append((start + int(i), int(level[i]), int(rolling[i]), (total + scale * int(sums[i])) % (1 << 64)))
        total = (total + scale * int(sums[-1])) % (1 << 64)
    parts = []
    for extra in range(SIZES):
        before, begin, letters = 0, 0, []
        for place, level, rolled, upto in ends:
            if level >= chosen + extra:
                chunk = (upto - before) * pow(int(BACK), begin, 1 << 64) % (1 << 64)
                letters.append(int(mixed(np.array([chunk ^ rolled], np.uint64))[0]) >> 58)
                before, begin = upto, place + 1
        parts.append(ALPHABET[letters].tobytes().decode())
    return ":".join((str(chosen), *parts))


def fingerprints(texts: list[bytes]) -> list[str]:
    """As ``fingerprints_of``, a piece of about ``CHUNK`` bytes at a time; longer texts in slices."""
    out: list[str] = []
    start = size = 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            out += [*fingerprints_of(texts[start:i]), long_fingerprint(t)]
            start, size = i + 1, 0
            continue
        if size and size + len(t) > CHUNK:
            out += fingerprints_of(texts[start:i])
            start, size = i, 0
        size += len(t)
    return out + fingerprints_of(texts[start:])


def codes(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers, filled up to 64 a row, and the lengths."""
    lens = np.array([len(s) for s in signatures])
    joined = np.frombuffer("".join(s.ljust(LETTERS, "\x00") for s in signatures).encode(), np.uint8)
    return joined.reshape(-1, LETTERS), lens


def alike(left: list[str], right: list[str]) -> np.ndarray:
    """2 * LCS / (sum of lengths) of each pair of signatures, 0 where they share no run of ``RUN`` letters."""
    out = np.zeros(len(left))
    for at in range(0, len(left), 512):
        (a, m), (b, n) = codes(left[at : at + 512]), codes(right[at : at + 512])
        rows = np.arange(len(m))
        mask = np.zeros((len(m), 128), np.uint64)
        for i in range(LETTERS):
            mask[rows, a[:, i]] |= np.uint64(1 << i)
        mask[:, 0] = 0
        v = np.full(len(m), ~np.uint64(0))
        for j in range(LETTERS):  # the longest common subsequence, 64 cells a step
            hit = v & mask[rows, b[:, j]]
            v = (v + hit) | (v - hit)
        common = LETTERS - np.array([int(x).bit_count() for x in v])
        score = np.where(m + n > 0, 2 * common / np.maximum(m + n, 1), 1.0)
        runs = []
        for x in (a, b):
            x = x.astype(np.uint32)
            runs.append(x[:, :-3] | (x[:, 1:-2] << 7) | (x[:, 2:-1] << 14) | (x[:, 3:] << 21))
        full = [np.arange(LETTERS - RUN + 1) <= (k[:, None] - RUN) for k in (m, n)]
        runs[0] = np.where(full[0], runs[0], np.uint32(0xFFFFFFFF))
        runs[1] = np.where(full[1], runs[1], np.uint32(0xFFFFFFFE))
        shared = (runs[0][:, :, None] == runs[1][:, None, :]).any((1, 2))
        out[at : at + 512] = np.where(shared | (np.minimum(m, n) < RUN), score, 0.0)
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness 0..1 of each pair of fingerprints: the best over shared block sizes, 0 where there are none."""
    a, b = [x.split(":") for x in left], [x.split(":") for x in right]
    gap = np.array([int(x[0]) - int(y[0]) for x, y in zip(a, b)], dtype=int)
    best = np.zeros(len(gap))
    for i in range(SIZES):
        other = gap + i
        # Empty letters tell something only where they are the whole text's, at the first level.
        rows = [n for n, j in enumerate(other) if 0 <= j < SIZES and (i == j == 0 or (a[n][1 + i] and b[n][1 + j]))]
        if rows:
            best[rows] = np.maximum(best[rows], alike([a[n][1 + i] for n in rows], [b[n][1 + other[n]] for n in rows]))
    return best


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pair_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block; each is compared with the row after it. Only one row is kept between batches."""
    held: list[tuple] = []
    for batch in batches:
        rows = held + list(zip(batch["block"], batch["over"], batch["doc_id"], batch["text"]))
        held = rows[-1:]
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        for at in range(0, len(pairs), 500):
            part = pairs[at : at + 500]
            used = range(part[0][0], part[-1][1] + 1)
            texts = {i: rows[i][3] or "" for i in used}
            prints = dict(zip(used, fingerprints([texts[i].encode() for i in used])))
            edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2] for i, j in part]
            data = [t.encode() for t in edited]
            of_edited = fingerprints(data)
            mine = [prints[i] for i, _ in part]
            yield pd.DataFrame(
                {
                    "doc_id": pd.array([None if pd.isna(rows[i][2]) else int(rows[i][2]) for i, _ in part], dtype="Int64"),
                    "n_chars": [len(texts[i]) for i, _ in part],
                    "edited_sha256": [hashlib.sha256(t).hexdigest() for t in data],
                    "fingerprint": mine,
                    "edited_fingerprint": of_edited,
                    "near_edited": likeness(mine, of_edited),
                    "near_next": likeness(mine, [prints[j] for _, j in part]),
                }
            )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document.

    The next document is the one with the next smaller ``doc_id`` (equal ids by text, nulls last); after the
    last comes the first. Null texts count as empty. Rows are dealt out in blocks of neighbouring ids; the cuts
    between blocks are ids themselves, whose rows go to both sides, so each text is shuffled about once. The
    driver holds one cut for each block and nothing else.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order.alias("rank"), "text")
    n_blocks = 8 * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n_blocks for i in range(1, n_blocks + 1)]
    found = rows.agg(F.percentile_approx("rank", shares, max(10_000, 10 * n_blocks)).alias("cuts"), F.max("rank").alias("top")).first()
    cuts = spark.sparkContext.broadcast(np.unique(np.array([*(found["cuts"] or []), found["top"] if found["top"] is not None else 0], np.int64)))

    @F.pandas_udf("struct<block:int,also:int>")
    def placed(ranks: pd.Series) -> pd.DataFrame:
        edges = cuts.value
        block = np.searchsorted(edges, ranks.to_numpy(np.int64))
        block = np.minimum(block, len(edges) - 1)
        return pd.DataFrame({"block": block, "also": np.where(edges[block] == ranks, (block + 1) % len(edges), -1)})

    spots = rows.withColumn("p", placed("rank"))
    both = F.array(F.struct(F.col("p.block").alias("block"), F.lit(0).alias("over")), F.struct(F.col("p.also").alias("block"), F.lit(1).alias("over")))
    dealt = spots.select("doc_id", "rank", "text", F.explode(F.filter(both, lambda s: s["block"] >= 0)).alias("s")).select("s.block", "s.over", "doc_id", "rank", "text")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "over", F.desc("rank"), "text").select("block", "over", "doc_id", "text")
    return ordered.mapInPandas(pair_up, FIELDS)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_fingerprints": op2_fingerprints}
ORACLES: dict[str, str] = {}

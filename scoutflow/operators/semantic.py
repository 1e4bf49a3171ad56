"""Chunks of text, which of them are useful, and their likeness to a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutflow.functions import text as tx
from scoutflow.operators.topk import top_per_group

CHUNK, OVERLAP, TOP, LEAST, PAGES, PER_SOURCE = 1800, 250, 2, 0.30, 150, 8
# What a useful chunk speaks of, and what only fills pages.
CORE_HINTS = (
    r"(?i)\b(application deadline|deadline|apply|applications? (?:are|is|open|closed|close|accepted|deadline|portal|form)|registration|register|fee|fees|cost|tuition|"
    r"funding|funded|scholarship|grant|bursary|eligibility|eligible|participants?|important dates|programme dates)\b"
)
TYPE_HINTS = r"(?i)\b(summer school|winter school|training school|short course|doctoral school|field school)\b"
FILLER = [
    "skip to main content", "privacy policy", "data protection", "cookie", "cookies", "newsletter", "subscribe", "follow us", "external links", "contact us",
    "members area", "login", "menu home", "home about", "site map",
]
LOW_PAGE = (
    r"(?i)\b(login|membership|admissions?|academic calendar|scholarships? - an overview|all events|events archive|previous editions|newsletter|privacy|site map|"
    r"training overview|browse our list of trainings|course catalogue)\b"
)
LOW_TITLE = r"(?i)\b(archive|previous editions?|all events|funding database|contact|login|scholarships? - an overview|no summer schools scheduled)\b"
LOW_URL = r"(?i)(?:/archive|archive-|previous-editions|funding-database|/contact/?$)"


def chunks(df: DataFrame, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of the text: the row's other columns, ``chunk_index`` (0-based) and ``chunk``."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(tx.windows(F.col(text), size, overlap)).alias("chunk_index", "chunk"))


def useful_chunk(chunk: Column, title: Column | None = None, url: Column | None = None, need_type: bool = True, core: str = CORE_HINTS, kinds: str = TYPE_HINTS, filler: list[str] | None = None) -> Column:
    title, url = title if title is not None else F.lit(""), url if url is not None else F.lit("")
    clean = tx.clean_space(chunk)
    whole = tx.clean_space(F.concat_ws(" ", title, clean))
    core_hits, type_hits = F.regexp_count(clean, F.lit(core)), F.regexp_count(whole, F.lit(kinds))
    filled = tx.count_terms(clean, FILLER if filler is None else filler)
    skips = F.contains(F.lower(clean), F.lit("skip to main content"))
    enough = (core_hits > 0) & ((type_hits > 0) if need_type else F.lit(True))
    return enough & ~title.rlike(LOW_TITLE) & ~url.rlike(LOW_URL) & ~(skips & (core_hits == 0)) & ~((filled >= 3) & (core_hits < 2)) & ~(whole.rlike(LOW_PAGE) & (core_hits < 2))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where either has no length."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda x: F.sqrt(F.aggregate(d(x), F.lit(0.0), lambda s, v: s + v * v))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def embedder(model: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function from an injected model: ``model()`` loads it once for each worker's stream of batches."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return embed


def hashing_model(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A stand-in without weights: word hashes in ``dims`` buckets."""

    def load() -> Callable[[list[str]], np.ndarray]:
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    out[i, zlib.crc32(w.encode()) % dims] += 1
            return out

        return encode

    return load


def rank_pages(pages: DataFrame, query_vector: list[float], embed: Callable[[Column], Column], top: int = TOP, least: float = LEAST, size: int = CHUNK, overlap: int = OVERLAP, need_type: bool = True) -> DataFrame:
    """Best chunks of each page (``url, title, text``): cut, keep the useful, embed, compare, take the top. ``chunk_index`` numbers the useful ones."""
    cut = chunks(pages.select("url", "title", "text"), "text", size, overlap).filter(useful_chunk(F.col("chunk"), F.col("title"), F.col("url"), need_type))
    kept = cut.groupBy("url", "title").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk"))).alias("c")).select("url", "title", F.posexplode("c").alias("chunk_index", "c")).select("url", "title", "chunk_index", "c.chunk")
    near = kept.withColumn("score", F.round(cosine(embed(F.col("chunk")), F.array(*map(F.lit, query_vector))), 6)).filter(F.col("score") >= least)
    return top_per_group(near, ["url"], [F.desc("score"), F.asc("chunk_index")], top)

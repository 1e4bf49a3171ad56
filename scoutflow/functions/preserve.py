"""What a changed text must keep of the original: protected tokens, amounts, its script."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is kept letter by letter, amounts with their currency, and the letters of Chinese.
PROTECTED = r"(?i)https?://\S+|\b\d{4}-\d{2}-\d{2}\b"
CURRENCY = r"(?i)(?:(?:EUR|USD|GBP|CHF|CNY|RMB|JPY|INR|KRW|SGD|AUD|CAD)\s?|[€$£]\s?)(\d[\d,]*(?:\.\d+)?)"
HAN = r"[㐀-鿿]"


def lost_tokens(original: Column, changed: Column, pattern: str = PROTECTED, group: int = 0) -> Column:
    """Tokens of ``original``, in order and each once, that do not stand in ``changed``."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(original, F.lit("")), F.lit(pattern), F.lit(group)))
    return F.filter(found, lambda t: ~F.contains(F.coalesce(changed, F.lit("")), t))


def lost_amounts(original: Column, changed: Column) -> Column:
    """Amounts of ``original`` that do not stand in ``changed``; commas within numbers make no difference."""
    bare = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(","), F.lit(""))
    amounts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(original, F.lit("")), F.lit(CURRENCY), F.lit(1)), bare))
    return F.filter(amounts, lambda a: ~F.contains(bare(changed), a))


def missing_words(pairs: DataFrame, key: str) -> DataFrame:
    """``key, word, n`` for each word that ``changed`` holds ``n`` times less than ``original`` (``key, original, changed``): the difference of the two multisets."""
    words = lambda c, sign: F.transform(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.lit(sign).alias("sign")))
    rows = pairs.select(key, F.inline(F.concat(words("original", 1), words("changed", -1))))
    return rows.groupBy(key, "word").agg(F.sum("sign").alias("n")).filter("n > 0")


def has_han(text: Column) -> Column:
    """Whether a text holds Chinese characters. Null: false."""
    return F.coalesce(text.rlike(HAN), F.lit(False))


def faults(original: Column, changed: Column) -> Column:
    """Why ``changed`` can't stand for ``original``, in order: ``empty``, ``protected token changed``, ``currency amount changed``; none if it can."""
    empty = F.trim(F.coalesce(changed, F.lit(""))) == ""
    checks = [F.when(empty, "empty"), F.when(~empty & (F.size(lost_tokens(original, changed)) > 0), "protected token changed"), F.when(~empty & (F.size(lost_amounts(original, changed)) > 0), "currency amount changed")]
    return F.array_compact(F.array(*checks))

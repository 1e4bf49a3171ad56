"""Amounts and currencies as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions.text import lowered

FREE = r"(?i)\b(free of charge|no (?:participation|registration|tuition|course) fees?|free participation|attendance is free)\b"
AMOUNT = r"\d+(?:[ .,]\d{3})*(?:[.,]\d{1,2})?"
# Codes before signs, in order of trial.
CODES = ["EUR", "USD", "GBP", "CHF", "SEK", "NOK", "DKK", "CAD", "AUD", "CNY", "JPY"]
SIGNS = [("€", "EUR"), ("£", "GBP"), (r"\$", "USD")]


def parse_amount(text: Column) -> Column:
    """A number written with either separator: ``1.234,50``, ``1,234.50``, ``1 234``; null if there is none."""
    t = F.replace(F.regexp_replace(text, r"(?U)\s", ""), F.lit("'"), F.lit(""))
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    comma_last = F.locate(",", F.reverse(t)) < F.locate(".", F.reverse(t))
    european = F.translate(F.replace(t, F.lit("."), F.lit("")), ",", ".")
    english = F.replace(t, F.lit(","), F.lit(""))
    one = F.when(t.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(t, "[.,]", "")).otherwise(F.translate(t, ",", "."))
    return F.when(both & comma_last, european).when(both, english).otherwise(one).try_cast("double")


def currency(text: Column) -> Column:
    """A currency code in the text, else that of a currency sign, else null. RMB is CNY."""
    names = [(rf"(?i)\b{c}\b", c.lower(), c) for c in CODES] + [(r"(?i)\bRMB\b", "rmb", "CNY"), (r"(?i)\beuros?\b", "euro", "EUR")]
    code = lowered(text, lambda t, low: F.coalesce(*[F.when(F.contains(low, F.lit(word)) & t.rlike(p), c) for p, word, c in names]))
    return F.coalesce(code, *[F.when(text.rlike(s), c) for s, c in SIGNS])


def amounts(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), parse_amount), lambda a: a.isNotNull())


def fee_to_eur(fee: Column, rate: Column) -> Column:
    """Euros by the rate of the fee's currency: 0 for a free phrase, else the largest amount, to two places; null if unknown."""
    return F.when(fee.rlike(FREE), F.lit(0.0)).otherwise(F.round(F.array_max(amounts(fee)) * rate, 2))


def fee_per_day(fee_eur: Column, days: Column) -> Column:
    """Infinite where the fee is unknown or there are no days."""
    return F.when(fee_eur.isNull() | F.coalesce(days == 0, F.lit(True)), F.lit(float("inf"))).otherwise(fee_eur / days)

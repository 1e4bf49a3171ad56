"""What participation costs: free phrases, contributions, the least row of a fee table, participants' own amounts, other fees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoutflow.functions import money, spans
from scoutflow.functions import text as tx

# Currencies and how fees are written, in order of trial.
CURRENCIES = r"EUR|USD|GBP|CHF|CNY|RMB|JPY|INR|KRW|SGD|AUD|CAD"
SIGN = rf"(?:{CURRENCIES}|€|\$|£)"
PRICE = rf"(?:{SIGN}\s?\d[\d ,.]*\d?|\d[\d ,.]*\d?\s?{SIGN})"
FREE = [
    r"\b(free of charge)\b",
    r"\b(no (?:registration|participation|tuition|course) fees?)\b",
    r"\b(participation is free)\b",
    r"\b(there (?:is|are) no (?:registration|participation|tuition|course) fees?)\b",
]
CONTRIBUTION = rf"required to pay a contribution of\s+({PRICE})"
TABLE = r"(?is)\bcourse fees?\b(.{0,900}?)(?:\bapplication\b|\bcontact information\b|\bfacts\s*&\s*figures\b|$)"
PARTICIPANTS = [
    ("participant", rf"(?:student|students|master'?s?|msc|phd|doctoral)[^.\n]{{0,60}}?({PRICE})"),
    ("participant", rf"(?:student|post-?doc|academic)[ -]+registration[^.\n]{{0,40}}?({PRICE})"),
]
PAID = [
    r"\b(?:registration fees?|participation fees?|tuition fees?|course fees?|fees?|costs?)\b[:\s-]+([^.;\n]{1,100})",
    rf"({SIGN}\s?\d[\d ,.]*\d\s+(?:registration|participation|tuition|course)?\s*(?:fees?|costs?))",
    rf"(\d[\d ,.]*\d?\s?{SIGN}\s+(?:registration|participation|tuition|course)?\s*(?:fees?|costs?))",
]
HOUSING = r"(?i)room|board|housing|accommodation|hotel"
# Words of which every match of a pattern holds one: a pattern is tried only where one of them stands.
_NO_FEE = ("no registration", "no participation", "no tuition", "no course")
FREE_NEEDS = [("free of charge",), _NO_FEE, ("participation is free",), _NO_FEE]
CONTRIBUTION_NEEDS = [("contribution",)]
PARTICIPANT_NEEDS = ["student", "master", "msc", "phd", "doctoral", "post", "academic"]
_SIGNS = ("eur", "usd", "gbp", "chf", "cny", "rmb", "jpy", "inr", "krw", "sgd", "aud", "cad", "€", "$", "£")
PAID_NEEDS = [("fee", "cost"), _SIGNS, _SIGNS]
LEAST, BEFORE, AFTER = 20, 80, 40


def least_price(prices: Column) -> Column:
    """Of price texts the one with the least amount of at least ``LEAST``, the first of equals; null without one."""
    amount = lambda p: F.array_max(money.amounts(p))
    rows = F.filter(F.transform(prices, lambda p, i: F.struct(amount(p).alias("amount"), i.alias("i"), tx.clean_space(p).alias("text"))), lambda r: r["amount"] >= LEAST)
    return F.array_min(rows)["text"]


def table_fee(text: Column) -> Column:
    """The least price of a table of course fees."""
    table = tx.lowered(text, lambda t, low: F.when(F.contains(low, F.lit("course fee")), F.regexp_extract(t, TABLE, 1)))
    return least_price(F.regexp_extract_all(table, F.lit(rf"(?i){SIGN}\s?\d[\d ,.]*\d?"), F.lit(0)))


def participant_fee(text: Column) -> Column:
    """The least price that stands with students or doctoral participants and not with housing."""
    found = spans.found(text, PARTICIPANTS, BEFORE, AFTER, needs=PARTICIPANT_NEEDS)
    return least_price(F.transform(F.filter(found, lambda m: ~m["context"].rlike(HOUSING)), lambda m: m["value"]))


def _first(text: Column, patterns: list[str], needs: list[tuple[str, ...]]) -> Column:
    return F.nullif(tx.clean_space(tx.first_match(text, [f"(?i){p}" for p in patterns], needs)), F.lit(""))


def stated_fee(text: Column) -> Column:
    """A free phrase, or what stands with words of fees; null without one. A fee without a number is none."""
    paid = tx.let(_first(text, PAID, PAID_NEEDS), lambda p: F.when(p.rlike(r"\d"), p))
    return F.coalesce(_first(text, FREE, FREE_NEEDS), paid)


def fee_of(text: Column) -> Column:
    """A page's fee as it is written; empty without one."""
    return F.coalesce(_first(text, FREE, FREE_NEEDS), _first(text, [CONTRIBUTION], CONTRIBUTION_NEEDS), table_fee(text), participant_fee(text), stated_fee(text), F.lit(""))


# An amount of funding, and how what is known of money is shown.
GRANT = r"(?i)(?:EUR|USD|GBP|CHF|CNY|RMB|JPY|INR|KRW|SGD|AUD|CAD)\s?\d[\d,.]*|[€$£]\s?\d[\d,.]*"
ON_PAGE = "Apply on official page"


def financial_summary(available: Column, types: Column, evidence: Column, fee_eur: Column, apply: bool = True) -> Column:
    """What a reader is told of funding or fee: kinds and amount where there is funding, else the fee in EUR, else that neither is stated. ``apply`` adds where to apply."""
    kinds = F.coalesce(F.nullif(F.array_join(types, ", "), F.lit("")), F.lit("Funding available"))
    amount = F.coalesce(F.nullif(tx.clean_space(F.regexp_extract(F.coalesce(evidence, F.lit("")), GRANT, 0)), F.lit("")), F.lit("amount not stated"))
    end = F.lit(f" · {ON_PAGE}" if apply else "")
    fee = F.concat(F.lit("Fee about EUR "), F.bround(fee_eur, 0).cast("long").cast("string"), end)
    return F.when(F.coalesce(available, F.lit(False)), F.concat(kinds, F.lit(" · "), amount, end)).when(fee_eur.isNotNull(), fee).otherwise("Funding or fee not stated")

"""Scalar functions on small inputs."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from scoutflow.functions import dates, money, text, urls


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'date' if isinstance(v, date) else 'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://WWW.Example.org:8080/a/b//?utm_source=x&b=2&a=1&ref=q&c=#top", "http://example.org/a/b?a=1&b=2"),
        ("https://example.org", "https://example.org/"),
        ("//example.org/x/", "https://example.org/x"),
        ("", ""),
        (None, ""),
        ("https://e.org/s?q=a+b&z=%C3%A9", "https://e.org/s?q=a+b&z=%C3%A9"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u")), u=url) == want


def test_url_predicates(spark):
    u = F.col("u")
    assert one(spark, urls.fetchable(u, ["bad.org"]), u="https://good.org/a") is True
    for bad in ("https://x.bad.org/a", "https://good.org/a.PDF", "ftp://good.org/a", "mailto:a@b.c"):
        assert one(spark, urls.fetchable(u, ["bad.org"]), u=bad) is False
    assert one(spark, urls.safe_external(u), u=" https://a.org:99999/ ") == "" and one(spark, urls.safe_external(u), u=" https://a.org:80/ ") == "https://a.org:80/"
    assert one(spark, urls.same_domain(F.col("a"), F.col("b")), a="https://www.a.org/x", b="https://sub.a.org/") is True
    assert one(spark, urls.follow_up_url(u), u="HTTPS://WWW.a.org:80/x?y=1#z") == "https://www.a.org:80/x?y=1"


@pytest.mark.parametrize(
    ("text_", "want"),
    [
        ("2026-07-03", date(2026, 7, 3)), ("3rd July 2026", date(2026, 7, 3)), ("July 3, 2026", date(2026, 7, 3)), ("3/7/2026", date(2026, 7, 3)), ("3/13/2026", date(2026, 3, 13)),
        ("15 Sept. 2026", date(2026, 9, 15)), ("31 February 2026", None), ("School 3 2026", None), ("", None), (None, None),
    ],
)
def test_parse_date(spark, text_, want):
    assert one(spark, dates.parse_date(F.col("t")), t=text_) == want


def test_date_rules(spark):
    d, s = F.col("d"), F.col("s")
    assert one(spark, dates.inferred_year(d, s), d=date(2000, 12, 1), s=date(2027, 1, 10)) == date(2026, 12, 1)
    assert one(spark, dates.inferred_year(d, s), d=date(2000, 2, 29), s=date(2027, 1, 10)) is None
    assert one(spark, dates.duration_days(d, s), d=date(2026, 7, 1), s=date(2026, 7, 5)) == 5
    assert one(spark, dates.date_span_label(d, s), d=date(2026, 7, 1), s=date(2026, 7, 5)) == "1 Jul - 5 Jul 2026"


@pytest.mark.parametrize(("amount", "want"), [("1.234,50", 1234.5), ("1,234.50", 1234.5), ("1 234", 1234.0), ("1.234", 1234.0), ("12,5", 12.5), ("x", None)])
def test_amounts(spark, amount, want):
    assert one(spark, money.parse_amount(F.col("a")), a=amount) == want


def test_fees(spark):
    f = lambda t: one(spark, money.fee_to_eur(F.col("t"), F.col("r")), t=t, r=0.5)
    assert f("EUR 300 to 450") == 225.0 and f("free of charge") == 0.0 and f("unknown") is None
    assert one(spark, money.currency(F.col("t")), t="USD 5 or €6") == "USD" and one(spark, money.currency(F.col("t")), t="RMB 5") == "CNY" and one(spark, money.currency(F.col("t")), t="five") is None
    assert one(spark, money.fee_per_day(F.col("f"), F.col("d")), f=100.0, d=0) == float("inf")


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.clean_title(t), t="A  school - of | things • x") == "A school"
    assert one(spark, text.normalise_title(t), t="The 2026 School: Data!") == "the school data"
    assert one(spark, text.evidence_window(t, "fee", 5), t="the fee is 10 euros") == "fee is 1"
    assert one(spark, text.shorten(t, 8), t="one two three") == "one two" and one(spark, text.shorten(t, 5), t="abcdefgh") == "abcde"
    assert one(spark, text.windows(t, 12, 4), t="x" * 40) == ["x" * 12] * 4 + ["x" * 8]
    assert one(spark, text.windows(t, 12, 4), t="short") == ["short"] and one(spark, text.windows(t, 12, 4), t=None) == []
    assert one(spark, text.signals(t), t="Deadline for the scholarship") == ["deadline", "funding"]
    assert one(spark, text.first_match(t, ["(no fee)", r"fee: (\d+)"]), t="fee: 20") == "20"

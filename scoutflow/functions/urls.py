"""URL functions as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, file types that are no pages, hosts that are no sources.
TRACKING = ["fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "source"]
FILE_SUFFIXES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".jpg", ".jpeg", ".png", ".gif", ".zip"]
SOCIAL_HOSTS = ["facebook.com", "instagram.com", "linkedin.com", "reddit.com", "tiktok.com", "twitter.com", "x.com", "youtube.com"]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    whole = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(whole, "^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def _encoded(value: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(value), value)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """One form of a URL: scheme and host in lower case, no ``www.``, port, fragment, trailing slash or tracking; sorted query.

    Parameters with an empty value vanish and the rest are encoded anew. Null and empty stay empty.
    """
    pairs = F.transform(F.split(query(url), "&"), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("k"), F.substr(p, F.length(F.split_part(p, F.lit("="), F.lit(1))) + 2, F.length(p)).alias("v")))
    real = F.filter(pairs, lambda p: (p["v"] != "") & ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(TRACKING))
    kept = F.array_join(F.transform(F.array_sort(real), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    trimmed = F.coalesce(F.nullif(F.regexp_replace(path(url), "/+$", ""), F.lit("")), F.lit("/"))
    bare = F.regexp_replace(host(url), r"^www\.", "")
    whole = F.concat(F.coalesce(F.nullif(scheme(url), F.lit("")), F.lit("https")), F.lit("://"), bare, trimmed, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.lit("")).otherwise(whole)


def follow_up_url(url: Column) -> Column:
    """The lighter form used within one crawl: no fragment, lower-case scheme and host, the rest as it stands."""
    where = F.regexp_extract(F.trim(url), r"^[^:/?#]+://([^/?#]*)", 1)
    rest = F.regexp_extract(F.trim(url), r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    return F.concat(scheme(url), F.lit("://"), F.lower(where), F.when(rest == "", "/").otherwise(rest))


def host_matches(name: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    if not domains:
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, domains)), lambda d: (name == d) | F.endswith(name, F.concat(F.lit("."), d)))


def same_domain(a: Column, b: Column) -> Column:
    """Whether one host equals the other or lies below it, ``www.`` aside."""
    x, y = (F.regexp_replace(host(u), r"^www\.", "") for u in (a, b))
    return (x != "") & (y != "") & ((x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x)))


def fetchable(url: Column, blocked: Sequence[str] = ()) -> Column:
    """A web page by its URL: http or https, not on a blocked domain, not a file of another type."""
    ends = F.exists(F.array(*map(F.lit, FILE_SUFFIXES)), lambda s: F.endswith(F.lower(path(url)), s))
    return scheme(url).isin("http", "https") & ~host_matches(host(url), blocked) & ~ends


def safe_external(url: Column) -> Column:
    """The trimmed URL where it is safe to link to, else empty: http(s), a host, a port in range, no control characters."""
    clean = F.trim(F.coalesce(url, F.lit("")))
    port = F.regexp_extract(clean, r"^[^:/?#]+://[^/?#]*?:(\d+)(?:[/?#]|$)", 1)
    in_range = (port == "") | port.try_cast("long").between(0, 65535)
    return F.when(scheme(clean).isin("http", "https") & (host(clean) != "") & in_range & ~clean.rlike(r"[\x00-\x20\x7f]"), clean).otherwise("")

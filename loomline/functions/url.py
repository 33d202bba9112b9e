"""URL functions, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels.
TWO_LABEL_SUFFIXES = "ac.in co.in co.jp co.kr co.nz co.uk com.au com.br com.cn com.mx com.sg com.tr edu.au gov.in gov.uk net.au org.au org.uk".split()
# Query parameters that do not change which offer a URL shows.
VOLATILE_PARAMS = (
    "_country activecolor active_color cawidth clr cm_mmc cm_ven color colour dwvar dwvar_color fbclid gclid link_id msclkid ranmid show_expr size srsltid "
    "utm_campaign utm_content utm_medium utm_source utm_term variant vid width"
).split()
#: Our own defaults: tracking parameters (prefix utm_ and these).
TRACKING_PARAMS = ["gclid", "fbclid", "msclkid", "ref", "srsltid"]

_AUTHORITY = r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#]*)"


def netloc(url: Column) -> Column:
    """Host and port in lower case; scheme-less URLs are read as if `//` stood before them."""
    return F.regexp_extract(F.lower(F.trim(url)), _AUTHORITY, 1)


def domain_key(url: Column) -> Column:
    """Host without default ports and, last, without `www.`."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r":(80|443)$", ""), r"^www\.", "")


def hostname(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r":\d+$", "")


def registrable_host(url: Column) -> Column:
    """IPv4 as it is; the last two labels, or three behind a two-label suffix."""
    host = F.regexp_replace(hostname(url), r"^\.+|\.+$", "")
    parts = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(parts, -n, n), ".")
    return F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | (F.size(parts) <= 2), host).when(last(2).isin(TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def same_site(a: Column, b: Column) -> Column:
    return (registrable_host(a) == registrable_host(b)) & (registrable_host(a) != "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def monitor_key(url: Column) -> Column:
    """Scheme and host in lower case, path without parameters and trailing slashes; no query, no fragment."""
    scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    plain = F.regexp_replace(path(url), r";[^/]*$", "")
    trimmed = F.when(plain == "/", plain).otherwise(F.regexp_replace(plain, r"/+$", ""))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), netloc(url), trimmed)).otherwise(trimmed)


def identity_key(url: Column) -> Column:
    """SHA-256 of the trimmed URL; null where it is empty."""
    return F.when(F.trim(url) != "", F.sha2(F.trim(url), 256))


def _kept_params(url: Column, drop: Column | None = None):
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def strip_tracking(url: Column) -> Column:
    """Without tracking parameters; the others keep their order. No fragment."""
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    kept = F.filter(_kept_params(url), lambda p: ~name(p).startswith("utm_") & ~name(p).isin(TRACKING_PARAMS))
    base = F.regexp_extract(F.trim(url), r"^([^?#]*)", 1)
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def collapse_key(url: Column) -> Column:
    """Key of one offer: no volatile parameters, the rest sorted, no `www.`, no trailing slash."""
    name = lambda p: F.lower(F.regexp_extract(p, r"^([^=]*)", 1))
    kept = F.array_sort(F.filter(_kept_params(url), lambda p: ~name(p).isin(VOLATILE_PARAMS) & ~name(p).startswith("utm_")))
    base = F.concat(domain_key(url), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def is_concatenated(url: Column) -> Column:
    return F.regexp_count(url, F.lit("https?://")) > 1


def terminal_text(url: Column) -> Column:
    """Last path part without suffix, its separators as spaces."""
    last = F.regexp_extract(F.regexp_replace(path(url), r"/+$", ""), r"([^/]*)$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, r"\.[A-Za-z0-9]{1,5}$", ""), r"[-_+%]+", " "))


def shape_signature(url: Column) -> Column:
    """First path part, whether a part has a digit, and depth up to four."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    return F.concat_ws("|", F.lower(first), F.when(path(url).rlike(r"\d"), "id").otherwise("-"), F.least(F.size(parts), F.lit(4)).cast("string"))


def navigation_safe(url: Column) -> Column:
    return url.rlike(r"^https?://[^/\s]+") & (F.length(url) <= 2048) & ~F.lower(url).rlike(r"javascript:|/logout|/signout")


SURFACE_RULES = [
    # (surface, confidence, where, pattern), the first that fits
    ("article_detail", 0.9, "path", r"/(blog|blog/entry|article|articles|news|post|posts)/"),
    ("forum_detail", 0.7, "host", r"forum|discuss|community"),
    ("forum_detail", 0.7, "path", r"/(thread|threads|forum|forums|discussion|discussions|questions|answers|comments)/"),
    ("job_detail", 0.7, "path", r"/(job|jobs|careers|positions|openings)/"),
    ("ecommerce_listing", 0.7, "path", r"/(collections|collection|category|categories)/|/search|/shop/"),
    ("ecommerce_detail", 0.7, "path", r"/(product|products|p|item|dp)/"),
]


def surface(url: Column) -> tuple[Column, Column]:
    """(surface, confidence) of a page by its URL."""
    where = {"path": F.lower(path(url)), "host": hostname(url)}
    name, sure = F.lit("content_detail"), F.lit(0.4)
    for kind, confidence, part, pattern in reversed(SURFACE_RULES):
        name, sure = F.when(where[part].rlike(pattern), kind).otherwise(name), F.when(where[part].rlike(pattern), confidence).otherwise(sure)
    return name, sure

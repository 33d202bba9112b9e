"""Typed fields of records, Column -> Column: numbers, lists, codes, places, links and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import money, text
from . import url as U

# Names of genders.
GENDERS = {"women": "women", "womens": "women", "female": "women", "men": "men", "mens": "men", "male": "men", "unisex": "unisex"}
# Lengths of barcodes.
BARCODE_LENGTHS = (8, 12, 13, 14)
#: Our own defaults: query parameters of an image that only change its size, and endings of image files.
SIZE_PARAMS = ["w", "h", "width", "height", "q", "quality", "dpr", "fit", "crop", "auto", "fm", "format"]
IMAGE_ENDINGS = ["jpg", "jpeg", "png", "webp", "gif", "avif"]
#: Our own defaults: currencies of country hosts.
HOST_CURRENCIES = {".co.uk": "GBP", ".in": "INR", ".de": "EUR", ".fr": "EUR", ".co.jp": "JPY", ".ca": "CAD"}
MARKED_PRICE = r"(?:[$€£₹¥]\s*\d[\d.,]*\d|[$€£₹¥]\s*\d|\d[\d.,]*\s*[€£])"
CODED_PRICE = r"\b(?:USD|EUR|GBP|INR|JPY)\s*\d[\d.,]*\d"


# --- numbers -----------------------------------------------------------------------------------------------------


def whole_number(c: Column) -> Column:
    """First number without its decimals; grouping commas do not end it."""
    found = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0)
    return F.regexp_extract(F.nullif(found, F.lit("")), r"^-?\d+", 0).try_cast("long")


def rating(c: Column) -> Column:
    """To hundredths, halves to the even neighbour; null where the text is no number."""
    return F.bround(F.trim(c).try_cast("decimal(18,6)"), 2).cast("double")


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(done * 100 / total)).otherwise(0).cast("long")


def price_mention(c: Column) -> Column:
    """The last price with a currency sign; without any, the last with a code in front."""
    last = lambda t, pattern: F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), 0), F.lit(-1))
    return F.coalesce(last(c, MARKED_PRICE), last(F.upper(c), CODED_PRICE))


def preferred_price(*candidates: Column) -> Column:
    """The first with a sign or code of money, else the first; empty and negative ones are passed over."""
    usable = [F.when(~text.is_empty(c) & ~money.is_negative(c), c) for c in candidates]
    return F.coalesce(*(F.when(money.currency(c).isNotNull(), c) for c in usable), *usable)


def host_currency(url: Column) -> Column:
    out = F.lit(None).cast("string")
    for ending, code in HOST_CURRENCIES.items():
        out = F.when(U.hostname(url).endswith(ending), code).otherwise(out)
    return out


# --- lists and codes ---------------------------------------------------------------------------------------------


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[,/|;·]"), text.collapse), lambda p: p != "")


def distinct_texts(values: Column) -> Column:
    """Without empty ones and without those that differ from an earlier one in case alone; the order stays."""
    clean = F.filter(F.transform(values, text.collapse), lambda v: v != "")
    lower = F.transform(clean, lambda v: F.lower(v))
    return F.filter(clean, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)


def halved(c: Column) -> Column:
    """One half of a text that says the same words twice."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    half = (F.size(words) / 2).cast("int")
    first, second = F.slice(words, F.lit(1), half), F.slice(words, half + 1, half)
    return F.when((F.size(words) >= 2) & (F.size(words) % 2 == 0) & (first == second), F.array_join(first, " ")).otherwise(c)


def title_case(c: Column) -> Column:
    """Words with a capital first letter; those all in capitals stay."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
    return F.array_join(F.transform(F.split(text.collapse(c), " "), lambda w: F.when((F.upper(w) == w) & (F.lower(w) != w), w).otherwise(capital(w))), " ")


def style_codes(c: Column, gtin: Column, least: int = 5) -> Column:
    """Letters and digits of a maker's style number, sorted; none that the barcode holds."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(?i)[a-z]{2,}\d{3,}"), 0), lambda m: F.lower(m))
    kept = F.filter(found, lambda m: (F.length(m) >= least) & ~F.contains(F.lower(F.coalesce(gtin, F.lit(""))), m))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def materials(c: Column) -> Column:
    """Names behind percentages, once each, in their order."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"\d{1,3}(?:\.\d+)?\s*(?:%|percent)\s*([a-z]+(?:-[a-z]+)?)"), 1)
    return F.array_distinct(found)


def gender(c: Column) -> Column:
    """The listed name, or the text itself where it is not listed."""
    folded, out = F.lower(F.trim(c)), F.trim(c)
    for name, value in GENDERS.items():
        out = F.when(folded == name, value).otherwise(out)
    return F.nullif(out, F.lit(""))


def barcode(c: Column) -> Column:
    digits = F.regexp_replace(c, r"[\s-]+", "")
    return F.when(c.rlike(r"^[\d\s-]+$") & F.length(digits).isin(*BARCODE_LENGTHS), digits)


def sku(c: Column) -> Column:
    """Without a draft's prefix; none where it is JSON, or a draft's long number."""
    draft = F.lower(c).rlike(r"^(draft|copy)[-_ ]")
    clean = F.trim(F.regexp_replace(c, r"(?i)^(draft|copy)[-_ ]", ""))
    return F.when(clean.rlike(r"^[{\[]") | (draft & clean.rlike(r"^\d{10,}$")), F.lit(None)).otherwise(F.nullif(clean, F.lit("")))


def location(*parts: Column) -> Column:
    """City, region and country in a row, each once."""
    return F.nullif(F.array_join(distinct_texts(F.array(*(F.coalesce(p, F.lit("")) for p in parts))), ", "), F.lit(""))


# --- links and images --------------------------------------------------------------------------------------------


def absolute_url(base: Column, ref: Column) -> Column:
    """ref as seen from the page base. Bare hosts get https; dots in paths are resolved."""
    base, ref = F.trim(base), F.trim(ref)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[^/]*$", "")
    target, rest = F.regexp_extract(ref, r"^([^?#]*)", 1), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.concat(F.when(folder == "", "/").otherwise(folder), target), "/")
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), lambda done, p: F.when(p == "..", up(done)).when(p == ".", done).otherwise(F.concat(done, F.array(p))))
    return (
        F.when(ref == "", "")
        .when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(origin, ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .when(ref.startswith("?"), F.concat(plain, ref))
        .when(ref.rlike(r"(?i)^(?:[a-z0-9-]+\.)+(?:com|net|org)(?:[/?#].*)?$"), F.concat(F.lit("https://"), ref))
        .otherwise(F.concat(origin, F.array_join(walked, "/"), rest))
    )


def srcset(c: Column) -> Column:
    """The URLs of a srcset, without their widths."""
    return F.filter(F.transform(F.split(c, ","), lambda p: F.substring_index(text.collapse(p), " ", 1)), lambda u: u != "")


def image_key(url: Column) -> Column:
    """Without parameters of size and fragment, in lower case."""
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    kept = F.filter(F.split(U.query(url), "&"), lambda p: (p != "") & ~name(p).isin(SIZE_PARAMS))
    base = F.regexp_extract(F.trim(url), r"^([^?#]*)", 1)
    return F.lower(F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base))


def is_image(url: Column) -> Column:
    low = F.lower(F.trim(url))
    path = F.regexp_extract(low, r"^([^?#]*)", 1)
    return ~low.rlike("^(data|javascript|mailto):") & (path.rlike(rf"\.({'|'.join(IMAGE_ENDINGS)})$") | (~path.rlike(r"\.(html?|php|aspx?)$") & low.rlike(r"[?&](format|fm)=")))


def urls_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("https?://[^\\s\"'<>)]+"), 0))


def category_path(url: Column) -> Column:
    """The parts of a path before its last, as words."""
    parts = F.filter(F.split(U.path(url), "/"), lambda p: p != "")
    words = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.trim(F.regexp_replace(p, "[-_]+", " ")))
    return F.nullif(F.array_join(F.filter(words, lambda p: ~p.rlike(r"^\d*$")), " > "), F.lit(""))

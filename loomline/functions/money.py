"""Prices, numbers and currencies, Column -> Column. The four number readers differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own defaults: signs and codes.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY"}
ALIASES = {r"\brs\.?(\s|\d|$)": "INR"}
CODES = ["USD", "EUR", "GBP", "INR", "JPY", "CAD", "AUD", "CHF", "SEK"]
_CONTEXT = r"(?i)[$€£₹¥]|\b(rs|usd|eur|gbp|inr|jpy|cad|aud|chf|sek)\b"
NEGATIVE = r"^\s*(?:-\s*(?:[$€£₹¥]|[A-Za-z]{3})?\s*\d|(?:[$€£₹¥]|[A-Za-z]{3})\s*-\s*\d)"


def is_negative(text: Column) -> Column:
    return text.rlike(NEGATIVE)


def canonical_number(text: Column) -> Column:
    """First number of text with a point as its only sign: grouping by three, or decimals after the last sign."""
    found = F.regexp_extract(text, r"\d[\d.,]*\d|\d", 0)
    # a let-binding: else each branch would search the text anew
    return F.element_at(F.transform(F.array(found), _pointed), 1)


def _pointed(found: Column) -> Column:
    """A number's text with a point as its only sign, by which signs it has and where the last one stands."""
    comma, dot = F.instr(found, ","), F.instr(found, ".")
    tail = F.length(F.substring_index(found, ",", -1))
    plain = F.replace(found, F.lit(","), F.lit(""))
    by_comma = F.concat(F.translate(F.substring(found, F.lit(1), F.length(found) - tail), ",.", ""), F.lit("."), F.substring_index(found, ",", -1))
    last_comma = F.length(F.substring_index(found, ".", -1)) > tail
    one_comma = F.length(found) - F.length(plain) == 1
    grouped = (dot > 0) & found.rlike(r"^\d+(\.\d{3})+$")
    return (
        F.when(found == "", F.lit(None))
        .when((comma > 0) & (dot > 0) & last_comma & one_comma, by_comma)
        .when((comma > 0) & (dot > 0), plain)
        .when((comma > 0) & (tail <= 2), by_comma)
        .when(comma > 0, plain)
        .when(grouped, F.replace(found, F.lit("."), F.lit("")))
        .otherwise(found)
    )


def price_text(text: Column) -> Column:
    """Price as text. Negative prices, and bare integers of up to three digits without a currency, are none."""
    bare = text.rlike(r"^\D*\d{1,3}\D*$") & ~text.rlike(_CONTEXT)
    return F.when(is_negative(text) | bare, F.lit(None)).otherwise(canonical_number(text))


def lenient_float(text: Column) -> Column:
    """All digits and signs; one to three digits after a last comma are decimals."""
    kept = F.regexp_replace(text, "[^0-9.,]+", "")
    comma, dot = kept.contains(","), kept.contains(".")
    value = (
        F.when(comma & dot & kept.rlike(r"\.[^.]*,[^.]*$"), F.regexp_replace(F.regexp_replace(kept, r"\.", ""), ",", "."))
        .when(comma & dot, F.regexp_replace(kept, ",", ""))
        .when(comma & kept.rlike(r",\d{1,3}$"), F.concat(F.regexp_extract(kept, r"^(.*),", 1), F.lit("."), F.regexp_extract(kept, r",(\d+)$", 1)))
        .otherwise(F.regexp_replace(kept, ",", ""))
    )
    return F.regexp_replace(value, "[^0-9.]+", "").try_cast("double")


def first_number(text: Column) -> Column:
    """First number as a decimal; stops at a comma."""
    return F.nullif(F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("decimal(18,4)")


def currency(text: Column) -> Column:
    """Code by alias, sign, then ISO code."""
    out = F.lit(None).cast("string")
    for code in reversed(CODES):
        out = F.when(F.upper(text).rlike(rf"(^|[^A-Z]){code}([^A-Z]|$)"), code).otherwise(out)
    for sign, code in reversed(list(SYMBOLS.items())):
        out = F.when(text.contains(sign), code).otherwise(out)
    for pattern, code in ALIASES.items():
        out = F.when(F.lower(text).rlike(pattern), code).otherwise(out)
    return out


def within_band(source: Column, other: Column, share: float = 0.25) -> Column:
    """Whether other is within share of source; both have to be positive."""
    return (source > 0) & (other > 0) & (F.abs(source - other) <= share * source)


def score_label(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.60, "medium").when(score >= 0.40, "low").otherwise("uncertain")


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.55, "medium").otherwise("low")


# Availability tokens, tried from the longest to the shortest.
AVAILABILITY = {
    "in_stock": ["in stock", "instock", "available", "ready to ship"],
    "limited_stock": ["limited stock", "limitedstock", "low stock", "lowstock", "only", "left in stock"],
    "out_of_stock": ["out of stock", "outofstock", "oos", "sold out", "unavailable"],
    "pre_order": ["pre-order", "preorder", "backorder", "back-order"],
}


def availability(text: Column) -> Column:
    tokens = sorted(((t, state) for state, ts in AVAILABILITY.items() for t in ts), key=lambda x: len(x[0]))
    out = F.lit(None).cast("string")
    for token, state in tokens:  # the longest is tried first, so it wraps the others
        out = F.when(F.lower(text).contains(token), state).otherwise(out)
    return out

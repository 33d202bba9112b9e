"""Text functions, Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def is_empty(c: Column) -> Column:
    """Null and blank text are one class; 0 and false are not empty."""
    return c.isNull() | (c == "")


def first_present(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~is_empty(c), c) for c in columns))


def unescape(c: Column) -> Column:
    for name, value in _ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_text(c: Column) -> Column:
    """Entities read, white space collapsed; tags stay."""
    return collapse(unescape(c))


def strip_tags(c: Column) -> Column:
    """Text of HTML: comments, scripts and styles go first, as they may hold tags in strings."""
    bare = F.regexp_replace(c, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return clean_text(F.regexp_replace(bare, r"(?s)<[^>]+>", " "))


def equality_text(c: Column) -> Column:
    return collapse(F.lower(c))


def tokens(c: Column) -> Column:
    """Distinct runs of letters a-z and digits longer than one."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 1))


def brand(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def field_key(c: Column) -> Column:
    """Snake case of a field's name."""
    c = F.regexp_replace(collapse(c), "&", " ")
    c = F.regexp_replace(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    c = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", "_"), "_+", "_")
    return F.regexp_replace(c, r"^[_.]+|[_.]+$", "")


def has_term(text: Column, term: str) -> Column:
    return F.lower(text).rlike(rf"(^|[^a-z0-9])\Q{term}\E([^a-z0-9]|$)")


def stem(token: Column) -> Column:
    """Without ing, ers, er or ed where over three letters are left; a doubled last letter is halved."""
    out = token
    for suffix in ("ed", "er", "ers", "ing"):
        cut = F.substring(token, 1, F.length(token) - len(suffix))
        halved = F.when(cut.rlike(r"(.)\1$"), F.substring(cut, 1, F.length(cut) - 1)).otherwise(cut)
        out = F.when(token.endswith(suffix) & (F.length(token) > len(suffix) + 3) & ~token.contains(" "), halved).otherwise(out)
    return out


def bigrams(words: Column) -> Column:
    """Pairs of neighbours, each once."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def reading_minutes(words: Column) -> Column:
    return F.ceil(words / 200)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

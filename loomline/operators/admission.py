"""Which candidates may stand for a product, names of variant axes, values of alert rules, texts of scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own defaults.
PRODUCT_PATHS = r"/(product|products|p|item|dp)/"
LISTING_PATHS = r"/(category|categories|search|collections|brands)(/|$)"
LEAST_TOKENS, LEAST_OVERLAP = 2, 0.5
AXES = ("color", "size", "material", "style", "pattern", "length", "width")
AXIS_ALIASES = {"colour": "color", "colours": "color", "colors": "color", "sizes": "size", "shade": "color"}
AXIS_FILLERS = ("select", "choose", "option", "options", "variant", "product", "item", "shoe")
NOISE_VALUES = ("select", "choose an option", "choose option", "please select", "default title", "none", "n/a")
PROMO_WORDS = ("save", "off", "sale", "discount")


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def identity_tokens(c: Column) -> Column:
    """Words of five characters or more that hold a digit."""
    return F.filter(_words(c), lambda w: (F.length(w) >= 5) & w.rlike("[0-9]"))


def detail_path(url: Column) -> Column:
    """Whether a URL looks like one product's: a product path, else a last segment with three hyphens or more or an id; never a
    listing without a product path. Null and bare hosts do not."""
    path = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("")))
    last = F.regexp_extract(path, r"([^/]*)/*$", 1)
    slug = last.rlike(r"^[^-]+(-[^-]+){3,}$") | last.rlike(r"^[a-z]*[0-9]{5,}$")
    return path.rlike(PRODUCT_PATHS) | (~path.rlike(LISTING_PATHS) & slug)


def titles_differ(title: Column, other: Column, brand: Column) -> Column:
    """Whether less than half of the lesser title's words, the brand's aside, are in both; short titles never differ."""
    own = _words(brand)
    a, b = F.array_except(_words(title), own), F.array_except(_words(other), own)
    least = F.least(F.size(a), F.size(b))
    return (least >= LEAST_TOKENS) & (F.size(F.array_intersect(a, b)) < LEAST_OVERLAP * least)


def admitted(title: Column, brand: Column, codes: Column, url: Column, found: Column) -> Column:
    """Whether a candidate may be the product: its URL looks like one product's, and it shows one of the product's identity
    tokens, or shows no other ones and a title that does not differ. Without a found text the URL is read in its place."""
    known = identity_tokens(F.concat_ws(" ", title, codes))
    shown = identity_tokens(found)
    same = F.arrays_overlap(known, F.array_union(shown, identity_tokens(url)))
    conflict = (F.size(known) > 0) & (F.size(shown) > 0)
    text = F.when(F.trim(F.coalesce(found, F.lit(""))) == "", url).otherwise(found)
    return detail_path(url) & (same | (~conflict & ~titles_differ(title, text, brand)))


def axis_key(name: Column) -> Column:
    """A variant axis's name in snake case, by alias; an axis word among fillers, numbers and short words stands alone."""
    snake = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "_")
    snake = F.regexp_replace(snake, "^_|_$", "")
    for alias, key in AXIS_ALIASES.items():
        snake = F.when(snake == alias, key).otherwise(snake)
    telling = F.filter(F.split(snake, "_"), lambda w: w.isin(*AXES) | ~(w.isin(*AXIS_FILLERS) | w.rlike("^[0-9]*$") | (F.length(w) <= 3)))
    only = F.get(telling, F.lit(0))
    return F.when((F.size(telling) == 1) & only.isin(*AXES), only).otherwise(snake)


def option_noise(value: Column) -> Column:
    """Whether an option's value is no value: blank, a colour code, a promotion's share, or a prompt."""
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    promo = low.contains("%") & low.rlike("|".join(PROMO_WORDS))
    return (low == "") | low.rlike("^#([0-9a-f]{3}|[0-9a-f]{6})$") | promo | low.isin(*NOISE_VALUES)


def rule_values(rules: list[tuple[str | None, str | None, Column]]) -> Column:
    """A map from each alert rule (label, path, value) to its value as text: by its label, else its path, else its number. Of
    rules with one key the last stays."""
    named = {(label or "").strip() or (path or "").strip() or f"rule_{k}": value for k, (label, path, value) in enumerate(rules, 1)}
    return F.create_map(*(c for key, value in named.items() for c in (F.lit(key), value.cast("string"))))


def script_texts(html: Column) -> Column:
    """(id, type, text) of the scripts with a text, in order. A script in a template takes the template's name where it has no
    id of its own. Scripts in comments count too. Null has none."""
    whole = r"(?is)(?:<template\b[^>]*>\s*)?<script\b[^>]*>.*?</script\s*>"
    attribute = lambda tag, name: F.trim(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1))

    def node(found: Column) -> Column:
        template = F.regexp_extract(found, r"(?is)^(<template\b[^>]*>)", 1)
        tag = F.regexp_extract(found, r"(?is)(<script\b[^>]*>)", 1)
        own = attribute(tag, "id")
        text = F.trim(F.regexp_extract(found, r"(?is)<script\b[^>]*>(.*)</script\s*>$", 1))
        return F.struct(F.when(own == "", attribute(template, "data-(?:varname|state|id)")).otherwise(own).alias("id"), attribute(tag, "type").alias("type"), text.alias("text"))

    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(whole), F.lit(0)), node), lambda s: s["text"] != "")

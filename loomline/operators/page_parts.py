"""Parts of pages from their trees: images of a product, dates, summaries of cards, options of variants, and clean long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import text as X
from ..sources import dom
from . import admission

#: Our own defaults: words around an image that speak for a product's gallery, and against.
GALLERY_HINTS = ["gallery", "carousel", "product-image", "zoom", "hero", "main-image", "swiper"]
CHROME_HINTS = ["logo", "icon", "sprite", "avatar", "badge", "payment", "banner", "footer", "header", "related", "recommend"]
TRACKING_HINTS = ["analytics", "tracking", "pixel", "spacer", "blank.gif", "doubleclick"]
IMAGE_ATTRIBUTES = ["data-zoom-image", "data-large", "data-src", "src", "data-original"]
#: Where a card's or a page's date stands, the first that has one: (tag, attribute, value of it or a class).
DATE_PLACES = [("time", "datetime", None), (None, "itemprop", "datePublished"), ("meta", "property", "article:published_time"), (None, "class", "post-date"), (None, "class", "published")]
LEAST_SUMMARY = 24


def _attr(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", name), F.lit(""))


def _classed(name: str) -> Column:
    return F.array_contains(F.split(_attr("class"), r"\s+"), name)


def _named() -> Column:
    return F.lower(F.concat_ws(" ", _attr("class"), _attr("id"), _attr("alt"), _attr("data-testid")))


def _hinted(hints: list[str]) -> Column:
    return _named().rlike("|".join(h.replace(".", r"\.") for h in hints))


def images(tree: DataFrame, urls: DataFrame, most: int = 12, unlinked: bool = False, id_col: str = "page_id") -> DataFrame:
    """id_col, place, url and score of a page's images, the likeliest of a gallery first, one a picture whatever its size.

    +4 in a gallery, +2 with a text for it, +2 from 400 pixels on, -2 under 100, -1 within a link; images in the page's frame
    or with a mark of it, and those that count visits, are left out. unlinked leaves out those in links. urls: id_col, page_url."""
    frame = F.col("tag").isin("header", "footer", "nav", "aside") | _hinted(CHROME_HINTS)
    link, image = (F.col("tag") == "a") & (_attr("href") != ""), F.col("tag").isin("img", "source")
    # what speaks for or against an image, and the images: other nodes need not be put in order
    telling = tree.where(image | link | frame | _hinted(GALLERY_HINTS))
    seen = telling.withColumn("_frame", dom.inside(frame, id_col) | _hinted(CHROME_HINTS)).withColumn("_gallery", dom.inside(_hinted(GALLERY_HINTS), id_col) | _hinted(GALLERY_HINTS)).withColumn("_linked", dom.inside(link, id_col))
    found = seen.where(image & ~F.col("_frame") & ~(F.lit(unlinked) & F.col("_linked"))).join(urls, id_col)
    sets = V.srcset(F.coalesce(F.nullif(_attr("srcset"), F.lit("")), _attr("data-srcset")))
    plain = F.filter(F.array(*map(_attr, IMAGE_ATTRIBUTES)), lambda u: u != "")
    width = F.coalesce(_attr("width").try_cast("int"), F.lit(0))
    score = F.when(F.col("_gallery"), 4).otherwise(0) + F.when(_attr("alt") != "", 2).otherwise(0) + F.when(width >= 400, 2).when((width > 0) & (width < 100), -2).otherwise(0) - F.when(F.col("_linked"), 1).otherwise(0)
    each = found.select(id_col, "pre", "page_url", score.alias("score"), F.posexplode(F.array_distinct(F.concat(sets, plain))).alias("n", "ref"))
    each = each.withColumn("url", V.absolute_url(F.col("page_url"), F.col("ref"))).where(~F.lower("url").startswith("data:") & ~F.lower("url").rlike("|".join(h.replace(".", r"\.") for h in TRACKING_HINTS)))
    best = each.groupBy(id_col, V.image_key(F.col("url")).alias("_key")).agg(F.min(F.struct((-F.col("score")).alias("s"), "pre", "n", "url")).alias("x"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy(id_col).orderBy("x")))
    return placed.where(F.col("place") <= most).select(id_col, "place", F.col("x.url").alias("url"), (-F.col("x.s")).alias("score"))


# --- dates and summaries -----------------------------------------------------------------------------------------


def _date_rank() -> Column:
    """The first of DATE_PLACES that a node is; null for none."""
    out = F.lit(None).cast("int")
    for k, (tag, attribute, value) in reversed(list(enumerate(DATE_PLACES))):
        test = _classed(value) if attribute == "class" else _attr(attribute) == value if value else _attr(attribute) != ""
        out = F.when(test & (F.col("tag") == tag) if tag else test, k).otherwise(out)
    return out


def dates(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, pre, rank and date (text as it stands) of nodes that state a date of publication."""
    found = dom.below(tree.withColumn("rank", _date_rank()).where("rank IS NOT NULL"), tree, id_col, "_text")
    value = X.clean_text(F.coalesce(F.nullif(_attr("datetime"), F.lit("")), F.nullif(_attr("content"), F.lit("")), F.col("_text")))
    return found.select(id_col, "pre", "rank", value.alias("date")).where("date <> ''")


def publication_date(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col and date of each page that states one: the surest place, the first there."""
    return dates(tree, id_col).groupBy(id_col).agg(F.min_by("date", F.struct("rank", "pre")).alias("date"))


def card_details(tree: DataFrame, cards: DataFrame, id_col: str = "page_id") -> DataFrame:
    """cards (id_col, pre, place, title) with date and summary: of paragraphs, then of nodes of a summary's class, the first
    whose text is LEAST_SUMMARY characters or longer and not the title. Cards do not nest, so that the last card that began
    before a node is the only one that can hold it."""
    parts = dates(tree, id_col).select(id_col, "pre", F.lit("date").alias("_kind"), "rank", F.col("date").alias("value"))
    order = F.when(F.col("tag") == "p", 0).when(_classed("summary"), 1).when(_classed("excerpt"), 2).when(_classed("description"), 3)
    told = dom.below(tree.withColumn("rank", order).where("rank IS NOT NULL"), tree, id_col, "_text").select(id_col, "pre", F.lit("summary").alias("_kind"), "rank", X.clean_text(F.col("_text")).alias("value"))
    ends = tree.select(id_col, "pre", F.col("last").alias("_last"))
    held = cards.select(id_col, "pre", "place", "title").join(ends, [id_col, "pre"])
    every = parts.unionByName(told.where(F.length("value") >= LEAST_SUMMARY)).unionByName(held.select(id_col, "pre", "place", "title", "_last", F.lit("card").alias("_kind")), allowMissingColumns=True)
    card = F.last(F.when(F.col("_kind") == "card", F.struct("place", "title", "_last")), ignorenulls=True).over(Window.partitionBy(id_col).orderBy("pre", F.col("_kind") != "card").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = every.withColumn("_card", card).where((F.col("_kind") != "card") & (F.col("pre") <= F.col("_card._last")) & (F.col("value") != F.col("_card.title")))
    first = lambda kind: F.min_by(F.when(F.col("_kind") == kind, F.col("value")), F.when(F.col("_kind") == kind, F.struct("rank", "pre"))).alias(kind)
    got = within.groupBy(id_col, F.col("_card.place").alias("place")).agg(first("date"), first("summary"))
    return cards.join(got, [id_col, "place"], "left")


# --- options of variants -----------------------------------------------------------------------------------------


def options(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, axis, place, value, selected and available of the choices that a page offers: options of selects, and radio
    inputs of one name. An axis is named by the control's label, else its name; prompts and other noise are no choices."""
    own = lambda name: F.nullif(F.trim(_attr(name)), F.lit(""))
    labels = dom.below(tree.where((F.col("tag") == "label") & (_attr("for") != "")), tree, id_col, "_text").select(id_col, _attr("for").alias("_for"), F.regexp_replace(F.trim("_text"), r"\s*:$", "").alias("_label")).dropDuplicates([id_col, "_for"])
    picks = tree.where(F.col("tag") == "select").select(id_col, F.col("pre").alias("_at"), F.col("last").alias("_to"), F.coalesce(own("aria-label"), own("name"), own("id")).alias("_name"), own("id").alias("_for"), own("aria-label").isNotNull().alias("_said"))
    named = picks.join(labels, [id_col, "_for"], "left").select(id_col, F.col("_at").alias("pre"), F.when(F.col("_said"), F.col("_name")).otherwise(F.coalesce("_label", "_name")).alias("_axis"), "_to")
    # the select that an option stands in is the last that began before it and has not ended
    up = F.last("_s", ignorenulls=True).over(dom.in_order(id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met = tree.where(F.col("tag").isin("select", "option")).join(named, [id_col, "pre"], "left").withColumn("_s", F.when(F.col("_axis").isNotNull(), F.struct("_axis", "_to"))).withColumn("_in", up)
    chosen = dom.below(met.where((F.col("tag") == "option") & (F.col("pre") <= F.col("_in._to"))), tree, id_col, "_text").select(id_col, "pre", F.col("_in._axis").alias("_axis"), F.coalesce(F.nullif(X.clean_text(F.col("_text")), F.lit("")), own("value")).alias("value"), "attrs")
    radios = tree.where((F.col("tag") == "input") & (F.lower(_attr("type")) == "radio") & (_attr("name") != "")).select(id_col, "pre", _attr("name").alias("_axis"), own("id").alias("_for"), F.coalesce(own("aria-label"), own("data-value"), own("value")).alias("_own"), "attrs")
    radios = radios.join(labels, [id_col, "_for"], "left").select(id_col, "pre", "_axis", F.coalesce("_label", "_own").alias("value"), "attrs")
    every = chosen.unionByName(radios).where(~admission.option_noise(F.col("value")))
    gone = F.element_at("attrs", "disabled").isNotNull() | _attr("class").rlike(r"(?i)\b(?:disabled|sold-?out|unavailable|out-of-stock)\b") | F.lower("value").rlike(r"sold out|out of stock|unavailable")
    value = F.trim(F.regexp_replace("value", r"(?i)\s*[-–(]*\s*(?:sold out|out of stock|unavailable)\)?$", ""))
    said = every.select(id_col, "pre", admission.axis_key(F.col("_axis")).alias("axis"), value.alias("value"), (F.element_at("attrs", "selected").isNotNull() | F.element_at("attrs", "checked").isNotNull()).alias("selected"), (~gone).alias("available"))
    once = said.groupBy(id_col, "axis", "value").agg(F.min("pre").alias("pre"), F.max("selected").alias("selected"), F.max("available").alias("available"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(id_col, "axis").orderBy("pre"))).select(id_col, "axis", "place", "value", "selected", "available")


# --- long texts --------------------------------------------------------------------------------------------------

#: Our own defaults: texts and parts of texts that say nothing of the product.
LOW_SIGNAL = ["description", "details", "n/a", "none", "overview", "product details", "read more", "show more"]
LEGAL = [r"all rights reserved", r"\bterms (?:and conditions|of (?:use|service))\b", r"\bprivacy policy\b", r"^©"]
DISCLAIMERS = [r"colou?rs? may (?:vary|differ)", r"images? (?:are|is) for illustration", r"prices? (?:are|is) subject to change", r"we use cookies"]
#: Stands for line ends while white space is folded.
_LINE = "\ue001"
UI_TAILS = r"(?i)\s*(?:read|show|see|view) (?:more|less)\s*$"


def long_text(c: Column, title: Column) -> Column:
    """A description without what is none: chunks (sentences and lines) once each without regard to case, no legal lines and
    disclaimers, no rows of sizes, no title alone, no chunk that breaks off. Empty for JSON, rows of numbers, and texts that say
    nothing."""
    clean = F.regexp_replace(X.clean_text(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"[\r\n]+", _LINE)), UI_TAILS, "")
    chunks = F.transform(F.filter(F.split(clean, rf"(?<=[.!?])\s+|\s+:\s+|{_LINE}"), lambda p: F.trim(p) != ""), lambda p: F.trim(p))
    low = F.transform(chunks, lambda p: F.lower(p))
    sizes = r"(?i)^(?:(?:xxs|xs|s|m|l|xl|xxl|\d{1,3})[\s,/|-]+){2,}(?:xxs|xs|s|m|l|xl|xxl|\d{1,3})\.?$"

    def kept(p: Column, i: Column) -> Column:
        one = F.array_position(low, F.lower(p)) == i + 1
        law = F.lower(p).rlike("|".join(LEGAL + DISCLAIMERS))
        cut = p.rlike(r"(?:\.\.\.|…|\b(?:and|or|the|with|of|a))$")
        return one & ~law & ~p.rlike(sizes) & ~cut & (F.lower(p) != F.lower(F.trim(title)))

    flat = F.trim(F.replace(clean, F.lit(_LINE), F.lit(" ")))
    empty = flat.rlike(r"(?s)^(?:\{.*\}|\[.*\])$") | flat.rlike(r"^[\d\s.,;:/-]+$") | F.lower(flat).isin(*LOW_SIGNAL)
    return F.when(empty, "").otherwise(F.array_join(F.filter(chunks, kept), " "))

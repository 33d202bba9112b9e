"""What a page's tree of nodes tells: cards of a listing, the main text, Markdown, and which fields a page can give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import text as X
from ..functions import url as U
from ..sources import dom

HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
#: Our own defaults: words in a node's class, id or role that speak for and against a card.
CARD_HINTS = ["card", "product", "result", "listing", "tile", "item"]
CHROME_HINTS = ["nav", "menu", "footer", "header", "breadcrumb", "pagination", "promo", "cookie"]
#: Our own defaults: where the main text stands by name, and what never holds it.
MAIN_TAGS, MAIN_IDS, MAIN_CLASSES = ["article", "main"], ["content", "main-content", "article-content"], ["post", "entry-content", "article-body"]
ASIDE_TAGS = ["nav", "footer", "aside", "header", "form", "script", "style", "template", "noscript"]
_PRICE = r"(?:[$€£¥]\s?\d|\d[\d.,]*\s?(?:[$€£¥]|(?:USD|EUR|GBP)\b))"


def _attr(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", name), F.lit(""))


def _bucket(count: Column) -> Column:
    return F.when(count <= 0, "0").when(count == 1, "1").when(count <= 5, "2_5").otherwise("6_plus")


def cards(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, pre, place, signature, title and href of cards: siblings of one tag and shape, two or more under one parent,
    each with a link, outermost only. title is the card's first heading or strong text, else its first link's; the signature
    joins tag, hint of the class, buckets of links and images, price mark, tag of the title and shape of the link's address."""
    link, loud = (F.col("tag") == "a") & (_attr("href") != ""), F.col("tag").isin(*HEADINGS, "strong", "b")
    span = F.struct("tag", "start", "end")
    seen = tree.withColumn("_link", dom.next_below(link, F.struct(_attr("href").alias("href"), F.col("start").alias("start"), F.col("end").alias("end")), id_col)).withColumn("_loud", dom.next_below(loud, span, id_col))
    alike = F.count("*").over(Window.partitionBy(id_col, "parent", "tag", "shape"))
    card = seen.where(F.col("tag") != "#text").withColumn("_card", (alike > 1) & (F.col("links") > 0) & ~F.col("tag").isin("a", "nav", "header", "footer"))
    outer = card.withColumn("_inside", dom.inside(F.col("_card"), id_col)).where("_card AND NOT _inside")
    outer = dom.below(outer, tree, id_col, "_text").withColumn("place", F.row_number().over(dom.in_order(id_col)))
    of = lambda s: F.trim(F.substring("_text", s["start"] - F.col("start") + 1, s["end"] - s["start"]))
    title = F.coalesce(F.nullif(of(F.col("_loud")), F.lit("")), of(F.col("_link")))
    named = F.lower(F.concat_ws(" ", _attr("class"), _attr("id"), _attr("role"), _attr("aria-label")))
    hint = F.coalesce(*(F.when(named.contains(h), h) for h in CARD_HINTS), F.when(named.rlike("|".join(CHROME_HINTS)), "neg"), F.lit(""))
    href = F.col("_link.href")
    signature = F.concat_ws("|", "tag", hint, _bucket(F.col("links")), _bucket(F.col("images")), F.when(F.col("_text").rlike(_PRICE), "price").otherwise(""), F.coalesce(F.col("_loud.tag"), F.lit("")), U.shape_signature(href))
    return outer.select(id_col, "pre", "place", signature.alias("signature"), title.alias("title"), href.alias("href"))


def main_nodes(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One node a page, with how it was found and its characters of text and of links: the longest of those that are
    named as content (named); else the node with the most text in paragraphs directly under it, less its links (dense); else
    the root (page)."""
    ranked = tree.withColumn("_aside", dom.inside(F.col("tag").isin(*ASIDE_TAGS), id_col) | F.col("tag").isin(*ASIDE_TAGS)).where((F.col("tag") != "#text") & ~F.col("_aside"))
    named = F.col("tag").isin(*MAIN_TAGS) | (F.lower(_attr("role")) == "main") | F.lower(_attr("id")).isin(*MAIN_IDS) | F.arrays_overlap(F.split(F.lower(_attr("class")), r"\s+"), F.array(*map(F.lit, MAIN_CLASSES)))
    chars = F.col("end") - F.col("start")
    prose = F.when(F.col("tag").isin("p", "pre", "blockquote", "ul", "ol", "dl", "table"), chars - F.col("link_chars")).otherwise(0)
    # the paragraphs under each parent meet it by key
    under = ranked.groupBy(id_col, "parent").agg(F.sum(prose).alias("_prose")).where("_prose > 0").withColumnRenamed("parent", "pre")
    weighed = ranked.join(under, [id_col, "pre"], "left").withColumn("_prose", F.coalesce("_prose", F.lit(0)))
    kind = F.when(named & (chars > 0), 2).when(F.col("_prose") > 0, 1).otherwise(0)
    weight = F.when(kind == 2, chars).when(kind == 1, F.col("_prose")).otherwise(0)
    best = F.max_by(F.struct("pre", "last", "start", "end", "tag", chars.alias("chars"), "link_chars", F.element_at(F.array(*map(F.lit, ("page", "dense", "named"))), kind + 1).alias("found")), F.struct(kind, weight, -F.col("pre")))
    return weighed.groupBy(id_col).agg(best.alias("x")).select(id_col, "x.*")


def main_text(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """main_nodes() with the text below them."""
    return dom.below(main_nodes(tree, id_col), tree, id_col, "content")


# --- Markdown ----------------------------------------------------------------------------------------------------

#: Stand for spaces and line ends that are kept as they are.
_SPACE, _LINE = "\ue000", "\ue001"


def _opened(base: Column) -> Column:
    """What stands where an element opens, or a text."""
    tag = F.col("tag")
    kept = F.translate(F.col("text"), " \n", _SPACE + _LINE)
    plain = F.regexp_replace("text", r"\s+", " ")
    code = F.concat(F.lit("\n\n```"), F.regexp_extract(_attr("class"), r"\blanguage-(\w+)", 1), F.lit(_LINE))
    image = F.concat(F.lit("!["), _attr("alt"), F.lit("]("), V.absolute_url(base, F.coalesce(F.nullif(_attr("src"), F.lit("")), _attr("data-src"))), F.lit(")"))
    item = F.concat(F.lit("\n"), F.repeat(F.lit(_SPACE * 2), F.col("lists") - 1), F.when(F.col("_above") == "ol", F.concat(F.col("nth").cast("string"), F.lit(". "))).otherwise("- "))
    return (
        F.when(tag == "#text", F.when(F.col("in_pre"), kept).otherwise(plain))
        .when(tag.isin(*HEADINGS), F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" ")))
        .when(tag.isin("strong", "b"), "**")
        .when(tag.isin("em", "i"), "*")
        .when((tag == "code") & ~F.col("in_pre"), "`")
        .when(tag == "pre", code)
        .when(tag == "li", item)
        .when(tag.isin("ul", "ol") & (F.col("lists") > 0), "")
        .when(tag == "br", "\n")
        .when(tag == "hr", "\n\n---\n\n")
        .when(tag == "blockquote", "\n\n> ")
        .when((tag == "a") & (_attr("href") != ""), "[")
        .when((tag == "img") & (F.concat(_attr("src"), _attr("data-src")) != ""), image)
        .when(tag == "tr", "\n|")
        .when(tag.isin("td", "th"), " ")
        .when(tag.isin("p", "div", "section", "article", "main", "ul", "ol", "dl", "table", "figure", "details", "summary", "dt", "dd"), "\n\n")
        .otherwise("")
    )


def _closed(base: Column) -> Column:
    """What stands where an element ends."""
    tag = F.col("tag")
    # a table's first row is its head
    head = F.when((F.col("nth") == 1) & ((F.col("_above") != "tbody") | (F.col("_above_child") == 1)) & (F.col("_above") != "tfoot"), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("children")))).otherwise("")
    return (
        F.when(tag.isin("strong", "b"), "**")
        .when(tag.isin("em", "i"), "*")
        .when((tag == "code") & ~F.col("in_pre"), "`")
        .when(tag == "pre", f"{_LINE}```\n\n")
        .when((tag == "a") & (_attr("href") != ""), F.concat(F.lit("]("), V.absolute_url(base, _attr("href")), F.lit(")")))
        .when(tag == "tr", head)
        .when(tag.isin("td", "th"), " |")
        .when(tag.isin("ul", "ol") & (F.col("lists") > 0), "")
        .when(tag.isin(*HEADINGS, "p", "div", "section", "article", "main", "ul", "ol", "dl", "table", "blockquote", "figure", "details", "summary", "dt", "dd"), "\n\n")
        .otherwise("")
    )


def markdown(tree: DataFrame, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col and markdown of each page's main node: headings, paragraphs, lists, links, images, code, tables and stress.

    Elements give a piece where they open and one where they close; pieces in document order, the inner before the outer where
    both close, are the text. A page's pieces meet in one row, which is bounded by the page."""
    main = main_nodes(tree, id_col).select(id_col, F.col("pre").alias("_from"), F.col("last").alias("_to"))
    quiet = dom.inside(F.col("tag").isin("script", "style", "template", "noscript", "nav", "footer", "form"), id_col) | F.col("tag").isin("script", "style", "template", "noscript", "nav", "footer", "form")
    above = tree.select(id_col, F.col("pre").alias("parent"), F.col("tag").alias("_above"), F.col("child").alias("_above_child"))
    within = tree.withColumn("_quiet", quiet).where(~F.col("_quiet")).join(main, id_col).where("pre BETWEEN _from AND _to")
    within = within.join(above, [id_col, "parent"], "left").join(pages.select(id_col, F.col(url_col).alias("_url")), id_col)
    # order: place, ends after what opens there, the deeper end first
    pieces = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("ends"), F.lit(0).alias("inner"), _opened(F.col("_url")).alias("piece")), F.struct(F.col("last").alias("at"), F.lit(1).alias("ends"), (-F.col("pre")).alias("inner"), _closed(F.col("_url")).alias("piece")))
    joined = within.select(id_col, F.inline(pieces)).where("piece <> ''").groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ends", "inner", "piece"))), lambda p: p["piece"]), "").alias("_text"))
    text = F.regexp_replace("_text", r"[ \t]+", " ")
    text = F.regexp_replace(text, r" ?\n ?", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.translate(F.regexp_replace(text, r"^\s+|\s+$", ""), _SPACE + _LINE, " \n")
    return joined.select(id_col, text.alias("markdown"))


# --- extractability ----------------------------------------------------------------------------------------------


def sections(tree: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id_col, label, and chars of text between each heading and the next one, or the end of the heading's parent."""
    ends = tree.select(id_col, F.col("pre").alias("parent"), F.col("end").alias("_end"))
    heads = tree.where(F.col("tag").isin(*HEADINGS))
    following = F.lead("start").over(dom.in_order(id_col))
    placed = heads.withColumn("_next", following).join(ends, [id_col, "parent"])
    labelled = dom.below(placed, tree, id_col, "_label")
    return labelled.select(id_col, "pre", X.clean_text(F.col("_label")).alias("label"), (F.least(F.coalesce("_next", "_end"), F.col("_end")) - F.col("end")).alias("chars")).where("label <> ''")


def extractability(tree: DataFrame, found: DataFrame, aliases: DataFrame, requested: list[str], id_col: str = "page_id") -> DataFrame:
    """id_col, section_fields, selector_fields, matched (of those requested) and verified, for each page: fields with a section
    of text under a heading that is the field's name or an alias (aliases: alias, field), and fields for which found (id_col,
    selector, value) has values."""
    by_section = sections(tree, id_col).where("chars > 1").withColumn("alias", X.field_key(F.col("label"))).join(F.broadcast(aliases), "alias").select(id_col, "field", F.lit("section").alias("source"))
    by_selector = found.select(id_col, F.col("selector").alias("field"), F.lit("selector").alias("source"))
    both = by_section.unionByName(by_selector).groupBy(id_col).agg(*(F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("field")))).alias(f"{s}_fields") for s in ("section", "selector")))
    out = tree.where("pre = 0").select(id_col).join(both, id_col, "left").select(id_col, *(F.coalesce(f"{s}_fields", F.array().cast("array<string>")).alias(f"{s}_fields") for s in ("section", "selector")))
    matched = F.array_sort(F.array_intersect(F.array(*map(F.lit, requested)).cast("array<string>"), F.array_union("section_fields", "selector_fields")))
    return out.withColumn("matched", matched).withColumn("verified", (F.size("matched") > 0) | ((F.lit(len(requested)) == 0) & (F.size("section_fields") > 0)))

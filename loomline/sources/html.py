"""Pages as rows. Regular expressions cover what needs no tree; structured data come from the bundle of one parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import bundle


def bare(html: Column) -> Column:
    """Without comments, scripts and styles, which may hold tags in strings."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")


def first_heading(html: Column) -> Column:
    return X.clean_text(F.regexp_extract(bare(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def content_record(pages: DataFrame) -> DataFrame:
    html = F.col("html")
    words = X.word_count(F.col("content")).cast("long")
    out = pages.select(
        "page_id",
        "url",
        first_heading(html).alias("title"),
        F.regexp_extract(html, r'(?i)<html[^>]* lang="([^"]*)"', 1).alias("language"),
        F.regexp_count(bare(html), F.lit("(?i)<p[ >]")).cast("long").alias("paragraphs"),
        X.strip_tags(F.regexp_extract(bare(html), r"(?is)<article[^>]*>(.*)</article>", 1)).alias("content"),
    )
    return out.withColumn("word_count", words).withColumn("reading_time", X.reading_minutes(words).cast("long"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, href and label of each anchor."""
    tags = pages.select("page_id", F.explode(F.regexp_extract_all(bare(F.col("html")), F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'), 0)).alias("tag"))
    return tags.select("page_id", F.regexp_extract("tag", r'(?i)href="([^"]*)"', 1).alias("href"), X.clean_text(F.regexp_extract("tag", r"(?is)>(.*)</a>", 1)).alias("label"))


def tags(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.regexp_extract_all(bare(F.col("html")), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1)).alias("tag")).select(F.lower("tag").alias("tag"))


#: Our own defaults.
BLOCK_MARKERS = ["captcha", "access denied", "verify you are human", "unusual traffic"]


def block_flags(pages: DataFrame) -> DataFrame:
    """Markers of a block page, words of text, and what they say."""
    low = F.lower("html")
    markers = sum((low.contains(m).cast("int") for m in BLOCK_MARKERS), F.lit(0))
    out = pages.select("page_id", markers.alias("markers"), X.word_count(X.strip_tags(F.col("html"))).cast("long").alias("words"))
    return out.withColumn("blocked", (F.col("markers") >= 2) | ((F.col("markers") >= 1) & (F.col("words") < 120))).withColumn("shell", F.col("words") < 20)


def _kind(pages: DataFrame, kind: str) -> DataFrame:
    return bundle.bundle(pages).where(F.col("kind") == kind)


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, table, row and cells (header -> value) of tables with a header, two columns and three rows or more."""
    parsed = F.from_json("payload", "table int, row int, cells map<string,string>")
    return _kind(pages, "table").select("page_id", parsed.alias("t")).select("page_id", "t.*")


def structured(pages: DataFrame) -> DataFrame:
    """page_id and payload (JSON text) of JSON-LD nodes: graphs laid out, references by @id resolved once, own keys first."""
    return _kind(pages, "jsonld").select("page_id", "payload")


def open_graph(pages: DataFrame) -> DataFrame:
    """page_id and meta (property -> content) of og: and twitter: tags."""
    return _kind(pages, "open_graph").select("page_id", F.from_json("payload", "map<string,string>").alias("meta"))


def microdata(pages: DataFrame) -> DataFrame:
    """page_id, property and value of itemprop tags: the content attribute, else the text below."""
    return _kind(pages, "property").select("page_id", F.from_json("payload", "property string, value string").alias("p")).select("page_id", "p.*")


def embedded(pages: DataFrame) -> DataFrame:
    """page_id, kind (script or state), name and payload (JSON text) of scripts of JSON types, and of what scripts assign."""
    return bundle.bundle(pages).where(F.col("kind").isin("script", "state")).select("page_id", "kind", "name", "payload")

"""Queries over the HTML of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import html as H
from .registry import registered, table

_BARE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"


def _unescaped(c: str) -> str:
    for name, value in X._ENTITIES.items():
        v = value.replace("'", "''")
        c = f"replace({c}, '{name}', '{v}')"
    return c


def _clean(c: str) -> str:
    return rf"trim(regexp_replace({_unescaped(c)}, '[\t\n\v\f\r ]+', ' ', 'g'))"


def _text(c: str) -> str:
    bare = rf"regexp_replace({c}, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"
    return _clean(rf"regexp_replace({bare}, '(?s)<[^>]+>', ' ', 'g')")


_TITLE = _clean(rf"regexp_extract({_BARE}, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_ARTICLE = _text(rf"regexp_extract({_BARE}, '(?is)<article[^>]*>(.*)</article>', 1)")
_WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))"


@registered(
    f"""WITH t AS (SELECT page_id, {_TITLE} AS title, regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) AS language,
      len(regexp_extract_all({_BARE}, '(?i)<p[ >]'))::BIGINT AS paragraphs, {_ARTICLE} AS content FROM pages)
    SELECT page_id, title, language, paragraphs, {_WORDS.format("content")}::BIGINT AS word_count, ceil({_WORDS.format("content")} / 200)::BIGINT AS reading_time, sha256(content) AS content_digest FROM t"""
)
def page_content_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = H.content_record(table(spark, sf_dir, "pages"))
    return record.select("page_id", "title", "language", "paragraphs", "word_count", "reading_time", F.sha2("content", 256).alias("content_digest"))


@registered(
    f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>')) AS tag FROM pages)
    SELECT page_id, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS href, {_clean("regexp_extract(tag, '(?is)>(.*)</a>', 1)")} AS label, count(*) AS n FROM a GROUP BY 1, 2, 3"""
)
def page_links_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.links(table(spark, sf_dir, "pages")).groupBy("page_id", "href", "label").agg(F.count("*").alias("n"))


@registered(
    f"""WITH t AS (SELECT unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages)
    SELECT lower(tag) AS tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10"""
)
def tag_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = H.tags(table(spark, sf_dir, "pages"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(10)


_WEAK = "(contains(low, 'captcha')::INT + contains(low, 'access denied')::INT + contains(low, 'verify you are human')::INT + contains(low, 'unusual traffic')::INT)"


@registered(
    f"""WITH t AS (SELECT page_id, lower(html) AS low, {_WORDS.format(_text("html"))}::BIGINT AS words FROM pages)
    SELECT page_id, {_WEAK} AS markers, words, {_WEAK} >= 2 OR ({_WEAK} >= 1 AND words < 120) AS blocked, words < 20 AS shell FROM t"""
)
def blocked_page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.block_flags(table(spark, sf_dir, "pages"))


@registered(
    f"""SELECT page_id, coalesce(nullif({_TITLE}, ''), 'untitled') AS title, sha256(lower({_TITLE}) || chr(31) || lower(trim(url))) AS fingerprint FROM pages"""
)
def page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = H.first_heading(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", X.first_present(title, F.lit("untitled")).alias("title"), F.sha2(F.concat(F.lower(title), F.lit("\x1f"), F.lower(F.trim("url"))), 256).alias("fingerprint"))

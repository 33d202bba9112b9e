"""Files as rows: URL lists, sitemaps, raw JSON bodies, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import url as U
from . import store


def url_list(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """Distinct non-empty URLs of a CSV with a header, in their first order."""
    rows = spark.read.option("header", True).csv(path).select(F.trim(column).alias("url"), F.monotonically_increasing_id().alias("place"))
    return rows.where(~text.is_empty(F.col("url"))).groupBy("url").agg(F.min("place").alias("place")).orderBy("place").select("url")


def sitemap(documents: DataFrame, keyword: str | None = None) -> DataFrame:
    """url, place, loc and kind (page, or sitemap for an index's children) of sitemap documents (columns url, xml)."""
    entries = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?(url|sitemap)>.*?</(?:\w+:)?(?:url|sitemap)>"), 0)
    one = documents.select("url", F.posexplode(entries).alias("place", "entry"))
    loc = text.clean_text(F.regexp_replace(F.regexp_extract("entry", r"(?is)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>", 1), r"<!\[CDATA\[|\]\]>", ""))
    out = one.select("url", "place", loc.alias("loc"), F.when(F.col("entry").rlike(r"(?i)^<(\w+:)?sitemap>"), "sitemap").otherwise("page").alias("kind")).where("loc <> ''")
    return out.where(F.lower("loc").contains(keyword.lower())) if keyword else out


def sitemap_pages(roots: DataFrame, documents: DataFrame, keyword: str | None = None, most: int | None = None, most_levels: int = 20) -> DataFrame:
    """root, loc and depth of the pages that sitemaps name: roots (url) are opened in documents (url, xml), then the sitemaps
    that indexes name, level by level until a level has none that is new. A sitemap is opened once for each root, so that
    indexes that name one another end. keyword and most (in the order of level and place) narrow the pages of each root."""
    entries = store.kept(sitemap(documents), "sitemaps")
    children, pages = entries.where("kind = 'sitemap'"), entries.where("kind = 'page'")
    frontier = roots.select(F.col("url").alias("root"), "url").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    for level in range(1, most_levels + 1):
        found = frontier.join(children, "url").select("root", F.col("loc").alias("url")).distinct()
        frontier = store.kept(found.join(seen.select("root", "url"), ["root", "url"], "left_anti").withColumn("depth", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    out = seen.join(pages, "url").groupBy("root", "loc").agg(F.min(F.struct("depth", "url", "place")).alias("x")).select("root", "loc", "x.depth", F.col("x.url").alias("_url"), F.col("x.place").alias("_place"))
    if keyword:
        out = out.where(F.lower("loc").contains(keyword.lower()))
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("root").orderBy("depth", "_url", "_place", "loc"))).where(F.col("_n") <= most)
    return out.select("root", "loc", "depth")


def json_records(bodies: DataFrame, fields: list[str]) -> DataFrame:
    """Records of raw JSON bodies (columns url, body): an object, a list, or a list under data, items, results or records.
    Bodies that are no JSON give no rows; of equal (url, title) pairs of a body the first is kept."""
    body = F.trim(F.regexp_replace("body", "^\ufeff", ""))
    parsed = bodies.where(body.rlike(r"^[{\[]")).select("url", F.try_parse_json(body).alias("v")).where("v IS NOT NULL")
    as_list = lambda path: F.try_variant_get("v", path, "array<variant>")
    rows = F.coalesce(as_list("$"), *(as_list(f"$.{k}") for k in ("data", "items", "results", "records")), F.array("v"))
    out = parsed.select("url", F.posexplode(rows).alias("_place", "r")).select(F.col("url").alias("source_url"), "_place", *(F.try_variant_get("r", f"$.{f}", "string").alias(f) for f in fields))
    keys = ["source_url", *([c for c in ("url", "title") if c in fields] or fields)]
    first = F.min_by(F.struct(*fields), "_place").alias("_first")
    return out.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(first).select(F.col("_source_url").alias("source_url"), "_first.*")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """brand (normalised) and domain of a tab-separated registry without a header."""
    rows = spark.read.option("sep", "\t").schema("name string, domain string").csv(path)
    return rows.select(text.brand(F.col("name")).alias("brand"), U.domain_key(F.col("domain")).alias("domain")).where("brand <> ''").distinct()


def allowed(robots: DataFrame, urls: DataFrame) -> DataFrame:
    """url and allowed: of the rules that hold for `*` at the URL's host, the longest whose pattern fits the path decides, and
    of equally long ones one that allows; no rules allow all. Agents named in lines that follow one another share the rules
    below them. In a pattern `*` stands for any characters and a `$` at its end for the end. robots: host and body."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r?\n")).alias("place", "line"))
    pair = lines.select("host", "place", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("name"), F.trim(F.regexp_extract("line", r"^[^:]*:([^#]*)", 1)).alias("value"))
    pair = pair.where(F.col("name").isin("user-agent", "allow", "disallow"))
    in_order = Window.partitionBy("host").orderBy("place")
    # a group begins where an agent is named that no agent's line stands before
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(in_order), F.lit("")) != "user-agent")
    grouped = pair.withColumn("group", F.sum(begins.cast("int")).over(in_order))
    for_all = F.max((F.col("name") == "user-agent") & (F.col("value") == "*")).over(Window.partitionBy("host", "group"))
    rules = grouped.withColumn("all", for_all).where(F.col("all") & (F.col("name") != "user-agent") & (F.col("value") != ""))
    quoted = F.regexp_replace(F.regexp_replace("value", r"\$$", ""), r"([\\^$.|?+(){}\[\]])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*+", ".*"), F.when(F.col("value").endswith("$"), "$").otherwise(""))
    rules = rules.select("host", "name", pattern.alias("pattern"), F.length("value").alias("n"))
    target = urls.select("url", U.hostname(F.col("url")).alias("_host"), F.concat(U.path(F.col("url")), F.when(F.col("url").contains("?"), F.concat(F.lit("?"), U.query(F.col("url")))).otherwise("")).alias("_path"))
    met = target.join(rules, (F.col("_host") == F.col("host")) & F.expr("_path RLIKE pattern"), "left")
    best = F.max(F.when(F.col("n").isNotNull(), F.struct("n", (F.col("name") == "allow").alias("yes")))).alias("b")
    return met.groupBy("url").agg(best).select("url", F.coalesce("b.yes", F.lit(True)).alias("allowed"))

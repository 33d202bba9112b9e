"""Queries over typed fields: texts that Spark derives from the rows of the tables, read back as records are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import money
from .registry import registered, table
from .urls import _HOST, _PARAMS, _PATH

_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)"


def _price(c: str = "p_retailprice") -> F.Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _say(sql: str) -> F.Column:
    """A text of a row, said in SQL that both engines read alike."""
    return F.expr(sql.replace("VARCHAR", "STRING"))


_MENTION = f"CASE WHEN p_partkey % 4 = 0 THEN 'was $' || {_PRICE} || ' now $' || CAST(p_size AS VARCHAR) WHEN p_partkey % 4 = 1 THEN 'eur ' || {_PRICE} || ' each' WHEN p_partkey % 4 = 2 THEN p_name || ' ' || {_PRICE} ELSE {_PRICE} || ' € or £' || CAST(p_size AS VARCHAR) || '0' END"
_LAST = "list_extract(regexp_extract_all({}, '{}'), -1)"


@registered(f"SELECT p_partkey, coalesce({_LAST.format('t', V.MARKED_PRICE)}, {_LAST.format('upper(t)', V.CODED_PRICE)}) AS price FROM (SELECT p_partkey, {_MENTION} AS t FROM part)")
def price_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.price_mention(_say(_MENTION)).alias("price"))


@registered(
    f"""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN '$' || {_PRICE} ELSE {_PRICE} END WHEN p_size % 3 = 1 THEN '$' || {_PRICE} ELSE {_PRICE} END AS price FROM part"""
)
def price_by_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price of a struct whose preferred fields may be empty, negative or without a sign of money."""
    first = F.when(F.col("p_size") % 3 == 0, F.lit("-5")).when(F.col("p_size") % 3 == 1, F.lit(""))
    second = _price()
    third = F.when((F.col("p_size") % 3 == 1) | ((F.col("p_size") % 3 == 0) & (F.col("p_size") % 2 == 0)), F.concat(F.lit("$"), _price()))
    return table(spark, sf_dir, "part").select("p_partkey", V.preferred_price(first, second, third).alias("price"))


@registered(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(e AS DOUBLE) END AS amount, CASE WHEN l_linenumber % 3 = 0 THEN CAST(e AS DOUBLE) END AS price_min,
      CASE WHEN l_linenumber % 3 = 0 THEN CAST(e + 10 AS DOUBLE) END AS price_max, CASE WHEN l_linenumber % 3 = 1 THEN CAST(d AS DOUBLE) END AS original_price, 'USD' AS currency
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS e, CAST(l_extendedprice AS DECIMAL(18,2)) + 5 AS d FROM lineitem)"""
)
def price_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{amount, currency, original} of a price text, or {min, max} of a range."""
    price = _price("l_extendedprice")
    more = lambda n: (F.col("l_extendedprice").cast("decimal(18,2)") + n).cast("decimal(18,2)").cast("string")
    raw = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("$"), price, F.lit(" - $"), more(10))).otherwise(F.concat(F.lit("USD "), price))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"), F.when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("$"), more(5))).alias("original"))
    ends = F.regexp_extract_all("raw", F.lit(r"\d[\d,]*(?:\.\d+)?"), 0)
    ranged = F.col("raw").rlike(r"^\D*\d[\d,.]*\s*-\s*\D*\d[\d,.]*$")
    end = lambda k: F.when(ranged, F.replace(F.get(ends, F.lit(k)), F.lit(","), F.lit("")).try_cast("double"))
    return rows.select("l_orderkey", "l_linenumber", F.when(~ranged, money.price_text(F.col("raw")).try_cast("double")).alias("amount"), end(0).alias("price_min"), end(1).alias("price_max"), money.price_text(F.col("original")).try_cast("double").alias("original_price"), money.currency(F.col("raw")).alias("currency"))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey * 1000 + 7 END AS n FROM orders")
def whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.concat(F.lit("about "), F.col("o_orderkey"), F.lit(",007.90 in stock")))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.whole_number(said).alias("n"))


@registered(
    """SELECT l_orderkey, l_linenumber, CASE WHEN v % 10 = 5 THEN v // 10 + (v // 10) % 2 WHEN v % 10 > 5 THEN v // 10 + 1 ELSE v // 10 END / 100.0::DOUBLE AS rating
      FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000 + 5 * l_linenumber AS BIGINT) AS v FROM lineitem)"""
)
def ratings_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit(" "), ((F.col("l_quantity") * 1000 + 5 * F.col("l_linenumber")).cast("decimal(18,0)") / F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,4)").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.rating(said).alias("rating"))


@registered("SELECT l_orderkey AS run_id, CAST(floor(count(*) FILTER (l_linestatus = 'F') * 100 / count(*)) AS BIGINT) AS percent FROM lineitem GROUP BY 1")
def run_progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("total"))
    return done.select("run_id", V.percent(F.col("done"), F.col("total")).alias("percent"))


_SALARY = "CASE WHEN o_orderkey % 3 = 0 THEN '{\"currency\":\"EUR\",\"value\":{\"minValue\":' || CAST(o_custkey AS VARCHAR) || ',\"maxValue\":' || CAST(o_custkey + 100 AS VARCHAR) || ',\"unitText\":\"YEAR\"}}' WHEN o_orderkey % 3 = 1 THEN '{\"salaryCurrency\":\"USD\",\"value\":' || CAST(o_custkey AS VARCHAR) || '}' ELSE '{\"value\":\"on request\"}' END"


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'EUR ' || o_custkey || ' - ' || (o_custkey + 100) || ' YEAR' WHEN o_orderkey % 3 = 1 THEN 'USD ' || o_custkey ELSE 'on request' END AS salary FROM orders")
def salary_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salaries of job payloads: currency, range and unit, or the plain value."""
    at = lambda path: F.get_json_object("payload", path)
    currency = F.coalesce(at("$.currency"), at("$.salaryCurrency"), at("$.currencyCode"))
    ranged = F.concat_ws(" ", currency, F.concat_ws(" - ", at("$.value.minValue"), at("$.value.maxValue")), at("$.value.unitText"))
    plain = F.concat_ws(" ", currency, at("$.value"))
    return table(spark, sf_dir, "orders").select("o_orderkey", _say(_SALARY).alias("payload")).select("o_orderkey", F.when(at("$.value.minValue").isNotNull(), ranged).otherwise(plain).alias("salary"))


@registered("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS stock FROM lineitem")
def stock_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a variant's fields that holds a whole number."""
    n = F.col("l_quantity").cast("long").cast("string")
    payload = F.when(F.col("l_linenumber") % 3 == 0, F.to_json(F.struct(F.lit("many").alias("quantity")))).when(F.col("l_linenumber") % 3 == 1, F.to_json(F.struct(F.lit("").alias("stock_quantity"), n.alias("inventory_quantity")))).otherwise(F.to_json(F.struct(n.cast("long").alias("quantity"))))
    read = [F.trim(F.get_json_object("payload", f"$.{key}")).try_cast("long") for key in ("stock_quantity", "inventory_quantity", "quantity")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", payload.alias("payload")).select("l_orderkey", "l_linenumber", F.coalesce(*read).alias("stock"))


_STYLED = "'FV' || CAST(p_partkey + 5000 AS VARCHAR) || '-002 ' || p_name || ' 390AB' || CAST(p_size AS VARCHAR) || '77 ab12'"


@registered(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower({_STYLED}), '[a-z]{{2,}}[0-9]{{3,}}'), lambda m: length(m) >= 5))), ' ') AS codes FROM part")
def style_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.style_codes(_say(_STYLED), F.lit("0012345678905")).alias("codes"))


_MADE = "CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) || '% Cotton, ' || CAST(100 - p_size AS VARCHAR) || ' percent poly-blend and 3% cotton' ELSE lower(p_type) END"


@registered("SELECT material, count(*) AS n FROM (SELECT unnest(CASE WHEN p_size % 2 = 0 THEN ['cotton', 'poly-blend'] ELSE [] END) AS material FROM part) GROUP BY 1")
def material_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.explode(V.materials(_say(_MADE))).alias("material")).groupBy("material").agg(F.count("*").alias("n"))


@registered("SELECT p_partkey, list_filter(list_transform(string_split_regex(p_brand || ' / ' || p_type || ' ;; ' || p_name || '|', '[,/|;·]'), lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '') AS parts FROM part")
def multi_values_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.split_values(F.concat_ws(" / ", "p_brand", F.concat("p_type", F.lit(" ;; "), "p_name", F.lit("|")))).alias("parts"))


@registered("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_brand END AS title FROM part")
def halved_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", "p_name", "p_name")).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", V.halved(said).alias("title"))


@registered(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'women' WHEN 1 THEN 'men' WHEN 2 THEN c_mktsegment END AS gender,
      CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey::VARCHAR, 12, '0') END AS barcode, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'K' || c_custkey END AS sku FROM customer"""
)
def codes_and_gender(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    said = F.when(key % 4 == 0, " Womens ").when(key % 4 == 1, "male").when(key % 4 == 2, F.col("c_mktsegment")).otherwise(" ")
    digits = F.lpad(key.cast("string"), 12, "0")
    code = F.when(key % 3 == 0, F.concat(F.substring(digits, 1, 6), F.lit(" - "), F.substring(digits, 7, 6))).when(key % 3 == 1, F.substring(digits, 1, 7)).otherwise(F.concat(digits, F.lit("x")))
    sku = F.when(key % 5 == 0, F.concat(F.lit("draft-"), F.lpad(key.cast("string"), 10, "0"))).when(key % 5 == 1, F.concat(F.lit("Draft_K"), key)).otherwise(F.concat(F.lit(" K"), key))
    return table(spark, sf_dir, "customer").select("c_custkey", V.gender(said).alias("gender"), V.barcode(code).alias("barcode"), V.sku(sku).alias("sku"))


@registered("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' USB Hub' AS title FROM part")
def title_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.title_case(F.concat("p_name", F.lit("  USB hub "))).alias("title"))


@registered("SELECT p_partkey, [p_brand, p_name] AS texts FROM part WHERE lower(p_brand) <> lower(p_name)")
def ordered_distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", V.distinct_texts(F.array("p_brand", F.lower("p_brand"), F.lit(" "), "p_name", F.upper("p_name"))).alias("texts"))


@registered("SELECT c_custkey, n_name || ', ' || r_name AS location FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def location_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of customers from their parts, of which one repeats and one may be missing."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select("c_custkey", V.location(F.col("n_name"), F.lower("n_name"), F.lit(None).cast("string"), F.col("r_name")).alias("location"))


# --- links and images --------------------------------------------------------------------------------------------

_REF = "CASE page_id % 8 WHEN 0 THEN '//cdn.example.com/a.png' WHEN 1 THEN '/img/' || CAST(page_id AS VARCHAR) || '.png?w=2' WHEN 2 THEN '#top' WHEN 3 THEN '?page=2' WHEN 4 THEN './next.html' WHEN 5 THEN 'item-' || CAST(page_id AS VARCHAR) || '.html#x' WHEN 6 THEN 'shop.example.com/x' ELSE 'mailto:a@example.com' END"
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_PLAIN = "regexp_extract(url, '^([^?#]*)', 1)"
_FOLDER = f"CASE WHEN {_PATH} = '' THEN '/' ELSE regexp_replace({_PATH}, '[^/]*$', '') END"


@registered(
    f"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN regexp_extract(url, '^([a-z]+:)', 1) || ref WHEN 1 THEN {_ORIGIN} || ref WHEN 2 THEN regexp_extract(url, '^([^#]*)', 1) || ref WHEN 3 THEN {_PLAIN} || ref
      WHEN 4 THEN {_ORIGIN} || {_FOLDER} || 'next.html' WHEN 5 THEN {_ORIGIN} || {_FOLDER} || ref WHEN 6 THEN 'https://' || ref ELSE ref END AS absolute FROM (SELECT page_id, trim(url) AS url, {_REF} AS ref FROM pages)"""
)
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", V.absolute_url(F.col("url"), _say(_REF)).alias("absolute"))


@registered(
    """SELECT p_partkey, '/i/' || p_partkey || '.jpg' AS image, 3::BIGINT AS n, 800::BIGINT AS width FROM part UNION ALL SELECT p_partkey, '/i/' || p_partkey || '-b.png?v=2', 1, 300 FROM part"""
)
def images_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of srcset texts: one row an image whatever its size, with the widest copy."""
    key = F.col("p_partkey").cast("string")
    said = F.concat(F.lit("/i/"), key, F.lit(".jpg?w=200 200w, /I/"), key, F.lit(".jpg?width=400&q=80#x 400w,  /i/"), key, F.lit(".jpg 800w,, /i/"), key, F.lit("-b.png?v=2&w=300 300w, /p/"), key, F.lit(".html 2x"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(said, ",")).alias("part"))
    found = parts.select("p_partkey", F.explode(V.srcset(F.col("part"))).alias("url"), F.regexp_extract("part", r"\s(\d+)w", 1).try_cast("long").alias("w"))
    return found.where(V.is_image(F.col("url"))).groupBy("p_partkey", V.image_key(F.col("url")).alias("image")).agg(F.count("*").alias("n"), F.max("w").alias("width"))


@registered("SELECT page_id, len(list_distinct(regexp_extract_all(html, 'https?://[^\\s\"''<>)]+')))::BIGINT AS n FROM pages")
def urls_in_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(V.urls_in(F.col("html"))).cast("long").alias("n"))


@registered(
    f"""SELECT page_id, nullif(array_to_string(list_filter(list_transform(parts[1 : len(parts) - 1], lambda p: trim(regexp_replace(p, '[-_]+', ' ', 'g'))), lambda p: NOT regexp_matches(p, '^[0-9]*$')), ' > '), '') AS category
      FROM (SELECT page_id, list_filter(string_split({_PATH}, '/'), lambda p: p <> '') AS parts FROM pages)"""
)
def url_category_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", V.category_path(F.col("url")).alias("category"))


@registered(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'GBP' WHEN page_id % 3 = 1 THEN 'EUR' END AS currency FROM pages")
def currency_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Currencies that the endings of hosts tell; the pages' own hosts get country endings."""
    ending = F.when(F.col("page_id") % 3 == 0, ".co.uk").when(F.col("page_id") % 3 == 1, ".de:8080").otherwise(".org")
    return table(spark, sf_dir, "pages").select("page_id", V.host_currency(F.regexp_replace("url", r"^(https?://[^/:?#]*)", F.concat(F.lit("$1"), ending))).alias("currency"))


_ALLOWED, _DENIED = ["example.com", "example.org"], ["blog.example.com"]
_UNDER = " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in _ALLOWED)


@registered(f"WITH p AS (SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS h FROM pages) SELECT h AS host, count(*) AS n FROM p WHERE NOT (h = '{_DENIED[0]}' OR ends_with(h, '.{_DENIED[0]}')) AND NOT ({_UNDER}) GROUP BY 1")
def hosts_outside_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, but for those under allowed or denied domains."""
    from ..functions import url as U

    host = F.regexp_replace(U.hostname(F.col("url")), r"^www\.", "")
    under = lambda d: (F.col("host") == d) | F.col("host").endswith(f".{d}")
    out = table(spark, sf_dir, "pages").select(host.alias("host"))
    for domain in [*_ALLOWED, *_DENIED]:
        out = out.where(~under(domain))
    return out.groupBy("host").agg(F.count("*").alias("n"))


@registered(f"SELECT page_id FROM pages WHERE regexp_matches(lower(url), '^https?://(www\\.)?[a-z]\\.?[a-z0-9]*[0-9]') OR len({_PARAMS}) > 0")
def pages_by_url_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import url as U

    low = F.lower("url")
    return table(spark, sf_dir, "pages").where(low.rlike(r"^https?://(www\.)?[a-z]\.?[a-z0-9]*[0-9]") | (F.size(F.filter(F.split(U.query(F.col("url")), "&"), lambda p: p != "")) > 0)).select("page_id")


@registered("SELECT p_partkey, CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END::DOUBLE AS overlap FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' widget'), ' ')) AS b FROM part)")
def weighted_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a title's tokens that its category has."""
    a, b = (F.array_distinct(F.split(F.lower(c), " ")) for c in (F.col("p_name"), F.concat("p_type", F.lit(" widget"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0).alias("overlap"))


@registered("SELECT o_orderkey, o_orderdate - to_hours(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END) AS at FROM orders")
def times_in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times told with an offset, or with none, which means UTC."""
    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "+02:00").otherwise("+00:00"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_timestamp(said, "yyyy-MM-dd HH:mm:ssXXX").alias("at"))


@registered("SELECT conv_id, count(*) FILTER (turn > 0 AND role = 'user') AS replies, sum(length(text))::BIGINT AS views FROM conversations GROUP BY 1")
def reply_and_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that threads state in words, by label."""
    threads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if((F.col("turn") > 0) & (F.col("role") == "user")).alias("r"), F.sum(F.length("text")).alias("v"))
    said = threads.select("conv_id", F.concat(F.lit("Posted by x | "), F.format_number("r", 0), F.lit(" Replies, "), F.format_number("v", 0), F.lit(" views")).alias("t"))
    stated = lambda label: V.whole_number(F.regexp_extract("t", rf"(?i)([\d,]+)\s*{label}", 1))
    return said.select("conv_id", stated("repl(?:y|ies)").alias("replies"), stated("views?").alias("views"))


@registered("SELECT p_partkey AS page_id, v.k AS label, CASE v.k WHEN 'Brand' THEN p_brand ELSE p_type END AS value FROM part, (VALUES ('Brand'), ('Type')) v(k)")
def label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and values of definition lists."""
    html = F.concat(F.lit("<dl><dt>Brand:</dt><dd> "), "p_brand", F.lit("</dd><dt class='x'>Type</dt>\n<dd><b>"), "p_type", F.lit("</b></dd><dt>Empty</dt><dd></dd></dl>"))
    found = F.regexp_extract_all(html, F.lit(r"(?is)<dt[^>]*>.*?</dd>"), 0)
    one = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.explode(found).alias("pair"))
    from ..functions import text

    label = F.regexp_replace(text.strip_tags(F.regexp_extract("pair", r"(?is)^(<dt.*?</dt>)", 1)), r"\s*:$", "")
    return one.select("page_id", label.alias("label"), text.strip_tags(F.regexp_extract("pair", r"(?is)(<dd.*</dd>)$", 1)).alias("value")).where("value <> ''")

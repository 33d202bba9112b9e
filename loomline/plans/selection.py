"""Queries on domains, stated surfaces, paths of rules, adapters' results and exports of monitors. Line items stand for the
variants of a record and for what several adapters found, events for those of a user's monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url as U
from ..operators import selection as S
from .registry import registered, table
from .urls import _HOST, _surface_sql


@registered(
    rf"""WITH p AS (SELECT lower(url) AS u, regexp_replace({_HOST}, '^(www|m|blog)\.', '') AS d FROM pages)
    SELECT d AS domain, count(*) FILTER (list_bool_or([u = x OR starts_with(u, x || '/') OR starts_with(u, x || ':') FOR x IN ['http://' || d, 'https://' || d, 'http://www.' || d, 'https://www.' || d]])) AS pages, count(*) AS seen FROM p GROUP BY d"""
)
def domain_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on a domain or its www host, beside those seen on its blog and mobile hosts too."""
    domain = F.regexp_replace(U.hostname(F.col("url")), r"^(www|m|blog)\.", "")
    pages = table(spark, sf_dir, "pages").select("url", domain.alias("domain"))
    return pages.groupBy("domain").agg(F.count_if(S.of_domain(F.col("url"), F.col("domain"))).alias("pages"), F.count("*").alias("seen"))


_REQUESTED = "CASE page_id % 4 WHEN 0 THEN ' Job_Detail ' WHEN 1 THEN 'AUTO' WHEN 2 THEN '' END"
_AUTO = f"lower(trim(coalesce({_REQUESTED}, ''))) IN ('', 'auto')"


@registered(
    f"""WITH s AS (SELECT page_id, {_AUTO} AS auto, {_surface_sql(lambda k, c: f"'{k}'")} ELSE 'content_detail' END AS found, CAST({_surface_sql(lambda k, c: str(c))} ELSE 0.4 END AS DOUBLE) AS sure FROM pages)
    SELECT page_id, CASE WHEN auto THEN found ELSE 'job_detail' END AS surface, CASE WHEN auto THEN sure ELSE 1.0 END::DOUBLE AS confidence FROM s"""
)
def stated_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces of pages where some are stated by the run, some left open."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_REQUESTED).alias("requested"))
    name, sure = S.chosen_surface(F.col("requested"), F.col("url"))
    return pages.select("page_id", name.alias("surface"), sure.alias("confidence"))


@registered(
    """WITH v AS (SELECT l_orderkey, l_returnflag || l_linestatus AS sku, l_linenumber AS k, l_quantity AS q FROM lineitem),
      m AS (SELECT l_orderkey, sku, max_by(q, (k, q)) AS q FROM v GROUP BY 1, 2)
    SELECT l_orderkey, min_by(q, (k, q)) FILTER (sku = 'NO') AS matched, any_value(listed) AS listed
    FROM v JOIN (SELECT l_orderkey, string_agg(sku || ':' || q::BIGINT, ',' ORDER BY sku) AS listed FROM m GROUP BY 1) USING (l_orderkey) GROUP BY 1"""
)
def rule_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`variants[*].quantity` of each record: of the first open variant, and of all by their identity."""
    variant = F.struct(F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("quantity"), F.concat("l_returnflag", "l_linestatus").alias("sku"))
    records = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(variant)).alias("variants"))
    values = F.map_entries(S.variant_values(F.col("variants"), lambda v: v["sku"], "quantity"))
    listed = F.transform(F.array_sort(values), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("long")))
    matched = S.variant_value(F.col("variants"), "quantity", lambda v: v["sku"] == "NO")
    return records.select("l_orderkey", matched.alias("matched"), F.array_join(listed, ",").alias("listed"))


@registered(
    """WITH r AS (SELECT l_returnflag AS adapter, l_partkey, CASE WHEN l_tax > 0.03 THEN l_shipdate END AS seen, CASE WHEN l_discount > 0.05 THEN '' ELSE l_linestatus END AS state, l_quantity AS stock FROM lineitem),
      s AS (SELECT adapter, sum((seen IS NOT NULL)::INT + (trim(state) <> '')::INT + (stock IS NOT NULL)::INT) AS score FROM r GROUP BY 1), j AS (SELECT * FROM r JOIN s USING (adapter))
    SELECT l_partkey, arg_min(seen, (-score, adapter, seen)) FILTER (seen IS NOT NULL) AS seen, arg_min(state, (-score, adapter, state)) FILTER (state <> '') AS state, arg_min(stock, (-score, adapter, stock)) AS stock FROM j GROUP BY 1"""
)
def adapter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that several adapters found, merged by key, the fullest adapter first."""
    found = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS adapter", "l_partkey", "CASE WHEN l_tax > 0.03 THEN l_shipdate END AS seen", "CASE WHEN l_discount > 0.05 THEN '' ELSE l_linestatus END AS state", "l_quantity AS stock")
    return S.merged_results(found, "adapter", "l_partkey", ["seen", "state", "stock"])


@registered(
    """SELECT user_id, event_id, concat_ws(',', event_id, user_id, event_type, coalesce(CASE WHEN value > 50 THEN 'value' END, ''), strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS line
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20"""
)
def monitor_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of each monitor's events as lines of its export; missing names are blank."""
    page = S.latest_page(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20)
    name = F.when(F.col("value") > 50, "value").otherwise("")
    line = F.concat_ws(",", "event_id", "user_id", "event_type", name, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return page.select("user_id", "event_id", line.alias("line"))


@registered(
    """WITH t AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
    SELECT o_orderkey, coalesce(n, 0) AS table_rows, CASE WHEN o_orderstatus = 'F' THEN 'status=F,' ELSE '' END || 'title=' || o_orderpriority AS record FROM orders LEFT JOIN t ON l_orderkey = o_orderkey"""
)
def artifact_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their filled fields and the count of their table rows."""
    status = F.when(F.col("o_orderstatus") == "F", "F").otherwise("")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"), status.alias("status"), F.col("o_orderpriority").alias("title"))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("record"))
    out = S.bundles(runs, rows, "record", ["status", "title"])
    listed = F.transform(F.map_entries("structured_record"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(F.col("record").alias("o_orderkey"), "table_rows", F.array_join(F.array_sort(listed), ",").alias("record"))

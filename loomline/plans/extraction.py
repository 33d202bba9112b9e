"""Queries that build records from candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions import url as U
from ..operators import extraction as E
from ..sources import html as H
from .registry import registered, table
from .urls import _HOST, _PATH
from .pages import _BARE, _TITLE, _clean

_HEAD = _clean(rf"regexp_extract({_BARE}, '(?is)<title[^>]*>(.*?)</title>', 1)")
_TERMINAL = rf"trim(regexp_replace(regexp_replace(regexp_extract(regexp_replace({_PATH}, '/+$', ''), '([^/]*)$', 1), '\.[A-Za-z0-9]{{1,5}}$', ''), '[-_+%]+', ' ', 'g'))"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of title and host of each page: title tag, heading, and the URL's last part."""
    pages = table(spark, sf_dir, "pages")
    head = text.clean_text(F.regexp_extract(H.bare(F.col("html")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    row = lambda field, tier, ord_, value: F.struct(F.lit(field).alias("field"), F.lit(tier).alias("tier"), F.lit(ord_).alias("ord"), value.alias("value"))
    rows = F.array(row("title", "structured", 0, head), row("title", "dom", 1, H.first_heading(F.col("html"))), row("title", "text", 2, U.terminal_text(F.col("url"))), row("host", "text", 0, U.hostname(F.col("url"))))
    return pages.select("page_id", F.explode(rows).alias("c")).select("page_id", "c.*")


@registered(
    f"""WITH p AS (SELECT page_id, {_HEAD} AS a, {_TITLE} AS b, {_TERMINAL} AS c, {_HOST} AS host FROM pages)
    SELECT page_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) AS title, nullif(host, '') AS host FROM p"""
)
def field_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.record(E.winners(_candidates(spark, sf_dir), "page_id"), "page_id", ["title", "host"])


@registered(
    """SELECT CASE WHEN p_name IS NULL OR p_name = '' THEN 'empty' WHEN length(p_name) < 9 THEN 'shape' ELSE 'kept' END AS name_state, CASE WHEN p_retailprice > 950 THEN 'kept' ELSE 'shape' END AS price_state, 'not_allowed' AS size_state, count(*) AS n FROM part GROUP BY 1, 2, 3"""
)
def public_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.public(table(spark, sf_dir, "part"), "p_partkey", {"p_name": F.length("p_name") >= 9, "p_retailprice": F.col("p_retailprice") > 950}, ["p_size"])
    state = lambda f: F.coalesce(F.element_at("rejected", F.lit(f)), F.when(F.map_contains_key("data", f), "kept"))
    return out.groupBy(state("p_name").alias("name_state"), state("p_retailprice").alias("price_state"), state("p_size").alias("size_state")).agg(F.count("*").alias("n"))


@registered("SELECT event_id, coalesce(props->>'$.missing', props->>'$.k') AS k FROM events")
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.from_paths(table(spark, sf_dir, "events").select("event_id", "props"), "props", {"k": ["$.missing", "$.k"]}).select("event_id", "k")


_STATE = """CASE event_id % 3 WHEN 0 THEN concat('{"job": {"title": "', event_type, '", "place": ""}, "page": {"job": {"name": "page", "city": "', user_id, '"}}}')
  WHEN 1 THEN concat('{"job": "none", "page": {"job": {"name": "', event_type, '"}}}') ELSE props END"""


@registered(
    f"""WITH s AS (SELECT event_id, ({_STATE})::JSON AS s FROM events)
    SELECT event_id, coalesce(nullif(s->>'$.job.title', ''), nullif(s->>'$.job.name', ''), nullif(s->>'$.page.job.title', ''), nullif(s->>'$.page.job.name', '')) AS title,
    coalesce(nullif(s->>'$.job.place', ''), nullif(s->>'$.job.city', ''), nullif(s->>'$.page.job.place', ''), nullif(s->>'$.page.job.city', '')) AS place FROM s"""
)
def state_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a page's state from configured roots and paths: the first root that has a value gives it."""
    states = table(spark, sf_dir, "events").select("event_id", F.expr(_STATE).alias("state"))
    return E.from_roots(states, "state", ["$.job", "$.page.job"], {"title": [".title", ".name"], "place": [".place", ".city"]}).drop("state")


@registered(
    """WITH l AS (SELECT l_partkey, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag FROM lineitem GROUP BY 1)
    SELECT p_partkey, CASE WHEN p_size > 25 THEN p_type ELSE flag END AS kind FROM part LEFT JOIN l ON l_partkey = p_partkey"""
)
def backfill_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank kinds of parts, filled from the last of their items."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_type")).alias("kind"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return E.backfilled(parts, items, ["p_partkey"], ["kind"], "place")


@registered(
    """WITH r AS (SELECT event_type, user_id % 10 AS slot, 0 AS source, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' UNION ALL SELECT event_type, user_id % 10, 1, event_id FROM events WHERE ts < TIMESTAMP '2024-01-25')
    SELECT event_type, slot, event_id FROM r QUALIFY row_number() OVER (PARTITION BY event_type, slot ORDER BY source, event_id DESC) = 1"""
)
def rules_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's rules before the saved ones, one a key."""
    rules = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("slot"), "event_id", "ts")
    cut = F.lit("2024-01-25").cast("timestamp")
    return E.composed(rules.where(F.col("ts") < cut), rules.where(F.col("ts") >= cut), ["event_type", "slot"], "event_id").select("event_type", "slot", "event_id")


@registered()
def long_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a conversation's turns without near repeats."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("conv_id", E.long_texts(F.transform("t", lambda x: x["text"])).alias("kept"))


@registered(
    """WITH e AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
    SELECT user_id, count(*) FILTER (next - ts < INTERVAL 10 MINUTE) AS close_pairs, max(epoch(next) - epoch(ts))::BIGINT AS longest_gap FROM e GROUP BY 1"""
)
def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between a key's runs: how many follow within ten minutes, and the longest in seconds."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = F.lead(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - at
    gaps = table(spark, sf_dir, "events").select("user_id", gap.alias("gap"))
    return gaps.groupBy("user_id").agg(F.count_if(F.col("gap") < 600_000_000).alias("close_pairs"), F.round(F.max("gap") / 1_000_000).cast("long").alias("longest_gap"))

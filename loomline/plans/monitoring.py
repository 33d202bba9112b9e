"""Queries over events and orders, read as snapshots, monitor events and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import monitoring as M
from .registry import registered, table

_NUMBER = r"TRY_CAST(nullif(regexp_extract({}::VARCHAR, '-?\d+(?:\.\d+)?', 0), '') AS DECIMAL(18,4))"


def _day_state(events: DataFrame, first: str, end: str) -> DataFrame:
    """Each user's last event of a time window."""
    part = events.where((F.col("ts") >= F.lit(first).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    return M.latest(part, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", F.round("value", 2).alias("price"))


_STATE = "SELECT user_id, event_type, round(value, 2) AS price FROM events WHERE ts >= TIMESTAMP '{}' AND ts < TIMESTAMP '{}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
_WEEKS = ("2024-01-08", "2024-01-09", "2024-01-10")


@registered("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@registered(
    f"""WITH a AS ({_STATE.format(_WEEKS[0], _WEEKS[1])}), b AS ({_STATE.format(_WEEKS[1], _WEEKS[2])}),
    j AS (SELECT a.user_id AS o, b.user_id AS n, a.event_type AS ot, b.event_type AS nt, a.price AS op, b.price AS np FROM a FULL JOIN b ON a.user_id = b.user_id),
    e AS (
      SELECT n AS user_id, 'record_new' AS event_type, NULL::VARCHAR AS field_name, NULL::VARCHAR AS old_value, NULL::VARCHAR AS new_value FROM j WHERE o IS NULL
      UNION ALL SELECT o, 'record_removed', NULL, NULL, NULL FROM j WHERE n IS NULL
      UNION ALL SELECT o, 'field_changed', 'event_type', ot, nt FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND ot IS DISTINCT FROM nt
      UNION ALL SELECT o, 'field_changed', 'price', op::VARCHAR, np::VARCHAR FROM j WHERE o IS NOT NULL AND n IS NOT NULL AND op IS DISTINCT FROM np)
    SELECT * FROM e"""
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return M.snapshot_diff(_day_state(events, *_WEEKS[:2]), _day_state(events, *_WEEKS[1:]), "user_id", ["event_type", "price"])


def _users(events: DataFrame, part: int) -> DataFrame:
    return events.where((F.col("ts") >= F.lit(_WEEKS[part]).cast("timestamp")) & (F.col("ts") < F.lit(_WEEKS[part + 1]).cast("timestamp"))).select("user_id").distinct()


_SEEN = "SELECT DISTINCT user_id FROM events WHERE ts >= TIMESTAMP '{}' AND ts < TIMESTAMP '{}'"


@registered(f"{_SEEN.format(_WEEKS[1], _WEEKS[2])} EXCEPT {_SEEN.format(_WEEKS[0], _WEEKS[1])}")
def new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _users(events, 1).join(_users(events, 0), "user_id", "left_anti")


@registered(f"{_SEEN.format(_WEEKS[0], _WEEKS[1])} EXCEPT {_SEEN.format(_WEEKS[1], _WEEKS[2])}")
def removed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return _users(events, 0).join(_users(events, 1), "user_id", "left_anti")


@registered("SELECT user_id, count(*) AS changes FROM events WHERE event_type IN ('purchase', 'signup') AND ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def monitor_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup") & (F.col("ts") >= F.lit("2024-01-15").cast("timestamp")))
    return events.groupBy("user_id").agg(F.count("*").alias("changes"))


_RANKS = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}


@registered(
    """SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01'
    ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderdate, o_orderkey LIMIT 20"""
)
def due_monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 dispatches a tick."""
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("next_run_at"))
    return M.due(jobs, F.lit("1996-01-01").cast("timestamp"), _RANKS).limit(20).select("id", "priority")


@registered("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.retained(table(spark, sf_dir, "events"), "ts", 7).groupBy("event_type").agg(F.count("*").alias("n"))


@registered("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute FROM events")
def sliding_rate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-60_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("in_minute"))


@registered(
    """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM c),
    s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS streak FROM g)
    SELECT user_id, max(streak) AS longest FROM s GROUP BY 1"""
)
def unchanged_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"))


@registered(
    """WITH l AS (SELECT value, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
    SELECT round(avg(value), 2) AS mean_value, count(*) FILTER (value > 20) AS long_running, count(*) FILTER (event_type = 'error') AS stalled FROM l"""
)
def ops_duration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the latest 1000 runs."""
    last = table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
    return last.agg(F.round(F.avg("value"), 2).alias("mean_value"), F.count_if(F.col("value") > 20).alias("long_running"), F.count_if(F.col("event_type") == "error").alias("stalled"))


_VERDICT = "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'partial' WHEN 'signup' THEN 'blocked' ELSE 'success' END"


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand for verdicts of a user's URLs."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "signup", "blocked").otherwise("success")
    return table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), kind.alias("verdict"))


@registered(
    f"""SELECT user_id, ts::DATE AS day, CASE WHEN bool_and({_VERDICT} = 'success') THEN 'success' WHEN bool_or({_VERDICT} IN ('success', 'partial')) THEN 'partial'
      WHEN bool_or({_VERDICT} = 'error') THEN 'error' ELSE 'blocked' END AS verdict FROM events GROUP BY 1, 2"""
)
def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("verdict")
    rolled = F.when(F.bool_and(v == "success"), "success").when(F.bool_or(v.isin("success", "partial")), "partial").when(F.bool_or(v == "error"), "error").otherwise("blocked")
    return _verdicts(spark, sf_dir).groupBy("user_id", "day").agg(rolled.alias("verdict"))


@registered(
    f"""WITH h AS (SELECT user_id, count(*) AS urls, count(*) FILTER ({_VERDICT} NOT IN ('success', 'partial')) AS failures FROM events GROUP BY 1)
    SELECT user_id, urls, failures, round_even(failures / urls, 4) AS failure_rate, CASE WHEN failures / urls >= 0.25 THEN 'failed' WHEN failures / urls >= 0.05 THEN 'degraded' ELSE 'healthy' END AS status FROM h"""
)
def run_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _verdicts(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("urls"), F.count_if(~F.col("verdict").isin("success", "partial")).alias("failures"))
    rate = F.col("failures") / F.col("urls")
    return runs.select("user_id", "urls", "failures", F.bround(rate, 4).alias("failure_rate"), F.when(rate >= 0.25, "failed").when(rate >= 0.05, "degraded").otherwise("healthy").alias("status"))


@registered(
    f"""SELECT ts::DATE AS day, {_VERDICT} AS verdict, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"""
)
def progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "partial").when(F.col("event_type") == "signup", "blocked").otherwise("success")
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), kind.alias("verdict")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@registered(
    f"""SELECT o_orderkey FROM orders WHERE {_NUMBER.format("o_totalprice")} >= 150000 AND lower(trim(o_orderstatus)) = 'o'"""
)
def condition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.where(M.condition("price >= 150000 AND availability == 'O'", {"price": F.col("o_totalprice").cast("decimal(18,4)"), "availability": F.col("o_orderstatus")})).select("o_orderkey")


@registered(
    """SELECT o_orderkey, o_totalprice > 200000 AS dear, lower(trim(o_orderpriority)) = '1-urgent' AS urgent, o_orderpriority IS NULL OR o_orderpriority = '' AS unranked FROM orders"""
)
def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", M.rule_met("gt", F.col("o_totalprice").cast("decimal(18,4)"), "200000").alias("dear"), M.rule_met("equals", priority, "1-URGENT").alias("urgent"), M.rule_met("missing", priority).alias("unranked"))


@registered("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 0")
def json_path_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k >= 0")


@registered("SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1")
def csv_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of an open table: the keys of all rows."""
    return table(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@registered("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS thread, count(*) AS turns FROM conversations GROUP BY 1")
def conversation_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("thread"), F.size("t").cast("long").alias("turns"))


@registered("SELECT event_type, CASE WHEN lower(trim(event_type)) IN ('purchase', 'signup') THEN 'conversion' ELSE 'traffic' END AS family, count(*) AS n FROM events GROUP BY 1, 2")
def event_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    family = F.when(X.equality_text(F.col("event_type")).isin("purchase", "signup"), "conversion").otherwise("traffic")
    return table(spark, sf_dir, "events").groupBy("event_type", family.alias("family")).agg(F.count("*").alias("n"))

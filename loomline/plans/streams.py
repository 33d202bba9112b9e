"""Queries that run a stream over what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import deliveries
from ..streaming import hosts, monitors, sinks
from .registry import registered, table

_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@registered(
    """WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS old, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT * FROM p WHERE old IS DISTINCT FROM event_type)
      SELECT user_id, event_id, old AS old_value, event_type AS new_value, (k - coalesce(lag(k) OVER (PARTITION BY user_id ORDER BY k), k - 1) - 1)::BIGINT AS unchanged FROM c"""
)
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each user's value, found with state."""
    return sinks.drained(monitors.changes(sinks.events(spark, sf_dir, "events", _EVENTS)), "changes")


@registered(
    """WITH RECURSIVE p AS (SELECT user_id::VARCHAR AS host, epoch(ts)::DOUBLE AS t, CASE WHEN event_type = 'error' THEN 'blocked' WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END AS o FROM events),
      q AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, o) AS k FROM p),
      s AS (SELECT host, 0 AS k, 0::DOUBLE AS seen, 0::DOUBLE AS last, 0 AS blocks, 0::DOUBLE AS until, 0 AS run, 0::DOUBLE AS opened, 0::DOUBLE AS t FROM q WHERE k = 1
        UNION ALL SELECT q.host, q.k, greatest(z.seen, q.t), CASE WHEN o = 'blocked' THEN q.t ELSE z.last END,
          CASE WHEN o = 'blocked' THEN CASE WHEN q.t - z.last > 3600 THEN 1 ELSE z.blocks + 1 END WHEN o = 'ok' THEN 0 ELSE z.blocks END,
          CASE WHEN o = 'blocked' AND q.t - z.last <= 3600 AND z.blocks + 1 >= 2 THEN q.t + 3600 WHEN o = 'ok' THEN 0 ELSE z.until END,
          CASE WHEN o = 'ok' OR (o = 'failed' AND z.run + 1 >= 5) THEN 0 WHEN o = 'failed' THEN z.run + 1 ELSE z.run END,
          CASE WHEN o = 'failed' AND z.run + 1 >= 5 THEN q.t + 300 ELSE z.opened END, q.t
        FROM (SELECT s.host, s.k, s.seen, CASE WHEN idle THEN 0 ELSE s.last END AS last, CASE WHEN idle THEN 0 ELSE s.blocks END AS blocks, CASE WHEN idle THEN 0 ELSE s.until END AS until, CASE WHEN idle THEN 0 ELSE s.run END AS run, CASE WHEN idle THEN 0 ELSE s.opened END AS opened
          FROM (SELECT s.*, n.t - s.seen > 86400 AS idle FROM s JOIN q n ON n.host = s.host AND n.k = s.k + 1) s) z JOIN q ON q.host = z.host AND q.k = z.k + 1)
      SELECT host, blocks::BIGINT AS blocks, until > t AS by_browser, opened > t AS open, count(*) AS n FROM s WHERE k > 0 GROUP BY ALL"""
)
def stream_host_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each host stood at which count of blocks, fetched by browser, or had its circuit open."""
    outcome = F.when(F.col("event_type") == "error", "blocked").when(F.col("event_type") == "purchase", "ok").otherwise("failed")
    fetches = sinks.events(spark, sf_dir, "events", _EVENTS).select(F.col("user_id").cast("string").alias("host"), "ts", outcome.alias("outcome"))
    found = sinks.drained(hosts.policies(fetches), "policies")
    return found.groupBy("host", "blocks", F.col("browser_until").isNotNull().alias("by_browser"), F.col("open_until").isNotNull().alias("open")).agg(F.count("*").alias("n"))


_NEXT = ", ".join(f"(SELECT event_id, {k} AS attempt, lead(event_type, {k}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS answer FROM events)" for k in (1, 2, 3)).replace("), (", ") UNION ALL (")


@registered(
    f"""WITH a AS (SELECT event_id, attempt, CASE WHEN answer IN ('error', 'view') THEN 503 WHEN answer IS NOT NULL THEN 200 END AS code FROM ({_NEXT})),
      e AS (SELECT event_id, ts, user_id, value, CASE WHEN user_id % 9 = 0 THEN 'skipped' WHEN strlen(repeat(props, floor(value * 20)::INT)) > 10000 THEN 'failed' ELSE 'pending' END AS first FROM events WHERE event_type = 'error'),
      t AS (SELECT e.event_id, e.ts, a.attempt, a.code, coalesce(max((coalesce(a.code, 0) = 200)::INT) OVER (PARTITION BY e.event_id ORDER BY a.attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e JOIN a USING (event_id) WHERE first = 'pending')
    SELECT event_id, attempt, CASE WHEN code = 200 THEN 'sent' ELSE 'failed' END AS status, ts + to_microseconds(CASE attempt WHEN 1 THEN 0 WHEN 2 THEN 250000 ELSE 750000 END) AS due_at, code, CASE WHEN code IS NULL THEN 'no answer' WHEN code <> 200 THEN 'HTTP ' || code END AS error FROM t WHERE done = 0
    UNION ALL SELECT event_id, 0, first, ts, NULL, CASE first WHEN 'failed' THEN 'payload too large' ELSE 'no address' END FROM e WHERE first <> 'pending'"""
)
def delivery_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of the errors' deliveries, if the user's next events answer their attempts."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    code = lambda t: F.when(t.isin("error", "view"), 503).when(t.isNotNull(), 200)
    answers = events.select("event_id", F.array(*(F.struct(F.lit(k).alias("attempt"), code(F.lead("event_type", k).over(order)).alias("code")) for k in (1, 2, 3))).alias("a")).select("event_id", F.inline("a"))
    url = F.when(F.col("user_id") % 9 != 0, "https://hook.example.com/")
    errors = events.where("event_type = 'error'").select("event_id", "ts", url.alias("url"), F.repeat("props", F.floor(F.col("value") * 20).cast("int")).alias("payload"))
    return deliveries.attempts(errors, answers)

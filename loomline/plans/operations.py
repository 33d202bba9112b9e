"""Queries over runs, monitors, jobs and exports. Orders stand for runs, line items for the URLs of a run, events for
polls of a user's monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields as V
from ..operators import operations as O
from .registry import registered, table


@registered(
    """WITH e AS (SELECT *, value > 20 AS found FROM events), r AS (SELECT *, sum(found::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
      f AS (SELECT *, sum((NOT found)::INT) OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS failures FROM r)
      SELECT CASE WHEN value > 95 THEN 'triggered' WHEN failures >= 5 THEN 'error' ELSE 'active' END AS status, failures::BIGINT AS failures, count(*) AS n FROM f GROUP BY 1, 2"""
)
def monitor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = O.run_states(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 20, F.col("value") > 95)
    return polls.groupBy("status", "failures").agg(F.count("*").alias("n"))


_TAGS = "CASE WHEN event_id % 3 = 0 THEN event_type END AS etag, CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS modified, CASE WHEN event_id % 7 < 5 THEN props END AS digest"


@registered(
    f"""WITH s AS (SELECT user_id, ts, event_id, {_TAGS} FROM events), p AS (SELECT *, lag(etag) OVER w AS le, lag(modified) OVER w AS lm, lag(digest) OVER w AS ld FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT user_id, count(*) FILTER ((le IS NULL AND lm IS NULL AND ld IS NULL) OR CASE WHEN etag IS NOT NULL THEN etag IS DISTINCT FROM le WHEN modified IS NOT NULL THEN modified IS DISTINCT FROM lm WHEN digest IS NOT NULL THEN digest IS DISTINCT FROM ld ELSE true END) AS changed, count(*) AS polls FROM p GROUP BY 1"""
)
def validator_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls that a resource's validators let count as changed, by user."""
    states = table(spark, sf_dir, "events").selectExpr("user_id", "ts", "event_id", *_TAGS.split(", "))
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    last = [F.lag(c).over(by_user).alias(f"last_{c}") for c in ("etag", "modified", "digest")]
    seen = states.select("user_id", "etag", "modified", "digest", *last)
    changed = O.validator_changed(*(F.col(c) for c in ("etag", "modified", "digest", "last_etag", "last_modified", "last_digest")))
    return seen.groupBy("user_id").agg(F.count_if(changed).alias("changed"), F.count("*").alias("polls"))


@registered("SELECT event_id, user_id, value FROM events WHERE user_id % 10 = 3 AND event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 5")
def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the history of some alerts, the newest first."""
    mine = table(spark, sf_dir, "events").where("user_id % 10 = 3 AND event_type = 'purchase'")
    return mine.orderBy(F.desc("ts"), F.desc("event_id")).offset(5).limit(20).select("event_id", "user_id", "value")


@registered("SELECT o_orderkey, o_orderdate + to_hours(o_custkey % 72) AS next_run_at, o_orderdate + to_seconds(greatest(60, o_custkey)) AS next_poll_at FROM orders")
def next_run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next runs by hours, and next polls by seconds, which are a minute apart at least."""
    later = lambda seconds: F.col("o_orderdate") + F.make_interval(secs=seconds)
    return table(spark, sf_dir, "orders").select("o_orderkey", later((F.col("o_custkey") % 72) * 3600).alias("next_run_at"), later(F.greatest(F.lit(60), F.col("o_custkey"))).alias("next_poll_at"))


@registered(
    """WITH b AS (SELECT o_orderkey, o_orderstatus, coalesce(max(l_shipdate), any_value(o_orderdate)) AS beat FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 1 GROUP BY 1, 2), n AS (SELECT max(o_orderdate) AS now FROM orders)
      SELECT o_orderkey FROM b, n WHERE o_orderstatus <> 'F' AND date_diff('second', beat, now) >= 86400 * 60"""
)
def stale_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open runs whose last sign of life, else whose start, is over sixty days before the newest run."""
    runs, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_linenumber > 1")
    beats = items.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("beat"))
    now = F.broadcast(runs.agg(F.max("o_orderdate").alias("now")))  # one row
    met = runs.where("o_orderstatus <> 'F'").join(beats, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(now)
    seconds = lambda c: F.unix_timestamp(c)
    return met.where(seconds(F.col("now")) - seconds(F.coalesce("beat", "o_orderdate")) >= 86400 * 60).select("o_orderkey")


@registered(
    """WITH RECURSIVE p AS (SELECT user_id, event_id, floor(epoch(ts))::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      s AS (SELECT user_id, event_id, k, t AS slot FROM p WHERE k = 1 UNION ALL SELECT p.user_id, p.event_id, p.k, greatest(p.t, s.slot + 600) FROM s JOIN p ON p.user_id = s.user_id AND p.k = s.k + 1)
      SELECT user_id, count(*) AS n, max(slot)::DOUBLE AS last_slot, sum(slot - t)::DOUBLE AS waited FROM s JOIN p USING (user_id, k) GROUP BY 1"""
)
def host_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paced requests: ten minutes between those of a user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp("ts").cast("double").alias("t"))
    paced = O.slots(events, "user_id", "t", ["t", "event_id"], 600.0)
    return paced.groupBy("user_id").agg(F.count("*").alias("n"), F.max("slot").alias("last_slot"), F.sum(F.col("slot") - F.col("t")).alias("waited"))


_SOURCE = "CASE l_linenumber % 4 WHEN 0 THEN 'dom' WHEN 1 THEN 'structured' WHEN 2 THEN 'authoritative' ELSE 'odd' END"


@registered(
    f"""WITH s AS (SELECT l_orderkey, max(CASE {_SOURCE} WHEN 'dom' THEN 0.72 WHEN 'structured' THEN 0.86 WHEN 'authoritative' THEN 1.0 ELSE 0.58 END)::DOUBLE AS quality FROM lineitem GROUP BY 1)
      SELECT quality, CASE quality WHEN 1.0 THEN 'authoritative' WHEN 0.86 THEN 'structured' WHEN 0.72 THEN 'dom' ELSE 'text' END AS tier, count(*) AS n FROM s GROUP BY 1, 2"""
)
def source_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tier among the sources of each run's fields."""
    sources = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.expr(_SOURCE)).alias("sources"))
    quality, tier = O.tier_quality(F.col("sources"))
    return sources.groupBy(quality.alias("quality"), tier.alias("tier")).agg(F.count("*").alias("n"))


@registered(
    f"""WITH w AS (SELECT l_suppkey, {_SOURCE} AS tier, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM w)
      SELECT l_suppkey, tier AS dominant, round(w / total, 4) AS share FROM t QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, tier) = 1"""
)
def tier_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier that gives a supplier most of its weight, and its share; equal ones by name."""
    weights = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.expr(_SOURCE).alias("tier")).agg(F.sum(F.col("l_quantity").cast("long")).alias("w"))
    best = weights.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("w")).alias("w"), "tier")).alias("b"), F.sum("w").alias("total"))
    return best.select("l_suppkey", F.col("b.tier").alias("dominant"), F.round(-F.col("b.w") / F.col("total"), 4).alias("share"))


@registered(
    """SELECT l_orderkey AS run_id, count(*) AS urls, count(*) FILTER (l_returnflag = 'R') AS failed, count(DISTINCT l_suppkey) AS hosts, sum(CAST(l_quantity AS BIGINT))::BIGINT AS records,
      CASE WHEN bool_or(l_returnflag = 'R') THEN CASE WHEN bool_and(l_returnflag = 'R') THEN 'failed' ELSE 'partial' END ELSE 'success' END AS verdict FROM lineitem GROUP BY 1"""
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of each run's URLs, and the verdict that they give together."""
    failed = F.col("l_returnflag") == "R"
    verdict = F.when(F.bool_and(failed), "failed").when(F.bool_or(failed), "partial").otherwise("success")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("urls"), F.count_if(failed).alias("failed"), F.count_distinct("l_suppkey").alias("hosts"), F.sum(F.col("l_quantity").cast("long")).alias("records"), verdict.alias("verdict"),
    )


@registered(
    """WITH u AS (SELECT l_suppkey, l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS good FROM lineitem GROUP BY 1, 2)
      SELECT l_suppkey, sum(n)::BIGINT AS urls, sum(good)::BIGINT AS good, min(good * 100 // n)::BIGINT AS worst_percent, count(*) FILTER (good = n) AS whole_runs FROM u GROUP BY 1"""
)
def quality_summaries_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality summaries of a supplier's runs in one: sums, the worst share, the runs without a fault."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "N").alias("good"))
    return runs.groupBy("l_suppkey").agg(F.sum("n").alias("urls"), F.sum("good").alias("good"), F.min(V.percent(F.col("good"), F.col("n"))).alias("worst_percent"), F.count_if(F.col("good") == F.col("n")).alias("whole_runs"))


@registered("SELECT o_custkey AS job_id, count(*) AS sources, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_totalprice >= 250000) AS high, count(*) FILTER (o_totalprice < 50000) AS uncertain FROM orders GROUP BY 1")
def job_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job_id")).agg(F.count("*").alias("sources"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(price >= 250000).alias("high"), F.count_if(price < 50000).alias("uncertain"))


@registered("SELECT event_type AS task, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS cost FROM events GROUP BY 1")
def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact decimal sums by task."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task")).agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("decimal(28,4)").alias("cost"))


@registered("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'cost' WHEN l_linenumber % 2 = 0 THEN 'price' ELSE 'amount' END AS matched FROM lineitem")
def fields_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which a record has the requested price."""
    even = F.col("l_linenumber") % 2 == 0
    named = F.create_map(F.lit("price"), F.when(even & (F.col("l_returnflag") != "R"), "9").otherwise(""), F.lit("amount"), F.when(F.col("l_returnflag") != "R", "8"), F.lit("cost"), F.lit("7"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", O.aliased(named, ["price", "amount", "cost"]).alias("matched"))


@registered("SELECT user_id, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda t: NOT list_contains(list(DISTINCT event_type), t))) AS missing, (100 * count(DISTINCT event_type) // 5)::BIGINT AS points FROM events GROUP BY user_id")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected kinds of events that a user has not, and points for the share that is there."""
    wanted = F.array(*(F.lit(t) for t in ("click", "error", "purchase", "signup", "view")))
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return seen.select("user_id", F.array_sort(F.array_except(wanted, "seen")).alias("missing"), O.coverage(wanted, F.col("seen"), 100).alias("points"))


_DROPS = "l_quantity - 5 AS score, l_linenumber % 2 = 0 AS detail, l_suppkey % 3 = 0 AS merchandise, l_suppkey % 5 = 0 AS fallback, l_returnflag = 'N' AS supported, l_partkey % 7 = 0 AS utility, l_linestatus = 'F' AS job"


@registered(
    f"""SELECT count(*) AS n, count(*) FILTER (utility AND NOT detail OR utility AND score < 10 OR NOT supported AND detail AND NOT job AND NOT merchandise OR NOT supported AND NOT detail AND NOT job AND NOT fallback
      OR NOT supported AND NOT detail AND score < 10 OR score < 0) AS dropped FROM (SELECT {_DROPS} FROM lineitem)"""
)
def records_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_DROPS.split(", "))
    return rows.agg(F.count("*").alias("n"), F.count_if(O.dropped()).alias("dropped"))


@registered("SELECT user_id AS monitor_id, count(*) AS events, count(*) || ' change' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' found' AS title FROM events WHERE event_type = 'error' GROUP BY 1")
def monitor_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notification for each monitor with changes."""
    counts = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("monitor_id")).agg(F.count("*").alias("events"))
    return counts.select("monitor_id", "events", F.concat(F.col("events"), F.when(F.col("events") == 1, " change").otherwise(" changes"), F.lit(" found")).alias("title"))


@registered(" UNION ALL ".join(f"SELECT '{t}' AS bucket, count(*) AS rows_deleted FROM {t}" for t in ("orders", "lineitem", "events", "pages")))
def bulk_reset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reset would delete, by bucket."""
    out = None
    for name in ("orders", "lineitem", "events", "pages"):
        one = table(spark, sf_dir, name).agg(F.count("*").alias("rows_deleted")).select(F.lit(name).alias("bucket"), "rows_deleted")
        out = one if out is None else out.unionByName(one)
    return out


@registered("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0)")
def cascade_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that stay when a third of the customers go, with their runs and the records of these."""
    gone = table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select("o_orderkey")
    return table(spark, sf_dir, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@registered(
    """SELECT o_orderkey AS record_id, to_json(struct_pack(title := o_orderpriority, price := CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)))::VARCHAR AS data,
      to_json(struct_pack(source := CASE WHEN o_orderstatus = 'F' THEN 'adapter' ELSE 'dom' END, run_id := o_custkey))::VARCHAR AS provenance FROM orders"""
)
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their provenance apart, as they leave."""
    data = F.to_json(F.struct(F.col("o_orderpriority").alias("title"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price")))
    origin = F.to_json(F.struct(F.when(F.col("o_orderstatus") == "F", "adapter").otherwise("dom").alias("source"), F.col("o_custkey").alias("run_id")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), data.alias("data"), origin.alias("provenance"))


@registered(
    """SELECT record_id, 1 AS table_number, row_number, k AS header, CASE k WHEN 'part' THEN l_partkey ELSE l_suppkey END AS cell
      FROM (SELECT l_orderkey AS record_id, l_partkey, l_suppkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))::INT AS row_number FROM lineitem), (VALUES ('part'), ('supplier')) v(k)"""
)
def flattened_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cell of the tables that records hold."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.array(rows).alias("tables"))
    laid = records.select("record_id", F.posexplode("tables").alias("t", "rows")).select("record_id", (F.col("t") + 1).alias("table_number"), F.posexplode("rows").alias("r", "row"))
    return laid.select("record_id", "table_number", (F.col("r") + 1).alias("row_number"), F.explode(F.create_map(F.lit("part"), F.col("row.l_partkey"), F.lit("supplier"), F.col("row.l_suppkey"))).alias("header", "cell"))


@registered(
    """SELECT min(record) AS first_record, fingerprint FROM (SELECT l_orderkey AS record, sha256(string_agg(l_partkey || ':' || l_suppkey, '|' ORDER BY l_linenumber, l_partkey || ':' || l_suppkey)) AS fingerprint
      FROM lineitem GROUP BY l_orderkey) GROUP BY fingerprint"""
)
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of records by the digest of their cells, each table once with the first record that has it."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat_ws(":", "l_partkey", "l_suppkey").alias("cells"))))
    tables = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["cells"]), "|"), 256).alias("fingerprint"))
    return tables.groupBy("fingerprint").agg(F.min("l_orderkey").alias("first_record")).select("first_record", "fingerprint")


@registered("SELECT event_id // 1000 AS batch, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM (SELECT event_id FROM events WHERE value < 50) GROUP BY 1")
def keyset_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to purge in batches by ranges of their keys, so that no batch has to look for where the last one ended."""
    return table(spark, sf_dir, "events").where("value < 50").groupBy(F.expr("event_id div 1000").alias("batch")).agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@registered("SELECT coalesce(a.o_custkey, b.c_custkey) AS job_id, CASE WHEN a.o_custkey IS NULL THEN 'idle' ELSE 'running' END AS status, coalesce(a.n, 0) AS runs FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) a FULL JOIN customer b ON a.o_custkey = b.c_custkey")
def job_rows_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed jobs and newer states of jobs in one list by id; the newer state wins."""
    newer = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    met = newer.join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "full")
    return met.select(F.coalesce("o_custkey", "c_custkey").alias("job_id"), F.when(F.col("o_custkey").isNull(), "idle").otherwise("running").alias("status"), F.coalesce("n", F.lit(0)).alias("runs"))


@registered(
    """SELECT page_id FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(url), 'utm_') ORDER BY regexp_replace(lower(url), '[0-9]+', '', 'g'), TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS BIGINT) NULLS FIRST, page_id LIMIT 25"""
)
def monitor_table_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over URL and tracked text, sorted so that numbers in URLs count as numbers."""
    hits = table(spark, sf_dir, "pages").where(F.lower("url").contains("blog") | F.lower("url").contains("utm_"))
    number = F.regexp_extract("url", r"([0-9]+)[^0-9]*$", 1).try_cast("long")
    return hits.orderBy(F.regexp_replace(F.lower("url"), "[0-9]+", ""), number.asc_nulls_first(), "page_id").limit(25).select("page_id")


@registered(
    """WITH r AS (SELECT l_orderkey, count(*) AS records, count(*) FILTER (l_returnflag = 'N') AS good, bool_or(l_linestatus = 'O') AS more FROM lineitem GROUP BY 1)
      SELECT CASE WHEN good = 0 THEN 'retry: no good record' WHEN good * 2 < records THEN 'retry: integrity' WHEN records < 3 AND more THEN 'escalate' ELSE 'accept' END AS decision, count(*) AS n FROM r GROUP BY 1"""
)
def retry_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from a run's records: again, with a browser, or done."""
    runs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("records"), F.count_if(F.col("l_returnflag") == "N").alias("good"), F.bool_or(F.col("l_linestatus") == "O").alias("more"))
    decision = F.when(F.col("good") == 0, "retry: no good record").when(F.col("good") * 2 < F.col("records"), "retry: integrity").when((F.col("records") < 3) & F.col("more"), "escalate").otherwise("accept")
    return runs.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@registered("SELECT o_orderpriority AS surface, count(*) AS records, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority <> '5-LOW') AS eligible, count(*) FILTER (o_orderstatus <> 'O') AS skipped_status FROM orders GROUP BY 1")
def enrichment_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = F.col("o_orderstatus") == "O"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("surface")).agg(F.count("*").alias("records"), F.count_if(open_ & (F.col("o_orderpriority") != "5-LOW")).alias("eligible"), F.count_if(~open_).alias("skipped_status"))


_PAYLOAD = "'{\"name\":\"' || p_name || '\",\"offers\":{\"price\":' || CAST(p_size AS VARCHAR) || ',\"seller\":{\"name\":\"' || p_brand || '\"}},\"tags\":[\"' || p_type || '\",\"x\"]}'"


@registered("SELECT p_partkey, coalesce(nullif(p_name, ''), 'none') AS name, p_brand AS seller, CAST(p_size AS VARCHAR) AS price, [p_type, 'x'] AS tags FROM part")
def scalars_unwrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars out of nested payloads: by a list of paths, the first that is there."""
    said = F.expr(_PAYLOAD.replace("VARCHAR", "STRING"))
    at = lambda *paths: F.coalesce(*(F.get_json_object("payload", p) for p in paths))
    tags = F.from_json(F.get_json_object("payload", "$.tags"), "array<string>")
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("payload")).select("p_partkey", at("$.title", "$.name").alias("name"), at("$.seller.name", "$.offers.seller.name").alias("seller"), at("$.offers.amount", "$.offers.price").alias("price"), tags.alias("tags"))


@registered("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'given' END AS title, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN 'new' END AS note FROM part")
def structs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of one thing in one: values of the first stay unless they are empty, keys of the second are added."""
    key = F.col("p_partkey")
    base = F.create_map(F.lit("title"), F.when(key % 2 == 1, "given").otherwise(""), F.lit("brand"), F.col("p_brand"))
    more = F.map_filter(F.create_map(F.lit("title"), F.col("p_name"), F.lit("brand"), F.lit("other"), F.lit("note"), F.when(key % 3 == 0, "new").otherwise("")), lambda _, v: v != "")
    merged = F.map_zip_with(base, more, lambda _, a, b: F.coalesce(F.when(a != "", a), b))
    return table(spark, sf_dir, "part").select("p_partkey", merged.alias("m")).select("p_partkey", *(F.try_element_at("m", F.lit(c)).alias(c) for c in ("title", "brand", "note")))


@registered(
    """WITH e AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 1000 THEN 'price: too low' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'priority: missing' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status: unknown ' || o_orderstatus END], lambda x: x IS NOT NULL) AS errors FROM orders)
      SELECT len(errors)::INT AS n_errors, array_to_string(errors, '; ') AS errors, count(*) AS n FROM e GROUP BY 1, 2"""
)
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by what is wrong with their fields."""
    rules = [F.when(F.col("o_totalprice") < 1000, "price: too low"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "priority: missing"), F.when(~F.col("o_orderstatus").isin("F", "O"), F.concat(F.lit("status: unknown "), F.col("o_orderstatus")))]
    found = table(spark, sf_dir, "orders").select(F.array_compact(F.array(*rules)).alias("e"))
    return found.groupBy(F.size("e").alias("n_errors"), F.array_join("e", "; ").alias("errors")).agg(F.count("*").alias("n"))


@registered("SELECT o_custkey, count(*) AS records, count(*) FILTER (2 + (o_orderpriority <> '4-NOT SPECIFIED')::INT + (o_totalprice >= 100000)::INT >= 4) AS full_records FROM orders GROUP BY 1")
def populated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that have all four of their fields; URLs and sources do not count."""
    fields = [F.col("o_orderstatus"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")), F.when(F.col("o_totalprice") >= 100000, "high").otherwise("")]
    score = F.size(F.filter(F.array(*fields), lambda v: F.coalesce(v, F.lit("")) != ""))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("records"), F.count_if(score >= 4).alias("full_records"))


@registered(
    """SELECT l_suppkey, '# Supplier ' || l_suppkey || chr(10) || '- records: ' || count(*) || chr(10) || '- returned: ' || count(*) FILTER (l_returnflag = 'R') || chr(10) || '- grade: ' || CASE WHEN count(*) FILTER (l_returnflag = 'R') * 4 > count(*) THEN 'poor' ELSE 'good' END AS report FROM lineitem GROUP BY 1"""
)
def audit_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each supplier as a short document."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    grade = F.when(F.col("r") * 4 > F.col("n"), "poor").otherwise("good")
    lines = F.array(F.concat(F.lit("# Supplier "), "l_suppkey"), F.concat(F.lit("- records: "), "n"), F.concat(F.lit("- returned: "), "r"), F.concat(F.lit("- grade: "), grade))
    return sums.select("l_suppkey", F.array_join(lines, "\n").alias("report"))


@registered(
    """WITH t AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS fields FROM lineitem GROUP BY 1)
      SELECT l_orderkey, len(list_intersect(fields, ['NO', 'RF', 'AF'])) >= greatest(1, ceil(len(fields) * 0.5)) AS is_surface FROM t"""
)
def field_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether enough names of a payload are those of a surface: one at least, and half of them."""
    names = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("fields"))
    known = F.size(F.array_intersect("fields", F.array(F.lit("NO"), F.lit("RF"), F.lit("AF"))))
    return names.select("l_orderkey", (known >= F.greatest(F.lit(1), F.ceil(F.size("fields") * 0.5))).alias("is_surface"))


@registered(
    """WITH d AS (SELECT l_suppkey, 100 * count(*) FILTER (l_returnflag <> 'R') // count(*) AS markup, 100 * count(DISTINCT l_linestatus) // 2 AS commerce, least(100, count(DISTINCT l_shipdate) // 2) AS freshness FROM lineitem GROUP BY 1)
      SELECT l_suppkey, u.dimension, u.score::BIGINT AS score FROM d, LATERAL (VALUES ('markup', markup), ('commerce', commerce), ('freshness', freshness)) u(dimension, score)"""
)
def audit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's scores by dimension, one row each."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("good"), F.count("*").alias("n"), F.count_distinct("l_linestatus").alias("states"), F.count_distinct("l_shipdate").alias("days"))
    scores = F.create_map(F.lit("markup"), V.percent(F.col("good"), F.col("n")), F.lit("commerce"), V.percent(F.col("states"), F.lit(2)), F.lit("freshness"), F.least(F.lit(100).cast("long"), F.expr("days div 2")))
    return sums.select("l_suppkey", F.explode(scores).alias("dimension", "score"))


@registered("SELECT event_id, to_json(struct_pack(monitor := user_id, kind := event_type, evidence := props))::VARCHAR AS packet FROM events WHERE event_type = 'error'")
def evidence_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    packet = F.to_json(F.struct(F.col("user_id").alias("monitor"), F.col("event_type").alias("kind"), F.col("props").alias("evidence")))
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", packet.alias("packet"))


@registered("SELECT o_orderkey AS id, o_orderpriority AS title, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price, 'USD' AS currency, '' AS image, strftime(o_orderdate, '%Y-%m-%d') AS seen FROM orders")
def fixed_schema_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a fixed set of columns, all texts but the id; what is missing is blank."""
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), price.alias("price"), F.lit("USD").alias("currency"), F.lit("").alias("image"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"))

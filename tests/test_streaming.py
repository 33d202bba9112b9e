from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomline.streaming import deliveries, hosts, monitors


def test_changes_keep_state_between_batches(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp, event_type string"
    source = tmp_path / "in"
    stream = monitors.changes(spark.readStream.schema(schema).parquet(str(source))) if source.mkdir() is None else None
    query = stream.writeStream.format("memory").queryName("changes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows in enumerate([[(1, 7, "2024-01-01 00:00:00", "a"), (2, 7, "2024-01-01 00:01:00", "a")], [(3, 7, "2024-01-01 00:02:00", "a"), (4, 7, "2024-01-01 00:03:00", "b")]]):
            spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string").selectExpr("event_id", "user_id", "cast(ts as timestamp) ts", "event_type").coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        assert [tuple(r) for r in spark.table("changes_out").orderBy("event_id").collect()] == [(7, 1, None, "a", 0), (7, 4, "a", "b", 2)]
    finally:
        query.stop()


def test_host_policies(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", "2024-01-01 00:00:00", "blocked"), ("a", "2024-01-01 00:10:00", "blocked"), ("a", "2024-01-01 00:11:00", "ok"), ("b", "2024-01-01 00:00:00", "blocked"), ("b", "2024-01-01 02:00:00", "blocked")]
    spark.createDataFrame(rows, "host string, ts string, outcome string").selectExpr("host", "cast(ts as timestamp) ts", "outcome").coalesce(1).write.parquet(str(source))
    stream = hosts.policies(spark.readStream.schema("host string, ts timestamp, outcome string").parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("hosts_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    got = [(r["host"], r["blocks"], r["browser_until"] is not None) for r in spark.table("hosts_out").orderBy("host", "ts").collect()]
    assert got == [("a", 1, False), ("a", 2, True), ("a", 0, False), ("b", 1, False), ("b", 1, False)]


def _fed(spark, tmp_path, name, schema, make, batches):
    """Rows that a stream gives for batches of rows, whose times are text."""
    source = tmp_path / name
    source.mkdir()
    timed = schema.replace("ts string", "ts timestamp")
    query = make(spark.readStream.schema(timed).parquet(str(source))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(source))
            query.processAllAvailable()
        kept = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else None
        return spark.table(name).collect(), kept
    finally:
        query.stop()


def test_idle_hosts_are_forgotten(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{k}:00", "failed") for k in range(4)] + [("b", "2024-01-01 00:00:00", "blocked"), ("b", "2024-01-01 00:01:00", "blocked")]
    make = lambda s: hosts.policies(s, keep_seconds=7200, late="0 seconds")
    batches = [rows, [("c", "2024-01-03 00:00:00", "ok")], [("a", "2024-01-03 01:00:00", "failed")], [("a", "2024-01-01 00:00:01", "ok")]]
    got, kept = _fed(spark, tmp_path, "idle", "host string, ts string, outcome string", make, batches)
    assert [(r["blocks"], r["browser_until"] is not None) for r in got if r["host"] == "b"] == [(1, False), (2, True)]
    # the fifth failure comes after the host was forgotten, so that the circuit stays closed; the late success is dropped
    assert [r["open_until"] for r in got if r["host"] == "a"] == [None] * 5
    # in one batch the gap does the same
    whole, _ = _fed(spark, tmp_path, "whole", "host string, ts string, outcome string", make, [[r for b in batches[:3] for r in b]])
    assert sorted(map(str, whole)) == sorted(map(str, got))
    opened, _ = _fed(spark, tmp_path, "opened", "host string, ts string, outcome string", make, [rows, [("a", "2024-01-01 00:30:00", "failed")]])
    assert [str(r["open_until"]) for r in opened if r["host"] == "a"][-1] == "2024-01-01 00:35:00"


def test_idle_keys_of_changes(spark, tmp_path):
    schema = "event_id long, user_id long, ts string, event_type string"
    batches = [[(1, 7, "2024-01-01 00:00:00", "a"), (2, 8, "2024-01-01 00:00:00", "a")], [(3, 7, "2024-01-01 00:30:00", "a")], [(4, 9, "2024-01-02 00:00:00", "x")], [(5, 7, "2024-01-02 01:00:00", "a"), (6, 8, "2024-01-02 01:00:00", "b")]]
    got, kept = _fed(spark, tmp_path, "keys", schema, lambda s: monitors.changes(s, forget_seconds=3600, late="0 seconds"), batches)
    assert sorted((r["event_id"], r["old_value"]) for r in got) == [(1, None), (2, None), (4, None), (5, None), (6, None)]
    remembered, _ = _fed(spark, tmp_path, "remembered", schema, monitors.changes, batches)
    assert sorted((r["event_id"], r["old_value"]) for r in remembered) == [(1, None), (2, None), (4, None), (6, "a")]


def test_deliveries_are_written_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def send(url, payload):
        with open(log / f"{payload}-{uuid.uuid4().hex}", "w"):
            pass
        if payload == "raises":
            raise OSError("down")
        return {"ok": 204, "late": 503 if len(list(log.glob("late-*"))) < 3 else 200}.get(payload, 500)

    rows = [(1, "ok", "u"), (2, "late", "u"), (3, "bad", "u"), (4, "raises", "u"), (5, "ok", None), (6, "x" * 50, "u"), (1, "ok", "u")]
    events = spark.createDataFrame([(i, "2024-01-01 00:00:00", u, p) for i, p, u in rows], "event_id long, ts string, url string, payload string").withColumn("ts", F.to_timestamp("ts"))
    seen = []

    def failing(df, batch):
        raise ValueError("no")

    write = deliveries.sink(send, str(tmp_path / "out"), {"bad": failing, "count": lambda df, batch: seen.append((batch, df.count()))}, most_bytes=40)
    want = {(1, 1, "sent", 204), (2, 1, "failed", 503), (2, 2, "failed", 503), (2, 3, "sent", 200), *((3, k, "failed", 500) for k in (1, 2, 3)), *((4, k, "failed", None) for k in (1, 2, 3)), (5, 0, "skipped", None), (6, 0, "failed", None)}
    for _ in range(2):
        write(events, 0)
        got = deliveries.deliveries(spark, str(tmp_path / "out")).collect()
        assert {(r["event_id"], r["attempt"], r["status"], r["code"]) for r in got} == want and len(got) == len(want)
    assert len(list(log.iterdir())) == 10 and seen == [(0, 12)]
    assert {str(r["due_at"])[17:] for r in got if r["event_id"] == 3} == {"00", "00.250000", "00.750000"}
    write(events.limit(0), 1)
    assert deliveries.deliveries(spark, str(tmp_path / "out")).count() == len(want)

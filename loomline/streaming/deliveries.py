"""A sink that sends a stream's events and keeps what became of them; a replayed batch adds nothing."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deliveries as D

SCHEMA = "event_id long, attempt int, status string, due_at timestamp, code int, error string"
Send = Callable[[str, str], int | None]
Hook = Callable[[DataFrame, int], None]
_log = logging.getLogger(__name__)


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def sink(send: Send, path: str, hooks: dict[str, Hook] | None = None, most_bytes: int = D.MOST_BYTES) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over events (event_id, ts, url, payload). path is a folder that driver and executors share.

    Rows of one attempt of one batch are a folder that is written once: an attempt whose folder is complete is read, not sent,
    so that each (event, attempt) has one row however often a batch is played; events within a batch are sent once
    each. A batch that broke off while sending is sent again from that attempt on, with the same (event, attempt), by which a
    receiver knows it. send(url, payload) runs on executors and gives a code, or None; what it raises is no answer.

    hooks run on the driver when a batch is complete, by name and once a batch; one that raises is logged, runs again when the
    batch is played again, and stops none of the others."""

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def code(url: str, payload: str) -> int | None:
            try:
                return send(url, payload)
            except Exception:
                return None

        for rows in batches:
            codes = [code(u, p) for u, p in zip(rows["url"], rows["payload"], strict=True)]
            yield rows.assign(code=pd.array(codes, "Int32"))

    def write(events: DataFrame, batch: int) -> None:
        spark, base = events.sparkSession, f"{path}/deliveries/batch={batch}"
        events = events.dropDuplicates(["event_id"]).withColumn("_status", D.first_status(F.col("url"), F.col("payload"), most_bytes))
        made = None
        for attempt in range(D.MOST_ATTEMPTS + 1):
            place = f"{base}/attempt={attempt}"
            if not _there(spark, place):
                if attempt == 0:
                    rows = D.attempts(events.where("_status <> 'pending'"), spark.createDataFrame([], "event_id long, attempt int, code int"), most_bytes)
                else:
                    open_events = events.where("_status = 'pending'").select("event_id", "ts", "url", "payload")
                    if attempt > 1:  # those whose attempt before failed
                        open_events = open_events.join(made.where("status = 'failed'").select("event_id"), "event_id", "left_semi")
                    answered = open_events.mapInPandas(sent, "event_id long, ts timestamp, url string, payload string, code int")
                    due = D.due(F.col("ts"), F.lit(attempt))
                    error = F.when(F.col("code").isNull(), "no answer").when(~D.succeeded(F.col("code")), F.concat(F.lit("HTTP "), F.col("code")))
                    rows = answered.select("event_id", F.lit(attempt).alias("attempt"), F.when(D.succeeded(F.col("code")), "sent").otherwise("failed").alias("status"), due.alias("due_at"), "code", error.alias("error"))
                rows.drop("attempt").write.mode("overwrite").parquet(place)
            made = spark.read.schema(SCHEMA.replace("attempt int, ", "")).parquet(place)
        done = deliveries(spark, path).where(F.col("batch") == batch)
        for name, hook in (hooks or {}).items():
            mark = f"{path}/hooks/batch={batch}/{name}"
            if _there(spark, mark):
                continue
            try:
                hook(done, batch)
            except Exception:
                _log.exception("hook %s failed for batch %s", name, batch)
                continue
            spark.createDataFrame([(name, batch)], "hook string, done long").write.mode("overwrite").parquet(mark)

    return write


def deliveries(spark: SparkSession, path: str) -> DataFrame:
    """All rows that a sink has written: those of SCHEMA, and batch."""
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{path}/deliveries")

"""Deliveries of events to addresses: what is sent, what is tried again and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attempts, seconds before the next one and their bound, bytes of a payload.
MOST_ATTEMPTS, BACKOFF_SECONDS, MOST_BACKOFF_SECONDS, MOST_BYTES = 3, 0.25, 2.0, 10_000


def first_status(url: Column, payload: Column, most_bytes: int = MOST_BYTES) -> Column:
    """skipped without an address, failed with too large a payload, else pending."""
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "skipped").when(F.octet_length(payload) > most_bytes, "failed").otherwise("pending")


def waited(attempt: Column) -> Column:
    """Seconds between an event and its attempt (from 1): each wait is twice the one before, up to the bound."""
    waits = [min(MOST_BACKOFF_SECONDS, BACKOFF_SECONDS * 2**k) for k in range(MOST_ATTEMPTS - 1)]
    sums = [sum(waits[:k]) for k in range(MOST_ATTEMPTS)]
    return F.element_at(F.array(*map(F.lit, sums)), attempt)


def due(ts: Column, attempt: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), waited(attempt).cast("decimal(18,6)"))


def succeeded(code: Column) -> Column:
    return F.coalesce(code.between(200, 299), F.lit(False))


def attempts(events: DataFrame, answers: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """event_id, attempt, status (sent, failed or skipped), due_at, code and error: what became of each event (event_id, ts,
    url, payload), by the answers (event_id, attempt, code) to its attempts; no answer is a failure.

    An attempt is made where all before it failed, MOST_ATTEMPTS at the most; attempt 0 tells that none was made. Events and
    answers meet by key, and an event's few attempts are one window."""
    first = events.select("event_id", "ts", first_status(F.col("url"), F.col("payload"), most_bytes).alias("_status"))
    none = first.where("_status <> 'pending'").select("event_id", F.lit(0).alias("attempt"), F.col("_status").alias("status"), F.col("ts").alias("due_at"), F.lit(None).cast("int").alias("code"), F.when(F.col("_status") == "failed", "payload too large").otherwise("no address").alias("error"))
    tried = first.where("_status = 'pending'").select("event_id", "ts", F.explode(F.sequence(F.lit(1), F.lit(MOST_ATTEMPTS))).alias("attempt")).join(answers, ["event_id", "attempt"], "left")
    before = Window.partitionBy("event_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    made = tried.withColumn("_done", F.coalesce(F.max(succeeded(F.col("code")).cast("int")).over(before), F.lit(0))).where("_done = 0")
    error = F.when(F.col("code").isNull(), "no answer").when(~succeeded(F.col("code")), F.concat(F.lit("HTTP "), F.col("code")))
    return none.unionByName(made.select("event_id", "attempt", F.when(succeeded(F.col("code")), "sent").otherwise("failed").alias("status"), due(F.col("ts"), F.col("attempt")).alias("due_at"), F.col("code").cast("int").alias("code"), error.alias("error")))

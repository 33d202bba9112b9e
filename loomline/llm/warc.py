"""Content-addressed web archive.

write_archive() turns pages into WARC/1.1 records kept in two tables of one folder: `payloads` holds each distinct payload
once under its SHA-256 digest, `headers` holds the exact header bytes of every record. read_archive() joins them into the
original records, whose digests it verifies. Of records with equal payloads of at least SMALLEST_REVISIT bytes, the one
with the smallest page id is the response and the others revisit it.

The digest is the join key, so that no payload is shuffled twice; a payload that a third of all pages share is written
once, and the light header rows of a hot digest are what skewed joins split.

A record's id is made of page id and digest, and its date is the caller's (pages have none of their own).

Cases: a null html is an empty payload; a null url gives an empty target; rows without a page id come last in the order
and refer to nothing; repeated page ids give a record each (the first response among equals is any one of them). Pages
may be empty, and other columns are ignored. A payload that does not match its digest fails the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SMALLEST_REVISIT = 100
_CRLF = "\r\n"


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    light = source.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("length"))
    # one row a digest; partial aggregation folds a hot digest before the shuffle
    least = light.groupBy("digest").agg(F.min("page_id").alias("least"))
    typed = light.join(least, "digest").withColumn("revisits", (F.col("length") >= SMALLEST_REVISIT) & (F.col("page_id") > F.col("least")))
    headers = typed.select("page_id", "digest", _header(date).cast("binary").alias("header"))
    headers.write.parquet(f"{folder}/headers")
    source.groupBy("digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")


def _header(date: str) -> F.Column:
    def line(name: str, *value: F.Column) -> F.Column:
        return F.concat(F.lit(f"{name}: "), *value, F.lit(_CRLF))

    revisits = F.coalesce(F.col("revisits"), F.lit(False))
    # a line break within a URL would end the header line
    target = F.regexp_replace("url", r"[\r\n]", "")
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    return F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.when(revisits, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        F.when(revisits, F.concat(line("WARC-Refers-To", record_id(F.col("least"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisits, F.lit("0")).otherwise(F.col("length").cast("string"))),
        F.lit(_CRLF),
    )


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: its header fields, the payload's true length and digest, and `record`, the original bytes (a
    revisit has no block of its own)."""
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumnRenamed("digest", "stored").withColumn("computed", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    text = F.decode("header", "UTF-8")
    field = lambda name: F.nullif(F.regexp_extract(F.col("_text"), rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+):", 1).try_cast("long")
    parsed = headers.select("header", text.alias("_text")).select(
        "header",
        number(field("WARC-Record-ID")).alias("page_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract(field("WARC-Payload-Digest"), r"sha256:([0-9a-f]{64})", 1).alias("digest"),
        number(F.coalesce(field("WARC-Refers-To"), F.lit(""))).alias("refers_to"),
    )
    whole = parsed.join(payloads, parsed["digest"] == payloads["stored"], "left")
    # assert before use: a missing or altered payload is an error, not a row
    sound = F.when(F.col("computed") == F.col("digest"), F.col("computed")).otherwise(F.raise_error(F.concat(F.lit("payload missing or altered: "), F.col("digest"))))
    block = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return whole.select(
        "page_id",
        "target_uri",
        "record_type",
        "refers_to",
        F.col("size").alias("payload_bytes"),
        sound.alias("payload_digest"),
        "payload",
        F.concat(F.col("header"), block, F.lit(_CRLF * 2).cast("binary")).alias("record"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "warc")
    write_archive(common.read(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), m AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {SMALLEST_REVISIT} AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {SMALLEST_REVISIT} AND page_id > least THEN least END AS refers_to
FROM m
"""

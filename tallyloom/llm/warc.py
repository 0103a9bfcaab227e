"""Content-addressed web archive: payload bytes once for each digest, exact record headers apart.

An archive is two Parquet tables in one folder: payloads (digest, payload) and records (digest, header). A header is the
exact bytes of a WARC/1.1 record up to and with its empty line. Joining both on the digest gives the records
back byte for byte, and a revisit's full payload with them; every payload that is read is hashed again. A digest that
many records share is dealt over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialized, spread_join

#: Payloads of fewer bytes are stored as responses each time.
SMALL = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"


def _line(name: str, value: Column) -> Column:
    """A header line; none for a null value. Line ends inside a value are escaped, as they would end the line."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, digest, payload_bytes, record_type, refers_to and header of each row of pages (page_id, url, html).

    Null html is an empty payload, a null url leaves the target line out. Of equal payloads of at least SMALL bytes
    the one with the smallest page_id is the response and the others revisit it; null page_ids come last. Of rows that
    repeat the smallest page_id each is a response.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = materialized(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")))
    first = rows.where(F.col("payload_bytes") >= SMALL).groupBy("digest").agg(F.min("page_id").alias("first"))
    typed = spread_join(rows, first, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(again, PROFILE)),
        _line("WARC-Refers-To", F.when(again, _record_id(F.col("first")))),
        _line("Content-Type", F.lit("text/html;charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    return typed.select("digest", F.encode(header, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, out: str) -> None:
    """Write the two tables under the URI out. Payloads of one digest are reduced before the shuffle."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    kept = pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    kept.write.mode("overwrite").parquet(f"{out}/payloads")
    records(pages).write.mode("overwrite").parquet(f"{out}/records")


def read_archive(spark: SparkSession, out: str) -> DataFrame:
    """header, payload (full, of revisits too), record (the WARC record's exact bytes) and the header's fields."""
    rows = spread_join(spark.read.parquet(f"{out}/records"), spark.read.parquet(f"{out}/payloads"), "digest", "left")
    checked = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("a stored payload does not have the digest "), F.col("digest"))).cast("binary")
    )
    text = F.decode("header", "UTF-8")
    field = lambda name, value: F.nullif(F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1), F.lit(""))
    page = rf"<{_ID}([0-9-]+)>"
    parsed = rows.select(
        "header",
        checked.alias("payload"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Record-ID", page).cast("long").alias("page_id"),
        field("WARC-Refers-To", page).cast("long").alias("refers_to"),
        field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]{64})").alias("digest"),
    )
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return parsed.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))


def digests(archive: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from what was read back."""
    return archive.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


SQL = """
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN octet_length(encode(h)) >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
"""

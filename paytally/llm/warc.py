"""A content-addressed web archive: payload bytes once, record headers apart, records by joins.

An archive folder holds two tables. ``headers`` has the exact WARC header block of every record;
``payloads`` has each distinct payload once, under its SHA-256. A response and the revisits of
its payload share one stored copy, so a page copied a million times costs a million headers.
Copies are reduced inside each map task before anything is shuffled, and a digest that stands
for different bytes (by length or by a second hash) stops the writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytally.storage import write_once

#: Smaller payloads are stored once too, but never made revisits.
LEAST_REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"

PAYLOADS = "payload_digest string, payload binary"
HEADERS = "page_id string, payload_digest string, header string"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing when the value is null. A value cannot break out of its line."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def header(revisit: Column, page_id: Column, url: Column, digest: Column, size: Column, first: Column) -> Column:
    """The header block of one record, up to and with the empty line."""
    only = lambda value: F.when(revisit, value)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(page_id)),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _line("WARC-Refers-To", only(_urn(first))),
        _line("WARC-Profile", only(F.lit(PROFILE))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, folder: str) -> None:
    """Archive ``pages(page_id, url, html)``, one record a row, under ``folder``.

    Of records with equal payloads of at least ``LEAST_REVISIT_BYTES`` the one with the smallest
    page_id is the response and the others revisit it; rows that repeat that id are responses
    too. Null html is an empty payload, a null url leaves its line out, and a null page_id is
    never the smallest while another has the payload. No rows make two empty tables.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    check = F.struct(F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("hash"))
    rows = rows.withColumn("check", check)
    records = write_once(rows.drop("payload"), "records")
    groups = write_once(
        records.groupBy("payload_digest").agg(
            F.min("page_id").alias("first"), F.min("check").alias("low"), F.max("check").alias("high")
        ),
        "digests",
    )
    if not groups.where("low <> high").isEmpty():
        raise ValueError("one SHA-256 stands for different payloads")
    rows.groupBy("payload_digest").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    size = F.col("check.size")
    joined = records.join(groups.select("payload_digest", "first"), "payload_digest")
    revisit = (size >= LEAST_REVISIT_BYTES) & F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    joined.select(
        F.col("page_id").cast("string").alias("page_id"),
        "payload_digest",
        header(revisit, F.col("page_id"), F.col("url"), F.col("payload_digest"), size, F.col("first")).alias("header"),
    ).write.parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    """The value of a header line, or null."""
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, folder: str, page_id_type: str = "long") -> DataFrame:
    """The records of an archive, put together and checked.

    page_id, record_type, url, refers_to, header, payload, payload_bytes and payload_digest (both
    of the payload as read). A record whose payload is missing or has another digest than its
    header says is an error.
    """
    payloads = spark.read.schema(PAYLOADS).parquet(f"{folder}/payloads")
    payloads = payloads.select(
        F.col("payload_digest").alias("digest"),
        "payload",
        F.sha2("payload", 256).alias("found"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    headers = spark.read.schema(HEADERS).parquet(f"{folder}/headers").select("header")
    headers = headers.withColumn("stated", F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n", 1))
    joined = headers.join(payloads, headers.stated == payloads.digest, "left")
    digest = F.when(F.col("found") == F.col("stated"), F.col("found")).otherwise(
        F.raise_error(F.concat(F.lit("no valid payload for "), F.col("stated")))
    )
    number = lambda name: F.regexp_extract(_field(name), "^<urn:page:(.*)>$", 1)
    known = lambda c: F.when(c != "", c).cast(page_id_type)
    return joined.select(
        known(number("WARC-Record-ID")).alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("url"),
        known(number("WARC-Refers-To")).alias("refers_to"),
        "header",
        "payload",
        "payload_bytes",
        digest.alias("payload_digest"),
    )


def write_warc_files(records: DataFrame, path: str) -> None:
    """Plain WARC files of ``records`` (as ``read_archive`` gives them): header, block, two line ends.

    Revisit records have no block. Every record starts a line, so Spark's text sink writes it.
    """
    block = F.when(F.col("record_type") == "response", F.col("payload").cast("string")).otherwise("")
    records.select(F.concat("header", block, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").text(path)

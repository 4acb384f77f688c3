"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart, records rebuilt by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_skewed, release, session, shared_dir, stored

#: Payloads from this many bytes on are stored as response once and revisited by the other records.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(EOL))


def record_id(page_id: Column) -> Column:
    """A UUID (version 5 layout) of the page's id."""
    h = F.sha1(F.concat(F.lit("quire-warc:"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Writes ``path``/payloads (digest, strong, payload) and ``path``/headers (page_id, digest, strong, header).

    The address of a payload is its SHA-1, SHA-256 and length together, so a collision of one digest cannot merge two payloads.
    A header is the exact text of a WARC/1.1 record before its payload, a revisit's including WARC-Refers-To. Null html is empty;
    repeated rows give repeated records; a null page_id never becomes the response of a group that has another.
    """
    session(pages)
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    each = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload")).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    each = each.withColumn("strong", F.concat(F.sha2("payload", 256), F.lit(":"), F.col("n").cast("string")))
    # Equal addresses mean equal bytes, so any row's payload will do: each task sends one of a payload's copies, however many it has.
    each.groupBy("strong", "digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")

    # Payloads are read and hashed once more for this table; all else works on it.
    light = stored(each.select("page_id", "url", "digest", "strong", "n"), "warc-addresses")
    groups = stored(light.groupBy("strong").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")), "warc-groups")
    found = lookup_skewed(light, groups, "strong", "copies", F.coalesce(F.col("page_id"), F.lit(0)))
    revisit = (F.col("n") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", record_id(F.col("page_id"))), _line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url") != "", _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))).otherwise(""), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", record_id(F.col("first"))), _line("X-Refers-To-Page", F.col("first").cast("string")))).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n").cast("string"))), F.lit(EOL),
    )
    found.select("page_id", "digest", "strong", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    release(light, groups)


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, with page_id, what its header says, and payload_bytes and stored_digest computed from the stored payload.

    Each payload is hashed once where it lies; records get the result, not the bytes. A record whose header disagrees with the
    bytes, or whose payload is missing, has ``verified`` false.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    checked = payloads.select("strong", F.octet_length("payload").alias("payload_bytes"), F.sha1("payload").alias("stored_digest"), (F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload").cast("string")) == F.col("strong")).alias("sound"))
    headers = spark.read.parquet(f"{path}/headers")
    counts = headers.groupBy("strong").agg(F.count("*").alias("copies"))
    right = stored(counts.join(checked, "strong", "left"), "warc-checked")
    rows = lookup_skewed(headers, right, "strong", "copies", F.coalesce(F.col("page_id"), F.lit(0)))
    kind = _field("WARC-Type")
    return rows.select(
        "page_id", "header", "strong", F.col("payload_bytes").cast("long").alias("payload_bytes"), F.col("stored_digest").alias("payload_digest"), kind.alias("record_type"),
        F.when(kind == "revisit", _field("X-Refers-To-Page").cast("long")).alias("refers_to"),
        (F.coalesce("sound", F.lit(False)) & (F.concat(F.lit("sha1:"), F.col("stored_digest")) == _field("WARC-Payload-Digest"))).alias("verified"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the original records' bytes, header then payload then two line ends; a revisit has no payload."""
    headers, end = spark.read.parquet(f"{path}/headers"), F.encode(F.lit(EOL + EOL), "UTF-8")
    revisit = _field("WARC-Type") == "revisit"
    full = headers.where(~revisit)
    counts = full.groupBy("strong").agg(F.count("*").alias("copies"))
    # Only responses get payloads, and equal ones of a third of all records, which are short, go to as many tasks as their number needs.
    right = spark.read.parquet(f"{path}/payloads").select("strong", "payload").join(counts, "strong")
    rows = lookup_skewed(full, right, "strong", "copies", F.coalesce(F.col("page_id"), F.lit(0)))
    built = rows.select("page_id", F.concat(F.encode("header", "UTF-8"), F.col("payload"), end).alias("record"))
    return built.unionByName(headers.where(revisit).select("page_id", F.concat(F.encode("header", "UTF-8"), end).alias("record")))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """One row per page, from the archive read back. Null html is an empty payload, empty and short ones are responses of their own; of
    equal long ones the largest page_id is the response; repeated rows give repeated records; an empty table gives none; columns beside
    page_id, url and html are not looked at."""
    path = shared_dir(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT page_id, body, octet_length(body) AS n, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to, true AS verified FROM g
"""

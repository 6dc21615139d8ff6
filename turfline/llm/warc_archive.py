"""A content-addressed WARC archive.

``write`` keeps two tables in a folder: ``payloads``, every different payload once under its SHA-256, and ``headers``, the exact header block
of every record.  Of records with equal payloads of at least ``LEAST_SHARED`` bytes the one with the smallest id is the response
and the others revisit it; smaller payloads make responses only.  ``read`` joins the two back to whole records and checks every
payload against its digest.  Payload bytes combine before they are shuffled, and a digest of very many records is dealt
over several parts of the join.

Nulls: a null payload is empty, a null target has no target line; a record with a null id is a response without a record
id and is never referred to.  Rows that repeat an id and a payload are both responses, or both revisit the same record.  An empty
table gives an empty archive.  Extra columns are ignored by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SHARED = 100
#: Records of one digest that one part of the join restores.
RECORDS_PER_PART = 500
CRLF = "\r\n"
DATE = "2000-01-01T00:00:00Z"
_ID = "urn:page:"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _header(date: str) -> Column:
    target = F.regexp_replace(F.regexp_replace("target", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("refers_to").isNotNull()
    digest = F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))
    parts = [
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(_line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), F.col("id").cast("string"), F.lit(">"))), F.lit("")),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", target), F.lit("")),
        _line("WARC-Payload-Digest", digest),
        F.coalesce(_line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit(CRLF),
    ]
    return F.concat(*parts).cast("binary")


def write(records: DataFrame, folder: str, date: str = DATE) -> None:
    """Write ``records`` (id long, target string, payload string or binary) as an archive in ``folder``."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    keyed = records.select("id", "target", payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    store = keyed.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("records"), F.first("payload").alias("payload"))
    store.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    first = keyed.sparkSession.read.parquet(f"{folder}/payloads").select("digest", "first_id", "records")
    headers = keyed.select("id", "target", "digest", F.octet_length("payload").alias("size")).join(first, "digest")
    shared = (F.col("size") >= LEAST_SHARED) & (F.col("id") > F.col("first_id"))
    parts = F.ceil(F.col("records") / RECORDS_PER_PART)
    headers = headers.withColumn("refers_to", F.when(shared, F.col("first_id"))).select(
        "digest", F.pmod(F.xxhash64("id", "target"), parts).alias("part"), _header(date).alias("header"))
    headers.write.parquet(f"{folder}/headers")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(header binary, payload binary) of every record, with the payload also for revisits; a wrong payload is an error."""
    headers, store = spark.read.parquet(f"{folder}/headers"), spark.read.parquet(f"{folder}/payloads")
    checked = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("digest"))).cast("binary"))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("records") / RECORDS_PER_PART) - 1))
    store = store.select("digest", checked.alias("payload"), spread.alias("part"))
    return headers.join(store, ["digest", "part"]).select("header", "payload")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(record binary): the original records; a revisit has its own header and no payload."""
    body = F.when(field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return read(spark, folder).select(F.concat("header", body, F.lit(CRLF * 2).cast("binary")).alias("record"))


def field(name: str) -> Column:
    """A named field of the header block, or null.  A line starts after CR LF only, which no value can hold."""
    found = F.regexp_extract(F.col("header").cast("string"), f"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def page_id(name: str) -> Column:
    return F.regexp_extract(field(name), f"^<{_ID}(-?[0-9]+)>$", 1).cast("long")

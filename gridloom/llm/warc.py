"""Content-addressed WARC archive.

A record's exact header bytes (WARC and HTTP headers) are kept in one table; payload bytes are kept once per SHA-256 digest in another.
A record is put together again by joining them on the digest: header, payload of a response, two line ends. Before a
payload is stored for a digest, all payloads of that digest must agree in length and in a second, unrelated hash (xxhash64); they aren't compared byte by byte.

Of records with equal payloads of at least ``least_bytes`` bytes that with the smallest page_id is a response and the others are
revisits of it; shorter ones are responses all. Everything is DataFrame functions; payloads are shuffled once to the store and once
back from it, equal ones are combined before the shuffle, and the join back is one that the engine may split.

A record's id is made of its page_id and the payload's digest; a record without page_id has a random one.

Defined results: a null html is an empty payload; payloads of any length are stored whole; rows that repeat a page_id with another payload are records
of their own; rows that repeat a page_id and its payload are written each, with the same type and the same record id, as they are one record twice;
records without page_id are written, are never referred to and come back without it; line ends in a url are percent-encoded; an empty table gives
an empty archive; other columns, whatever their names, are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._shared import stored

END = "\r\n"


def _record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:gridloom:page:"), page_id.cast("string"), F.lit(":"), F.substring(digest, 1, 32), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes the tables headers (digest, header) and payloads (digest, payload, smallest page_id). pages: page_id, url, html."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload").cast("bigint"))
    # One payload for each digest, and what shows that all of them agree; combined before the payloads are shuffled.
    once = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("page_id").alias("first"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min(F.xxhash64("payload")).alias("x0"), F.max(F.xxhash64("payload")).alias("x1")
    )
    agree = (F.col("n0") == F.col("n1")) & (F.col("x0") == F.col("x1"))
    payload = F.when(agree, F.col("payload")).otherwise(F.raise_error(F.lit("different payloads have one digest")).cast("binary"))
    store = stored(once.select("digest", payload.alias("payload"), "first"), f"{folder}/payloads")
    records = rows.select("page_id", "url", "digest", "n").join(store.select(F.col("digest").alias("_d"), "first").hint("merge"), F.col("digest") == F.col("_d"))
    revisit = (F.col("n") >= least_bytes) & F.col("page_id").isNotNull() & F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("n").cast("string"), F.lit(END * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(_record_id(F.col("page_id"), F.col("digest")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    header = F.concat(F.concat_ws(END, *lines), F.lit(END * 2), http)
    stored(records.select("digest", F.encode(header, "UTF-8").alias("header")), f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """digest, header, record (the bytes of the whole record) and the full payload of every record."""
    headers = spark.read.schema("digest string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    met = headers.join(payloads.select(F.col("digest").alias("_d"), "payload").hint("merge"), F.col("digest") == F.col("_d"), "left")
    revisit = F.decode("header", "UTF-8").contains(f"{END}WARC-Type: revisit{END}")
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    return met.select("digest", "header", F.concat("header", body, F.lit((END * 2).encode())).alias("record"), "payload")


def parsed(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, from the records' own bytes.

    A revisit's payload is the stored one of its digest. Lengths and digests are counted anew and must be those the headers state.
    """
    head = F.decode("header", "UTF-8")
    field = lambda name, pattern="(.*)": F.regexp_extract(head, rf"(?s-m:^|\r\n){name}: {pattern}\r\n", 1)
    kind = field("WARC-Type", "([a-z]+)")
    own = F.substring("record", F.octet_length("header") + 1, F.octet_length("record") - F.octet_length("header") - 4)
    payload = F.when(kind == "revisit", F.col("payload")).otherwise(own)
    out = records.select(
        F.expr("try_cast(nullif(regexp_extract(decode(header, 'UTF-8'), '\\\\r\\\\nWARC-Record-ID: <urn:gridloom:page:([-0-9]*):', 1), '') as bigint)").alias("page_id"),
        F.regexp_extract(head, r"\r\nWARC-Target-URI: ([^\r\n]*)", 1).alias("url"),
        F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
        kind.alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(decode(header, 'UTF-8'), '\\\\r\\\\nWARC-Refers-To: <urn:gridloom:page:([-0-9]*):', 1), '') as bigint)").alias("refers_to"),
        F.regexp_extract(head, r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("_stated"),
    )
    true = F.when(F.col("payload_digest") == F.col("_stated"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload does not have its digest")).cast("string"))
    return out.withColumn("payload_digest", true).drop("_stated")

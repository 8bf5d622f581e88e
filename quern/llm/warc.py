"""Content-addressed web archive: payload bytes once by digest, exact record headers apart, records rebuilt by joins.

``write`` leaves two tables in the shared folder.  ``payloads`` holds every distinct payload once, under its SHA-256,
bucketed by it; rows that agree in the digest are checked to agree in length and SHA-1, too.  ``headers`` holds one
row for each record with the exact bytes of its WARC and HTTP headers.  ``read`` joins them back to whole records,
parses what it needs out of the record itself, and checks every digest against the bytes.

Payload bytes are shuffled once, after each task has dropped its own repeats, so a payload that a third of all pages
share costs as little as any other.  Reading joins a payload with its one response in place; revisits need no payload,
and short payloads, which may have many responses, go through a join of their own that can be split.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.tables import fresh_path, store

CRLF = "\r\n"


@dataclass(frozen=True)
class Plan:
    """Payloads of fewer than ``min_revisit`` bytes are never replaced by a revisit."""

    min_revisit: int = 1000
    date: str = "1970-01-01T00:00:00Z"
    agent: str = "quern"
    buckets: int | None = None


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame
    plan: Plan
    id_type: str


def _urn(value: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(value.cast("string")), F.lit("null+")), F.lit(">"))


def _id_of(urn: Column, kind: str) -> Column:
    """The id in a record name; a NULL id was written as ``null+``, which no encoded id can be."""
    name = F.regexp_extract(urn, "<urn:page:([^>]*)>", 1)
    return F.when((name != "null+") & (urn != ""), F.url_decode(name)).cast(kind)


def _header(plan: Plan) -> Column:
    """WARC header, and for responses the HTTP header, as they stand in the archive."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("id"))),
        F.lit(f"WARC-Date: {plan.date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("X-Payload-Length: "), F.col("n_bytes")),
        F.when(F.col("record_type") == "revisit", F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.when(F.col("record_type") == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    ]
    http = F.when(F.col("record_type") == "response", F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes"), F.lit(CRLF * 2)
    )).otherwise("")
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(0)
    lines += [F.lit("Content-Type: application/http; msgtype=response"), F.concat(F.lit("Content-Length: "), block)]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http).cast("binary")


def write(pages: DataFrame, id_col: str, url_col: str, text_col: str, plan: Plan = Plan()) -> Archive:
    """Archive every row of ``pages``; a NULL text is an empty payload.

    Of the records with one payload of at least ``plan.min_revisit`` bytes, those with the largest id are responses,
    the others revisit that id (a NULL id is smaller than any other; repeated rows of the largest id are all
    responses).  A NULL address leaves its header line out.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"),
    )
    buckets = plan.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = rows.groupBy("sha256").agg(
        F.first("payload").alias("payload"), F.min("sha1").alias("sha1"), F.max("sha1").alias("sha1_high"),
        F.min("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("n_bytes_high"),
    ).select(
        "sha256", "payload",
        F.when((F.col("sha1") != F.col("sha1_high")) | (F.col("n_bytes") != F.col("n_bytes_high")), F.raise_error(F.concat(
            F.lit("different payloads under digest "), F.col("sha256")
        ))).otherwise(F.col("n_bytes")).cast("long").alias("n_bytes"),
    )
    name = f"payloads_{uuid.uuid4().hex}"
    (
        kept.repartition(buckets, "sha256").write.format("parquet").option("path", fresh_path(spark, "payloads"))
        .bucketBy(buckets, "sha256").saveAsTable(name)
    )
    narrow = store(rows.drop("payload"), "records")
    owners = narrow.where(F.col("n_bytes") >= plan.min_revisit).groupBy("sha256").agg(F.max("id").alias("owner"), F.count("*").alias("n"))
    owners = store(owners.where("n > 1").drop("n"), "owners")
    response = (F.col("n_bytes") < plan.min_revisit) | F.col("owner").isNull() | F.col("id").eqNullSafe(F.col("owner"))
    headers = narrow.join(owners, "sha256", "left").withColumn(
        "record_type", F.when(response, "response").otherwise("revisit")
    ).withColumn("refers_to", F.when(~response, F.col("owner")))
    headers = headers.select("sha256", (F.col("n_bytes") < plan.min_revisit).alias("short"), "record_type", _header(plan).alias("header"))
    return Archive(store(headers, "headers"), spark.table(name), plan, pages.schema[id_col].dataType.simpleString())


def records(archive: Archive) -> DataFrame:
    """``(sha256, header, payload, record)``: every record's exact bytes; a revisit has no payload of its own."""
    heads, bodies = archive.headers, archive.payloads
    floor = archive.plan.min_revisit
    alone = heads.where("record_type = 'response' AND NOT short").join(bodies.where(F.col("n_bytes") >= floor), "sha256")
    # Short payloads may have a great many responses; both sides move, so that a hot one can be split.
    small = store(bodies.where(F.col("n_bytes") < floor).select("sha256", "payload"), "short-payloads")
    many = heads.where("record_type = 'response' AND short").join(small, "sha256")
    bare = heads.where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("binary"))
    return alone.select("sha256", "header", "payload").unionByName(many.select("sha256", "header", "payload")).unionByName(
        bare.select("sha256", "header", "payload")
    ).withColumn("record", F.concat("header", F.coalesce("payload", F.lit(b""))))


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"(?m)^{name}: ([^\r\n]*)", 1)


def read(archive: Archive) -> DataFrame:
    """``(id, url, record_type, refers_to, payload_bytes, payload_digest)``, parsed out of the rebuilt records.

    The figures of a response are taken from its own bytes and must agree with its header; a revisit carries those of
    the payload it refers to.
    """
    text = F.decode(F.col("record"), "UTF-8")
    whole = records(archive).select(
        F.substring_index(text, CRLF * 2, 1).alias("head"), F.octet_length("record").alias("n_record"),
        F.octet_length("payload").cast("long").alias("n_payload"), F.sha1("payload").alias("sha1"),
    )
    parsed = whole.select(
        _id_of(_field("WARC-Record-ID"), archive.id_type).alias("id"), F.nullif(_field("WARC-Target-URI"), F.lit("")).alias("url"),
        _field("WARC-Type").alias("record_type"), _id_of(_field("WARC-Refers-To"), archive.id_type).alias("refers_to"),
        _field("X-Payload-Length").cast("long").alias("payload_bytes"), F.substring(_field("WARC-Payload-Digest"), 6, 40).alias("payload_digest"),
        _field("Content-Length").cast("long").alias("n_block"), "n_payload", "sha1", "n_record", F.octet_length("head").alias("n_head"),
    )
    broken = (F.col("n_head") + 4 + F.col("n_block") != F.col("n_record")) | (
        F.col("n_payload").isNotNull() & ((F.col("n_payload") != F.col("payload_bytes")) | (F.col("sha1") != F.col("payload_digest")))
    )
    checked = F.when(broken, F.raise_error(F.concat(F.lit("damaged record of page "), F.col("id").cast("string")))).otherwise(F.col("payload_digest"))
    return parsed.select("id", "url", "record_type", "refers_to", "payload_bytes", checked.cast("string").alias("payload_digest"))


def export(archive: Archive, folder: str) -> None:
    """Write the records as WARC text files; the separator of the lines is the end of a record."""
    records(archive).select(F.decode("record", "UTF-8").alias("record")).write.option("lineSep", CRLF * 2).text(folder)

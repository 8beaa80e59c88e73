"""Content-addressed WARC archives: payloads once by digest, exact record headers apart."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, small, trimmed

CRLF = "\r\n"
END = CRLF + CRLF
#: Payloads below this are never revisited.
MIN_SHARED_BYTES = 1000
#: Records in a WARC file at most.
FILE_RECORDS = 20_000


def plan_records(pages: DataFrame, scratch: Scratch, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_key (SHA-256), payload_digest (SHA-1), payload_bytes, record_type, refers_to, owner, copies.

    Of pages with equal payloads of at least MIN_SHARED_BYTES, that with the largest id
    is a response, and the others revisit it; rows that tie for the largest id are all
    responses, as are rows of a group without any id. ``copies`` is null for a payload
    that occurs once. Groups are found from digests alone; payloads are shuffled only if
    the groups of copies are too many to broadcast.
    """
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text.alias("payload"))
    rows = rows.withColumns({"payload_key": F.sha2(F.col("payload").cast("binary"), 256), "payload_digest": F.sha1(F.col("payload").cast("binary")), "payload_bytes": F.octet_length("payload").cast("long")})
    groups = scratch.keep(rows.groupBy("payload_key").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "copies")
    joined = rows.join(small(groups, 96), "payload_key", "left")
    revisit = (F.col("payload_bytes") >= MIN_SHARED_BYTES) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("owner"))})


def _header():
    """The exact header block of a record, without the empty line that ends it."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[\\r\\n]+", " ")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Key: sha256:"), F.col("payload_key")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat_ws(CRLF, *lines)


def write_archive(pages: DataFrame, path: str, **columns: str) -> None:
    """Write a record for every page: ``path``/headers has each exact header block, ``path``/payloads each payload once.

    Null html is an empty payload, null ids and urls are kept, repeated rows give a
    record each, other columns are ignored, an empty table gives an empty archive.
    """
    records = plan_records(pages, Scratch(pages.sparkSession), **columns)
    records.select("page_id", _header().alias("header"), "payload_key").write.option("compression", "zstd").parquet(f"{path}/headers")
    once = records.filter("copies IS NULL").select("payload_key", "payload")
    copied = records.filter(F.col("copies").isNotNull() & F.col("page_id").eqNullSafe(F.col("owner"))).select("payload_key", "payload").dropDuplicates(["payload_key"])
    once.unionByName(copied).select("payload_key", F.col("payload").cast("binary").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload_key, and what the header says: record_type, refers_to, payload_digest."""
    said = lambda field, value: F.regexp_extract("header", f"(?m)^{field}{value}", 1)
    return spark.read.parquet(f"{path}/headers").withColumns({"record_type": said("WARC-Type: ", "(\\w+)"), "refers_to": F.nullif(said("WARC-Refers-To: <urn:page:", "(-?\\d+)>"), F.lit("")).cast("long"), "payload_digest": said("WARC-Payload-Digest: sha1:", "([0-9a-f]{40})")})


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """payload_key, payload; a payload that differs from its key fails the read."""
    sound = F.when(F.sha2("payload", 256) == F.col("payload_key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("payload_key"))).cast("binary"))
    return spark.read.parquet(f"{path}/payloads").select("payload_key", sound.alias("payload"))


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload, record: the bytes of each original WARC record, and the payload it holds (none in a revisit).

    Responses are joined with the payload that their key names; one that has none fails
    the read. Revisits need no payload, so a payload that many pages share is read once.
    """
    headers = read_headers(spark, path).select("page_id", "header", "record_type", "payload_key")
    held = headers.filter("record_type <> 'revisit'").join(read_payloads(spark, path), "payload_key", "left")
    there = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for "), F.col("header"))).cast("binary"))
    rows = held.select("page_id", "header", there.alias("payload")).unionByName(headers.filter("record_type = 'revisit'").select("page_id", "header", F.lit(None).cast("binary").alias("payload")))
    end = F.lit(END.encode())
    return rows.withColumn("record", F.concat(F.col("header").cast("binary"), end, F.coalesce("payload", F.lit(b"")), end)).drop("header")


def export_files(spark: SparkSession, path: str, to: str) -> None:
    """The archive as compressed WARC files of FILE_RECORDS at most: each record, then the two line ends that close it."""
    lines = rebuild(spark, path).select(F.expr("substring(cast(record as string), 1, char_length(cast(record as string)) - 4)").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(to)


RECORD = "page_id long, record_type string, refers_to long, payload_key string, payload_digest string, header string, payload binary"
_FIELDS = {"record_type": "WARC-Type: ", "page_id": "WARC-Record-ID: <urn:page:", "refers_to": "WARC-Refers-To: <urn:page:", "payload_key": "X-Payload-Key: sha256:", "payload_digest": "WARC-Payload-Digest: sha1:", "size": "Content-Length: "}


def _parsed(header: str) -> dict[str, str]:
    """The fields of a header block by the names of _FIELDS; the first line of each counts."""
    out: dict[str, str] = {}
    for line in header.split(CRLF):
        for name, start in _FIELDS.items():
            if line.startswith(start):
                out.setdefault(name, line[len(start) :].rstrip(">"))
    return out


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of compressed WARC files: what their headers say, the exact header, and the bytes behind it.

    A file is read as a stream by content length. A response whose bytes don't have the
    digest that its header names fails the read, and so does a file that ends within a
    record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = bytearray()
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                buffer += value.encode() + END.encode()
                while True:
                    start = 0
                    while buffer[start : start + 2] == b"\r\n":
                        start += 2
                    stop = buffer.find(END.encode(), start)
                    if stop < 0:
                        break
                    header = buffer[start:stop].decode()
                    said = _parsed(header)
                    size = int(said["size"])
                    if len(buffer) < stop + 4 + size + 4:
                        break
                    payload = bytes(buffer[stop + 4 : stop + 4 + size])
                    if said["record_type"] == "response" and sha1(payload).hexdigest() != said["payload_digest"]:
                        raise ValueError(f"a record's bytes are not what its header says: {header}")
                    number = lambda x: int(x) if x not in (None, "none") else None
                    rows.append((number(said["page_id"]), said["record_type"], number(said.get("refers_to")), said["payload_key"], said["payload_digest"], header, payload))
                    del buffer[: stop + 4 + size + 4]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORD.split(", ")])
        if buffer.strip():
            raise ValueError("a WARC file ends within a record")

    bound_batches(spark)
    return spark.read.option("lineSep", END).text(path).mapInArrow(trimmed(run), RECORD)


def read_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of imported records, both of the full payload.

    A response has its payload, which the import has verified; a revisit takes the figures
    of the payload that it names by key, from the response that holds it. A revisit whose
    payload is missing or has another digest fails the read.
    """
    scratch = Scratch(records.sparkSession)
    known = scratch.keep(records.select("page_id", "record_type", "refers_to", "payload_key", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    named = known.filter("record_type = 'revisit'").select("payload_key").distinct()
    held = scratch.keep(known.filter("record_type = 'response'").join(named, "payload_key", "left_semi").groupBy("payload_key").agg(F.max("payload_bytes").alias("held_bytes"), F.max("payload_digest").alias("held_digest")), "payloads")
    joined = known.join(small(held, 120), "payload_key", "left")
    sound = (F.col("record_type") == "response") | F.col("held_digest").eqNullSafe(F.col("payload_digest"))
    digest = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("no payload for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    return joined.select("page_id", F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.col("held_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")

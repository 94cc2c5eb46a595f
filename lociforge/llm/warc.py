"""WARC files: one transaction of three records a page, and its assembly on reading.

Writing is native: the header and block of each record are built as strings
and written by the text writer with the record terminator CR LF CR LF as its
line separator, so that the parts are valid WARC/1.1 (gzipped).  Reading parses
the bytes by Content-Length, so payloads may hold any text.  Response or
revisit, request and metadata records meet through WARC-Concurrent-To; a
revisit is resolved by its payload digest, as its profile says.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads from this many bytes on are stored once.
REVISIT_FROM = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_type string, record_id string, capture_id string, target string, date string, digest string, page_id long, url string, head string, payload string, payload_bytes long, payload_digest string, digest_ok boolean"
#: Compressed bytes inflated at a time.
STEP = 1 << 20


def _record(kind: Column, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), rid, F.lit("\r\n"))]
    lines += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def transactions(pages: DataFrame, revisit_from: int = REVISIT_FROM, page: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record a row (column `value`, without its terminator): request, response or revisit, and metadata of every page.

    The payload is the html in UTF-8, null counting as empty.  Of pages with
    equal payloads of revisit_from bytes or more the one with the largest id
    (null lowest) is the response.  Repeated rows are captures of their own; a
    repeated row of the response is a response too.  Null urls are written as
    urn:none.  An empty table gives no rows; other columns are left out.
    """
    p = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    p = p.withColumn("_n", F.octet_length("html")).withColumn("_key", F.sha2(F.encode("html", "utf-8"), 256))
    best = p.where(F.col("_n") >= revisit_from).groupBy(F.col("_key").alias("_k")).agg(F.max("page_id").alias("_best"), F.count("*").alias("_times")).where("_times > 1")
    p = p.join(best, F.col("_key") == F.col("_k"), "left")
    p = p.withColumn("_again", F.col("_k").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best")))
    for name in ("_rid", "_qid", "_mid"):
        p = p.withColumn(name, F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))
    target = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("urn:none"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", target)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_n").cast("string"), F.lit("\r\n\r\n"))
    main = _record(
        F.when(F.col("_again"), F.lit("revisit")).otherwise(F.lit("response")),
        F.col("_rid"),
        [*common, ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_key"))), ("WARC-Profile", F.when(F.col("_again"), F.lit(PROFILE))), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(http, F.when(F.col("_again"), F.lit("")).otherwise(F.col("html"))),
    )
    request = _record(
        F.lit("request"),
        F.col("_qid"),
        [*common, ("WARC-Concurrent-To", F.col("_rid")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    fields = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in (("page-id", F.col("page_id").cast("string")), ("source-url", F.url_encode("url")))]
    meta = _record(
        F.lit("metadata"), F.col("_mid"), [*common, ("WARC-Concurrent-To", F.col("_rid")), ("Content-Type", F.lit("application/warc-fields"))], F.concat(*fields)
    )
    return p.select(F.explode(F.array(request, main, meta)).alias("value"))


def write_warc(pages: DataFrame, path: str, records_a_file: int = 20_000, **options) -> None:
    """Writes gzipped WARC files below path, which must not exist.

    A null html is an empty payload; equal payloads of any number stay
    transactions of their own; without pages there are no records.
    """
    transactions(pages, **options).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def records(content: bytes):
    """(headers, block) of each record of a WARC file, gzipped (in one or many members) or plain.

    Inflates and cuts as it goes: besides the file, one record is held.
    """
    packed = content[:2] == b"\x1f\x8b"
    at, buffer, inflate = 0, b"", zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, buffer, inflate
        if at >= len(content):
            return False
        piece = content[at : at + STEP]
        at += len(piece)
        if packed:
            out = inflate.decompress(piece)
            while inflate.eof and (rest := inflate.unused_data):
                inflate = zlib.decompressobj(31)
                out += inflate.decompress(rest)
            piece = out
        buffer += piece
        return True

    pos = 0
    while True:
        while (end := buffer.find(b"\r\n\r\n", pos)) < 0:
            if not more():
                return
        lines = buffer[pos:end].decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        while len(buffer) < stop + 4 and more():
            pass
        yield headers, buffer[start:stop]
        pos = stop + 4
        if pos > STEP:
            buffer, pos = buffer[pos:], 0


def _rows(content: bytes, payloads: bool):
    for h, block in records(content):
        kind = h["WARC-Type"]
        row = {"record_type": kind, "record_id": h["WARC-Record-ID"], "capture_id": h.get("WARC-Concurrent-To", h["WARC-Record-ID"]), "target": h.get("WARC-Target-URI"), "date": h.get("WARC-Date")}
        if kind == "metadata":
            fields = dict(x.split(": ", 1) for x in block.decode("utf-8").split("\r\n") if ": " in x)
            row["page_id"] = int(fields["page-id"]) if "page-id" in fields else None
            row["url"] = unquote_plus(fields["source-url"]) if "source-url" in fields else None
        else:
            head, _, payload = block.partition(b"\r\n\r\n")
            row["head"] = head.decode("utf-8", "replace")
            if kind in ("response", "revisit"):
                row["digest"] = h.get("WARC-Payload-Digest", "").removeprefix("sha256:")
            if kind == "response":
                row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "digest_ok": hashlib.sha256(payload).hexdigest() == row["digest"]}
                if payloads:
                    row["payload"] = payload.decode("utf-8")
        yield row


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the WARC files below path, a row a record.

    A record without Content-Length is an error, and a file that ends inside a
    record gives what is there of it.  Files without records give no rows.
    """
    schema = spark.createDataFrame([], RECORDS).schema
    arrow = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in schema])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for row in _rows(content.as_py(), payloads):
                    held.append(row)
                    size += row.get("payload_bytes") or 0
                    if len(held) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, schema)


def captures(found: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit with request and metadata, joined through the concurrent-to ids.

    A capture without a request or metadata record has null there; records
    that are concurrent to no response or revisit are left out.
    """
    part = lambda kinds, *cols: F.max(F.when(F.col("record_type").isin(*kinds), F.struct("record_id", *cols)))
    out = found.groupBy("capture_id").agg(
        part(("response", "revisit"), "record_type", "digest", "date", "target", "head", "payload", "payload_bytes", "payload_digest", "digest_ok").alias("response"),
        part(("request",), "head").alias("request"),
        part(("metadata",), "page_id", "url").alias("metadata"),
    )
    return out.where("response is not null")


def resolve(joined: DataFrame) -> DataFrame:
    """captures() with refers_to, and for revisits the payload's size, digest and text from the response with the same payload digest.

    Of responses that share a digest the one of the largest page_id is meant;
    a revisit without any has nulls.
    """
    found = joined.where("response.record_type = 'response'").groupBy(F.col("response.digest").alias("_digest")).agg(
        F.max(F.struct(F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("bytes"), F.col("response.payload_digest").alias("sha1"), F.col("response.payload").alias("payload"))).alias("_first")
    )
    again = F.col("response.record_type") == "revisit"
    out = joined.join(found, again & (F.col("response.digest") == F.col("_digest")), "left")
    pick = lambda own, other: F.when(again, F.col(f"_first.{other}")).otherwise(F.col(f"response.{own}"))
    return out.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("metadata.url").alias("url"),
        F.col("response.record_type").alias("record_type"),
        F.when(again, F.col("_first.page_id")).alias("refers_to"),
        pick("payload_bytes", "bytes").alias("payload_bytes"),
        pick("payload_digest", "sha1").alias("payload_digest"),
        pick("payload", "payload").alias("payload"),
        "request",
        "response",
        "metadata",
    )

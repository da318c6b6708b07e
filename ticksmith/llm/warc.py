"""WARC archives with revisit resolution.

Record headers (digest, page_id), without payloads, are grouped by payload digest; of equal payloads the record with
the largest page_id is the response, the others become revisits that refer to it, with fresh headers. Archives are
written by Spark's text sink with the record separator as line separator, so they go to any file system that Spark
writes, under its commit protocol; a file is a sequence of whole WARC/1.1 records, compressed by file on request.

The reader splits files at the version line and joins pieces again until a record has as many bytes as its
Content-Length says, so payloads may hold the version line or blank lines. It recomputes digests of responses and
resolves revisits by joining headers to the responses that they refer to.

Defined results: null html is an empty payload. Equal payloads under ``min_bytes`` are all responses. Of rows with the
largest page_id and equal payloads one, by input place, is the response. Null page_ids come lowest; a revisit of a
response with a null id refers to null. A null url is written as ``about:blank``; line breaks in urls are
percent-encoded. An empty table gives archives without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticksmith.llm.storage import remove, shared_dir, stored, written

VERSION, CRLF = "WARC/1.1", "\r\n"
#: A fixed date, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1: four groups of 40 bits, each eight digits."""
    hexes = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexes, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def numbered(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, uid, digest, n); uid is the row's place, so it must be stored before it is used twice."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    return rows.withColumns({"uid": F.monotonically_increasing_id(), "digest": base32_sha1(F.col("payload").cast("binary")), "n": F.octet_length("payload").cast("long")})


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages with digest, record_type and refers_to.

    ``pages``: as ``numbered`` gives them. The grouping shuffles headers only and combines on the map side. Digests that
    occur twice are joined back to the pages: where Spark can't broadcast them by size, pages move once with their
    payloads. A digest that a third of all pages share is then a skewed key of the streamed side, which adaptive
    execution splits.
    """
    rows = pages
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("key"), "uid", "page_id", "url")
    shared = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(shared.select("digest", "first"), "digest", "left")
    again = F.col("first").isNotNull() & (F.col("n") >= min_bytes) & (F.col("uid") != F.col("first.uid"))
    return joined.select("page_id", "uid", "url", "payload", "n", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("original"))


def _record_id(uid: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), uid.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    return F.replace(F.replace(F.coalesce(F.when(url != "", url), F.lit("about:blank")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record_text(resolved: DataFrame) -> DataFrame:
    """One WARC record a row, without the separator that ends it."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    origin = F.col("original")
    head = [
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("uid"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _uri(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(origin["uid"])), line("WARC-Refers-To-Target-URI", _uri(origin["url"])), line("WARC-Refers-To-Date", F.lit(DATE)))).otherwise(F.lit("")),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    ]
    return resolved.select(F.concat(*head).alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, compression: str = "gzip") -> None:
    """Pages are stored with their numbers for as long as archives are written: a lost executor can't number them anew."""
    rows, kept = stored(numbered(pages), "warc-pages")
    record_text(resolve(rows, min_bytes)).write.option("lineSep", CRLF * 2).option("compression", compression).text(path)
    remove(pages.sparkSession, kept)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from pieces in file order; each file begins with an empty piece before its first version line."""
    names = ["record_id", "page_id", "record_type", "refers_to_id", "stated", "digest", "n"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    mark = (VERSION + CRLF).encode()
    held: list[bytes] = []
    want, size = None, 0

    def record(data: bytes) -> tuple:
        head, _, block = data.partition(b"\r\n\r\n")
        given = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split(CRLF))}
        block = block[: int(given["content-length"])]
        payload = block.partition(b"\r\n\r\n")[2]
        kind = given["warc-type"]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        stated = given["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and digest != stated:
            raise ValueError(f"payload of {given['warc-record-id']} doesn't match its digest")
        page_id = int(given["x-page-id"]) if "x-page-id" in given else None
        return given["warc-record-id"], page_id, kind, given.get("warc-refers-to"), stated, digest, len(payload)

    for batch in batches:
        rows = []
        for piece in batch.column(0).to_pylist():
            if want is None:
                if not piece:
                    continue
                head, _, _ = piece.partition(b"\r\n\r\n")
                length = next(int(x[15:]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                want, held, size = len(head) + 4 + length + 4, [piece], len(piece)
            else:
                held += [mark, piece]
                size += len(mark) + len(piece)
            if size >= want:
                rows.append(record(b"".join(held)))
                want, held = None, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
    if want is not None:
        raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; revisits are resolved.

    Compressed files aren't split, so each file's pieces pass one task in order. Archives are read once: headers are
    stored, and they alone are joined.
    """
    pieces = spark.read.option("lineSep", VERSION + CRLF).text(path).select(F.col("value").cast("binary").alias("value"))
    records = written(pieces.mapInArrow(_parse, "record_id string, page_id long, record_type string, refers_to_id string, stated string, digest string, n long"), "warc-headers")
    responses = records.where("record_type = 'response'")
    originals = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("digest").alias("found"), F.col("n").alias("found_n"))
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    proven = F.when(F.col("found") == F.col("stated"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("revisit without its response: "), "record_id")))
    return responses.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("found_n").alias("payload_bytes"), proven.alias("payload_digest"), "record_type", "refers_to")
    )


def write_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)

"""WARC: archives of captures, and their assembly from request, response and metadata records.

A page becomes three records: the request, the response (or a revisit, if the same payload was captured under a smaller number)
and metadata; request and metadata name the response in WARC-Concurrent-To.  Spark's text writer writes the archives: a row
is a record and the row end is the record end, so any file system that Spark reaches can hold them, and a lost task is
written anew.  Archives are bounded by bytes: payloads are dealt by their size into classes, and an archive of a class holds so many records that
it stays under ``ARCHIVE`` bytes (one of payloads over that holds one capture).  Archives are read whole, parsed by
Content-Length, and joined by identifiers into one nested row per capture.  What stands behind a damaged place of an archive can't be told
apart any more: the records before it are read, and one row of type ``damaged`` says so.

Payloads under 100 bytes are always responses.  Nulls: a null payload is empty, a null URL is given as ``urn:page``; a null
page_id comes back null and is larger than any number.  Pages with the same page_id and payload are captures of their own: the first
row is the response.  A record may be concurrent to several others.  Empty tables give empty archives.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm.common import new_path, small_batches, table, written

LEAST = 100
#: Bytes of an archive, about; payloads up to these sizes share archives, larger ones have their own.
ARCHIVE = 64 << 20
CLASSES = (16 << 10, 256 << 10, 4 << 20, ARCHIVE)
#: Bytes of the headers of a capture's three records, about.
HEADERS = 2048
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LAST = 2**63 - 1


# ---------------------------------------------------------------- writing
def identifier(kind: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), row.cast("string")).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def record(fields: list[tuple[str, Column | None]], block: Column) -> Column:
    """A record without its end: header fields (left out where null), length and block."""
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*lines)


def classed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, size, _row and _first (row of the response that a revisit refers to, else null)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumns({"_row": F.monotonically_increasing_id(), "digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload").cast("long")})
    p = written(p, "pages")  # row numbers are drawn once: drawn again over fewer columns they could fall otherwise
    keys = p.select("page_id", "_row", "digest", "size")
    least = F.min(F.struct(F.coalesce("page_id", F.lit(LAST)).alias("id"), F.col("_row").alias("row")))
    groups = keys.where(F.col("size") >= LEAST).groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select("digest", F.col("first.row").alias("first")), "payload-groups")
    again = written(keys.join(groups, "digest").where("_row <> first").select(F.col("_row").alias("_r"), "first"), "revisits")
    return p.join(again, p["_row"] == again["_r"], "left").drop("_r")


def records(p: DataFrame) -> DataFrame:
    """One row per record of classed pages, in the order request, response, metadata."""
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:page")), r"[\x00-\x20\x7f]", "%20")
    row, first = F.col("_row"), F.col("first")
    common = [("WARC-Target-URI", url), ("WARC-Date", F.lit(DATE))]
    main = identifier("response", row)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    head = lambda kind, own: [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", own), *common]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"))
    kind = ("Content-Type", F.lit("application/http;msgtype=response"))
    response = record([*head("response", main), digest, kind], F.concat(http, "payload"))
    revisit = record([*head("revisit", main), digest, ("WARC-Refers-To", identifier("response", first)), ("WARC-Profile", F.lit(SAME)), kind], http)
    request = record(
        [*head("request", identifier("request", row)), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nAccept: text/html\r\n\r\n")),
    )
    metadata = record(
        [*head("metadata", identifier("metadata", row)), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    return p.select(F.explode(F.array(request, F.when(first.isNull(), response).otherwise(revisit), metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """A folder of archives for every class of sizes that occurs."""
    p = classed(pages)
    largest = p.agg(F.max("size")).first()[0] or 0
    low = -1
    for k, high in enumerate((*CLASSES, 2**62)):
        if k and low >= largest:
            break
        captures_ = max(1, ARCHIVE // (min(high, ARCHIVE) + HEADERS))
        some = p.where((F.col("size") > low) & (F.col("size") <= high))
        records(some).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_).text(f"{path}/class-{k}")
        low = high


# ---------------------------------------------------------------- reading
def inflated(data: bytes) -> tuple[bytes, bool]:
    """(content, whole) of gzip members one behind the other; of a damaged one what could be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        try:
            out.append(z.decompress(data))
        except zlib.error:
            return b"".join(out), False
        if not z.eof:
            return b"".join(out), False
        data = z.unused_data
    return b"".join(out), not data.strip(b"\0")


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes] | None]:
    """(header fields by lower-cased name, block) of the records of an archive, compressed as a whole or by record; None where it is damaged."""
    whole = True
    if data[:2] == b"\x1f\x8b":
        data, whole = inflated(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        lines = data[start : max(end, start)].decode("utf-8", "replace").split("\r\n")[1:]
        fields: dict[str, list[str]] = {}
        for name, _, value in (x.partition(":") for x in lines):
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = fields.get("content-length", ["?"])[0]
        if end < 0 or not size.isdecimal() or end + 4 + int(size) > len(data) or "warc-type" not in fields or "warc-record-id" not in fields:
            whole = False
            break
        yield fields, data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size) + 4
    if not whole:
        yield None


RECORD = "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, page_id long, payload binary"


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record.  Digests and sizes of responses are taken from what was read, those of revisits from their header."""
    small_batches(spark, 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for record_ in parse(content.as_py()):
                    if record_ is None:
                        rows.append((None, "damaged", *[None] * 8))
                        continue
                    f, block = record_
                    one = lambda name, f=f: f.get(name, [None])[0]
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = size = page = kept = None
                    kind = one("warc-type")
                    if kind == "response":
                        digest, size, kept = hashlib.sha256(body).hexdigest(), len(body), body
                    elif kind == "revisit":
                        digest = (one("warc-payload-digest") or "").partition(":")[2] or None
                        size = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    elif kind == "metadata":
                        page = next((x.partition(b":")[2].strip() for x in block.split(b"\r\n") if x.startswith(b"pageId:")), b"")
                        page = int(page) if page else None
                    rows.append((one("warc-record-id"), kind, f.get("warc-concurrent-to"), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), digest, size, page, kept if payloads else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 10
                kinds = [pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.binary()]
                names = [x.split()[0] for x in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(read, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row per capture: response (or revisit) with the request and the metadata that were concurrent to it."""
    fields = [c for c in found.columns if c != "concurrent_to"]
    nest = lambda d, name: d.select(F.explode("concurrent_to").alias(f"_{name}"), F.struct(*fields).alias(name))
    main = found.where("type in ('response', 'revisit')").select("record_id", F.struct(*fields).alias("response"))
    request = nest(found.where("type = 'request'"), "request")
    metadata = nest(found.where("type = 'metadata'"), "metadata")
    joined = main.join(request, main.record_id == request._request, "left").join(metadata, main.record_id == metadata._metadata, "left")
    return joined.select("record_id", "request", "response", "metadata")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = written(read_records(spark, path), "records")
    small_batches(spark)
    c = captures(found).select(
        F.col("metadata.page_id").alias("page_id"), "record_id", F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("_to"),
    )
    c = written(c, "captures")
    named = c.where("_to is not null").select("record_id", F.col("_to"))
    origin = written(c.join(named.select("_to").distinct().withColumnRenamed("_to", "_o"), F.col("record_id") == F.col("_o"), "left_semi").select(F.col("record_id").alias("_o"), F.col("page_id").alias("refers_to")), "origins")
    return c.join(origin, F.col("_to") == F.col("_o"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

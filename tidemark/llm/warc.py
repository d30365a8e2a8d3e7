"""Web archives: writing captures as WARC records, reading them back, and joining records to captures.

*Writing.*  A capture is three records: the request, the response (or a revisit of an earlier equal payload), and the metadata;
request and metadata name the response in ``WARC-Concurrent-To``.  Records are made by column expressions and written by Spark's text
writer, records apart by an empty line as the format wants, one gzip stream per file, ``RECORDS_PER_FILE`` at most.

*Reading.*  Each file is one row of the binary reader; a task unpacks it as a stream, one record in memory at a time, by the lengths
in the headers, so payloads may hold anything.  Archives of other writers are read too, with one gzip member per record or none.

*Assembly.*  Records meet by transaction, ``coalesce(concurrent-to, record id)``, in one aggregate that combines before the shuffle;
a group is one capture.  Revisits then look up the capture they refer to in a join whose large side Spark may split.

Defined results: a null or empty body is an empty payload; a null url is an empty one; of equal payloads from ``MIN_REVISIT`` bytes on,
the row with the largest (page id, digest of the url) is the response, a null id being the smallest; rows equal in all columns are
captures of their own; a null page id stays null; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir

# The functions of this module travel with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_REVISIT = 1000
RECORDS_PER_FILE = 30_000
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20

RECORD_SCHEMA = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, http_length long, "
    "fields array<struct<name:string,value:string>>, payload_bytes long, payload_digest string, payload binary"
)


def _urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without the empty line behind it; a null header is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Each page with its digest, its own key and, for a revisit, the key of the response it refers to.

    Only digests and keys are grouped; the winner of a digest comes back by a join in which a digest of a third of all rows can be split.
    """
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\x00-\\x20\\x7F]", "").alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).alias("body"),
    ).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    # a key that a repeated reading of the row gives again; equal rows are told apart by their place in the input
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("page").cast("string"), F.lit("")), F.sha1(F.col("url").cast("binary")), "row"))
    large = rows.where(F.octet_length("body") >= min_revisit)
    best = large.groupBy("digest").agg(F.max(F.struct("page", "key")).alias("best"), F.count(F.lit(1)).alias("n"))
    winners = best.where("n > 1").select("digest", F.col("best.key").alias("first"))
    joined = rows.join(winners, "digest", "left")
    again = (F.octet_length("body") >= min_revisit) & F.col("first").isNotNull() & (F.col("first") != F.col("key"))
    return joined.withColumn("first", F.when(again, F.col("first")))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                   min_revisit: int = MIN_REVISIT) -> None:
    """Writes ``pages`` as archives below ``path``."""
    p = plan_captures(pages, id_col, url_col, body_col, min_revisit)
    key, url, body = F.col("key"), F.col("url"), F.col("body")
    uri, date = ("WARC-Target-URI", url), ("WARC-Date", F.lit(DATE))
    of_response = ("WARC-Concurrent-To", _urn("response", key))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(CRLF * 2),
    )
    path_of = F.regexp_replace(url, "^[a-z]+://[^/?#]*", "")
    request = _record(
        "request", [("WARC-Record-ID", _urn("request", key)), date, uri, of_response, ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path_of == "", "/").otherwise(path_of), F.lit(f" HTTP/1.1{CRLF}Host: "),
                 F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1), F.lit(CRLF * 2)),
    )
    own = [("WARC-Record-ID", _urn("response", key)), date, uri, digest, ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", own, F.concat(http, body))
    revisit = _record("revisit", [*own, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", _urn("response", F.col("first")))], http)
    metadata = _record(
        "metadata", [("WARC-Record-ID", _urn("metadata", key)), date, uri, of_response, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(CRLF)),
    )
    records = F.array(request, F.when(F.col("first").isNull(), response).otherwise(revisit), metadata)
    out = p.select(F.explode(records).alias("value"))
    out.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Bytes:
    """A file's bytes, unpacked as they are asked for; gzip members follow one another."""

    def __init__(self, data: bytes):
        self.data, self.at, self.buffer = memoryview(data), 0, bytearray()
        self.gzip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data):
            return False
        part = bytes(self.data[self.at:self.at + 65536])
        self.at += len(part)
        while self.gzip is not None and part:
            self.buffer += self.gzip.decompress(part)
            part = self.gzip.unused_data
            if self.gzip.eof:
                self.gzip = zlib.decompressobj(31)
        self.buffer += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (end := self.buffer.find(mark, seen)) < 0:
            seen = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        head = bytes(self.buffer[:end])
        del self.buffer[:end + len(mark)]
        return head

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def skip_line_ends(self) -> bool:
        """To the next record; False at the end of the file."""
        while True:
            n = 0
            while n < len(self.buffer) and self.buffer[n] in b"\r\n":
                n += 1
            del self.buffer[:n]
            if self.buffer:
                return True
            if not self.more():
                return False


def _headers(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.decode('utf-8', 'replace').strip()}")
        elif colon:
            out.append((name.strip(), value.strip()))
    return out


def parse_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, as rows of ``RECORD_SCHEMA``."""
    source = _Bytes(data)
    while source.skip_line_ends():
        head = source.until(b"\r\n\r\n")
        if head is None or not head.startswith(b"WARC/"):
            raise ValueError("not the start of a WARC record")
        named = {k.lower(): v for k, v in _headers(head.split(b"\r\n")[1:])}
        block = source.take(int(named["content-length"]))
        kind, fields, length, payload = named.get("warc-type", ""), [], None, block
        if named.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http = {k.lower(): v for k, v in _headers(top.split(b"\r\n")[1:])}
            length = int(http["content-length"]) if re.fullmatch("[0-9]+", http.get("content-length", "")) else None
        elif named.get("content-type", "").startswith("application/warc-fields"):
            fields = _headers(block.split(b"\r\n"))
        yield {
            "record_id": named.get("warc-record-id"), "record_type": kind, "concurrent_to": named.get("warc-concurrent-to"),
            "refers_to": named.get("warc-refers-to"), "target_uri": named.get("warc-target-uri"), "http_length": length,
            "fields": [{"name": k, "value": v} for k, v in fields], "payload": payload,
            "payload_bytes": length if kind == "revisit" else len(payload),
            "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha1:") if kind == "revisit" else hashlib.sha1(payload).hexdigest(),
        }


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records below ``path``; without payloads, only their lengths and digests leave the task that unpacked them."""
    field = pa.struct([("name", pa.string()), ("value", pa.string())])
    text = ("record_id", "record_type", "concurrent_to", "refers_to", "target_uri")
    columns = [(c, pa.string()) for c in text] + [("http_length", pa.int64()), ("fields", pa.list_(field)), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    schema = pa.schema(columns + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_archive(content.as_py()):
                    rows.append(r)
                    size += 500 + len(r["payload"]) * with_payload
                    if not with_payload:
                        del r["payload"]
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = RECORD_SCHEMA if with_payload else RECORD_SCHEMA.removesuffix(", payload binary")
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``transaction``, ``request``, ``response`` (or revisit) and ``metadata``."""
    parts = F.struct(*[c for c in records.columns if c != "concurrent_to"])
    kind = F.col("record_type")
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("transaction")).agg(
        F.max(F.when(kind == "request", parts)).alias("request"),
        F.max(F.when(kind.isin("response", "revisit"), parts)).alias("response"),
        F.max(F.when(kind == "metadata", parts)).alias("metadata"),
    )


def page_of(metadata: Column) -> Column:
    found = F.filter(metadata["fields"], lambda f: f["name"] == "page")
    value = F.get(found, F.lit(0))["value"]
    return F.when(value != "", value)


def report(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the pages, reads the archives back and tells what each page's record became."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "archives")
    write_archives(pages, path)
    captures = assemble(read_records(spark, path, with_payload=False))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = captures.where(F.col("response").isNotNull()).select(
        "transaction", page_of(F.col("metadata")).cast(kind).alias("page_id"), F.col("response.target_uri").alias("url"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("_to"),
    )
    answers = rows.select(F.col("transaction").alias("_to"), F.col("page_id").alias("refers_to"))
    first = rows.where(F.col("_to").isNull()).select("*", F.lit(None).cast(kind).alias("refers_to"))
    again = rows.where(F.col("_to").isNotNull()).join(answers, "_to", "left").select(*first.columns)
    return first.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

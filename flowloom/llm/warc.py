"""WARC archives: a writer with revisits, chunked transfer framing and segments, and segment reassembly.

Reassembly groups continuation records by the id of the record they continue, orders them by segment number, checks
that the numbers are complete and the joined length is the stated total, and decodes the chunked transfer framing.
Records that fit one segment are decoded where they are read; only segments are shuffled, by origin id, and read
back as a sorted stream with one open record at a time.

Archives are ``.warc.gz`` files below a shared folder, each record a gzip member of its own, with a bounded number of
records each, so that one file is a bounded piece of work.

A page's record id has its page id and payload digest.  Where several rows have both, and for revisits, which nothing
refers to, a number of the writing task is added.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.columns import bound_batches
from flowloom.operators.joins import fresh, split_join

VERSION = b"WARC/1.1\r\n"
DATE = b"2020-01-01T00:00:00Z"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- framing


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped, anything else malformed raises."""
    at, parts = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size without an end")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Header fields (names in lower case) and decoded payload of an HTTP response block."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        raise ValueError("HTTP head without an end")
    fields = fields_of(head.partition(b"\r\n")[2])
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = unchunked(body)
    return fields, body


def fields_of(head: bytes) -> dict[bytes, bytes]:
    found = {}
    for line in head.split(b"\r\n"):
        name, mark, value = line.partition(b":")
        if mark:
            found[name.strip().lower()] = value.strip()
    return found


# --- writing


def record(fields: list[tuple[str, bytes]], block: bytes) -> bytes:
    lines = b"".join(b"%s: %s\r\n" % (k.encode(), v) for k, v in fields)
    return b"%s%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (VERSION, lines, len(block), block)


def page_records(page_id: int | None, unique: str, url: str | None, payload: bytes, refers_to: int | None, segment: int) -> Iterator[bytes]:
    """The records of one page: a response in one or more segments, or a revisit with the response's HTTP head.
    ``unique`` ends the record's id where page id and digest are not enough."""
    digest = base32_sha1(payload).encode()
    name = b"<urn:x-page:%s:%s%s>" % (str(page_id).encode(), digest, f"#{unique}".encode() if unique else b"")
    fields = [("WARC-Record-ID", name), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~").encode()))
    fields.append(("WARC-Payload-Digest", b"sha1:" + digest))
    fields.append(("Content-Type", b"application/http;msgtype=response"))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [("WARC-Type", b"revisit"), ("WARC-Profile", profile), ("WARC-Refers-To", b"<urn:x-page:%d:%s>" % (refers_to, digest))]
        yield record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields.append(("WARC-Type", b"response"))
    if len(block) <= segment:
        yield record(fields, block)
        return
    yield record([*fields, ("WARC-Segment-Number", b"1")], block[:segment])
    starts = range(segment, len(block), segment)
    for i, at in enumerate(starts, 2):
        more = [("WARC-Type", b"continuation"), ("WARC-Record-ID", name[:-1] + b"-%d>" % i), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", b"%d" % i)]
        if at == starts[-1]:
            more.append(("WARC-Segment-Total-Length", b"%d" % len(block)))
        yield record(more, block[at : at + segment])


def members(data: bytes, most: int = 1 << 23) -> bytes:
    """The bytes as a gzip member, or as several of ``most`` bytes each, all of which end in a zero byte: the highest
    one of the member's length."""
    return b"".join(gzip.compress(data[i : i + most], 6, mtime=0) for i in range(0, len(data), most))


def revisit_targets(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to, single)``: of rows with equal payloads of ``min_bytes`` or more, that with
    the largest page_id is the response and the others refer to it.

    Null html is empty; rows tied for the largest id are all responses, and null ids are the smallest.  ``single`` says
    that no other row has both id and payload of a response.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.length("payload") >= min_bytes
    counted = rows.filter(large).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    last = counted.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"))
    refers = F.when(large & ~F.col("page_id").eqNullSafe(F.col("top.page_id")), F.col("top.page_id"))
    single = F.coalesce(large & (F.col("top.n") == 1) & F.col("page_id").isNotNull(), F.lit(False))
    return split_join(rows, last, ["digest"], "left").select("page_id", "url", "payload", refers.alias("refers_to"), single.alias("single"))


def write_archives(pages: DataFrame, path: str, segment: int = 16384, records_per_file: int = 2048, min_bytes: int = 0) -> None:
    """Write a record for every row of ``pages(page_id, url, html)`` as ``.warc.gz`` files below ``path``.

    Payloads are the html in UTF-8; blocks of more than ``segment`` bytes are segmented.  Null html is empty, a null url
    is left out, null ids are written as ``None``; repeated rows give a record each, an empty table no records.  Other
    columns are ignored.
    """
    spark = pages.sparkSession
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for page_id, url, payload, refers, single in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                n += 1
                unique = "" if single and refers is None else f"{task}-{n}"
                out += [members(r)[:-1] for r in page_records(page_id, unique, url, payload, refers, segment)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # The text writer puts the bytes of a string down as they are; a member's last byte, zero, is its separator.
    lines = revisit_targets(pages, min_bytes).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", str(records_per_file)).text(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for file in store.listStatus(folder):  # the writer has no say in the names of its files
        name = file.getPath().getName()
        if name.endswith(".txt"):
            store.rename(file.getPath(), file.getPath().suffix(".warc.gz"))


# --- reading


def records_of(archive: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields and block of every record of a plain archive; what is between records is skipped."""
    at = archive.find(b"WARC/")
    while 0 <= at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = fields_of(archive[at:end].partition(b"\r\n")[2])
        size = int(fields.get(b"content-length", b"0"))
        yield fields, archive[end + 4 : end + 4 + size]
        at = archive.find(b"WARC/", end + 4 + size)


def gunzipped(data: bytes) -> bytes:
    """All gzip members of a file; a file that is not compressed comes back as it is."""
    parts, at, view = [], 0, memoryview(data)
    while data[at : at + 2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        done = at
        while not d.eof and done < len(data):  # in pieces: what is left unused is copied
            parts.append(d.decompress(view[done : done + _PIECE]))
            done += _PIECE
        at = min(done, len(data)) - len(d.unused_data)
        if not d.eof:
            break
    return b"".join(parts) if parts else data


_PIECE = 1 << 14
_RESULT = "record_id string, record_type string, uri string, refers_to string, digest string, payload_bytes long, payload_digest string, payload binary, error string"
_SEGMENT = "origin string, segment int, total long, fields map<string, string>, block binary"


def _decoded(fields: dict[bytes, bytes], block: bytes, with_payload: bool, error: str | None = None) -> tuple:
    """A result row of one whole record."""
    text = {k: fields[k].decode("utf-8", "replace") if k in fields else None for k in (b"warc-record-id", b"warc-type", b"warc-target-uri", b"warc-refers-to", b"warc-payload-digest")}
    digest = (text[b"warc-payload-digest"] or "").removeprefix("sha1:") or None
    size = found = payload = None
    if error is None:
        try:
            http, payload = http_payload(block)
            if text[b"warc-type"] == "revisit":
                payload, size, found = None, int(http[b"content-length"]) if b"content-length" in http else None, digest
            else:
                size, found = len(payload), base32_sha1(payload)
                if digest and digest != found:
                    error = "payload digest differs"
        except ValueError as e:
            error = str(e)
    return text[b"warc-record-id"], text[b"warc-type"], text[b"warc-target-uri"], text[b"warc-refers-to"], digest, size, found, payload if with_payload else None, error


def _batch(rows: list[tuple], types: list[pa.DataType], ddl: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in ddl.replace("map<string, string>", "map").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_RESULT_TYPES = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary(), pa.string()]
_SEGMENT_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(origin, segment, total, fields, block)``: every record of the archives below ``path``.

    ``origin`` is the id of the record that a continuation continues, or the record's own; ``segment`` is null for
    records that are not segmented and ``total`` is the length that a last segment states.  Records come out as they
    are, repeated ones too; a folder without files gives none.  A file that ends within a record gives what there is.
    """
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows, held = [], 0
                for fields, block in records_of(gunzipped(data)):
                    number, total = fields.get(b"warc-segment-number"), fields.get(b"warc-segment-total-length")
                    origin = fields.get(b"warc-segment-origin-id", fields.get(b"warc-record-id", b""))
                    texts = [(k.decode("utf-8", "replace"), v.decode("utf-8", "replace")) for k, v in fields.items()]
                    rows.append((origin.decode("utf-8", "replace"), number and int(number), total and int(total), texts, block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _batch(rows, _SEGMENT_TYPES, _SEGMENT)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, _SEGMENT_TYPES, _SEGMENT)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _SEGMENT)


def reassemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per whole record: ``(record_id, record_type, uri, refers_to, digest, payload_bytes, payload_digest,
    payload, error)``.

    Segments of an origin come together in order.  Missing, repeated or unknown segment numbers, a joined length
    other than the stated total, malformed framing and a payload that does not have the stated digest give an
    ``error`` with what is known of the record.  A revisit has the length and digest that it states, and no payload;
    ``checked_revisits`` holds them against the response.  Repeated records that are not segmented give a row each, a
    repeated segment is an error; without records there are no rows.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_decoded({k.encode(): v.encode() for k, v in fields}, block, with_payload) for fields, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield _batch(rows, _RESULT_TYPES, _RESULT)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, parts, first, total, expect, error = None, [], {}, None, 1, None

        def result() -> tuple:
            wrong = error
            if wrong is None and expect == 1:
                wrong = "no segments"
            if wrong is None and total is None:
                wrong = "no last segment"
            block = b"".join(parts)
            if wrong is None and len(block) != total:
                wrong = f"{len(block)} bytes instead of {total}"
            return _decoded({b"warc-record-id": origin.encode()} | {k.encode(): v.encode() for k, v in first}, block, with_payload, wrong)

        for batch in batches:
            rows = []
            for key, number, stated, fields, block in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != origin:
                    if origin is not None:
                        rows.append(result())
                    origin, parts, first, total, expect, error = key, [], [], None, 1, None
                if number != expect:
                    error = error or f"segment {number} where {expect} is due"
                if number == 1:
                    first = fields
                if stated is not None:
                    total = stated
                parts.append(block)
                expect = number + 1
            if rows:
                yield _batch(rows, _RESULT_TYPES, _RESULT)
        if origin is not None:
            yield _batch([result()], _RESULT_TYPES, _RESULT)

    single = records.filter("segment IS NULL").select("fields", "block").mapInArrow(whole, _RESULT)
    dealt = records.filter("segment IS NOT NULL").repartition("origin").sortWithinPartitions("origin", "segment")
    return single.union(dealt.mapInArrow(joined, _RESULT))


def page_of(reference: str):
    """The page id in a record id or a reference as this module writes them; null where there is none."""
    return F.regexp_extract(F.col(reference), r"^<urn:x-page:(-?\d+)", 1).try_cast("long")


def checked_revisits(whole: DataFrame) -> DataFrame:
    """``whole`` (of ``reassemble``, written or cheap to read twice) with an ``error`` for every revisit whose response
    is not there or has another length or digest than it states.

    A reference is the id of the response; where several responses had one id it is their id without the number.
    """
    name = fresh("_name", whole)
    found = whole.filter("record_type = 'response' AND error IS NULL").select(F.regexp_replace("record_id", "#[^>]*>$", ">").alias(name), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    found = found.groupBy(name).agg(F.max(F.struct("_bytes", "_digest")).alias("_found"))
    rows = split_join(whole.withColumn(name, F.when(F.col("record_type") == "revisit", F.coalesce("refers_to", F.lit("")))), found, [name], "left")
    same = F.col("_found._bytes").eqNullSafe(F.col("payload_bytes")) & F.col("_found._digest").eqNullSafe(F.col("payload_digest"))
    wrong = F.when(F.col(name).isNull(), None).when(F.col("_found").isNull(), "the response is missing").when(~same, "the response differs")
    return rows.withColumn("error", F.coalesce("error", wrong)).select(whole.columns)

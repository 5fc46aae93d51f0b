import gzip
import os
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from flowloom.llm import warc
from flowloom.llm.queries import QUERIES, SQL
from flowloom.storage import scratch_path

PAGES = "page_id long, url string, html string, digest string, last long"


@given(st.binary(max_size=300), st.integers(1, 40))
def test_chunked_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


@pytest.mark.parametrize("bad", [b"", b"5\r\nabc", b"zz\r\n", b"3\r\nabcX\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"-1\r\n\r\n"])
def test_bad_framing(bad):
    with pytest.raises(ValueError):
        warc.unchunked(bad)


def test_chunk_extensions_and_trailers():
    assert warc.unchunked(b"3;name=x\r\nabc\r\n0\r\nTrailer: y\r\n\r\n") == b"abc"


def slow(pages):
    last = {}
    for p, _, h in pages:
        k = (h or "").encode()
        last[k] = max(last.get(k, -1), -1 if p is None else p)
    out = []
    for p, _, h in pages:
        k = (h or "").encode()
        revisit = last[k] >= 0 and p != last[k]
        out.append((p, len(k), warc.base32_sha1(k), "revisit" if revisit else "response", last[k] if revisit else None))
    return out


def member_texts(stored):
    out = []
    while stored:
        d = zlib.decompressobj(31)
        out.append(d.decompress(stored))
        stored = d.unused_data
    return out


def digests(spark, df, **options):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, **options)
    for file in os.listdir(path.removeprefix("file:")):
        if not file.startswith((".", "_")):
            assert file.endswith(".warc.gz")
            with open(path.removeprefix("file:") + "/" + file, "rb") as f:
                stored = f.read()
            each = member_texts(stored)
            assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and len(list(warc.records_of(m))) == 1 for m in each)
            assert gzip.decompress(stored) == b"".join(each) == warc.gunzipped(stored)
    rows = warc.checked_revisits(warc.reassemble(warc.read_archives(spark, path)))
    assert rows.filter("error IS NOT NULL").collect() == []
    return rows


@pytest.mark.parametrize("segment", [150, 1000, 1 << 20])
def test_edge_rows(spark, segment):
    pages = [(1, None, None), (2, "http://x/\r\nWARC/1.1\r\n ü", ""), (3, "u", "é" * 5000), (4, "u", "é" * 5000), (5, "u", "WARC/1.1\r\n\r\n" * 40), (None, "u", "one"), (7, "u", "one"), (8, "u", "tie"), (8, "v", "tie"), (-3, "u", "alone"), (None, None, "none")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], PAGES)
    rows = digests(spark, df, segment=segment, records_per_file=3)
    got = rows.select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("r")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow(pages)))
    names = [r["record_id"] for r in rows.collect()]
    assert len(set(names)) == len(names)
    tied = {f"<urn:x-page:8:{warc.base32_sha1(b'tie')}>"}
    assert {r["refers_to"] for r in rows.filter("record_type = 'revisit'").collect()} <= set(names) | tied
    payloads = {r["payload"] for r in rows.filter("record_type = 'response'").select("payload").collect()}
    assert {bytes(p) for p in payloads} == {(h or "").encode() for _, _, h in pages}


def test_empty_table(spark):
    assert digests(spark, spark.createDataFrame([], PAGES)).collect() == []


def test_whole_table(spark, sf):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(str, map(tuple, QUERIES["op8_warc_segments"](spark, sf).collect()))) == sorted(map(str, slow(pages)))
    assert "op8_warc_segments" in SQL


def test_broken_segments_are_reported(spark):
    def rows(origin, *segments):
        return [(origin, n, total, {"warc-record-id": origin, "warc-type": "response"} if n == 1 else {}, block) for n, total, block in segments]

    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world", 4)
    a, b, c = body[:20], body[20:50], body[50:]
    n = len(body)
    records = [
        *rows("good", (3, n, c), (1, None, a), (2, None, b)),
        *rows("gap", (1, None, a), (3, n, c)),
        *rows("total", (1, None, a), (2, None, b), (3, n + 1, c)),
        *rows("open", (1, None, a), (2, None, b)),
        *rows("twice", (1, None, a), (2, None, b), (2, None, b), (3, n, c)),
        *rows("orphan", (2, None, b), (3, n, c)),
    ]
    df = spark.createDataFrame(records, warc._SEGMENT.replace("map<string, string>", "map<string,string>"))
    got = {(r["record_id"] or "orphan"): r for r in warc.reassemble(df).collect()}
    assert bytes(got.pop("good")["payload"]) == b"hello world"
    assert set(got) == {"gap", "total", "open", "twice", "orphan"} and all(r["error"] and r["payload"] is None for r in got.values())


def test_members_end_in_a_zero_byte():
    for n in (0, 1, 255, 1 << 16, (1 << 23) - 1, (1 << 23) + 5, 3 << 23):
        data = bytes(n)
        if n:
            packed = warc.members(data)
            assert packed[-1] == 0 and warc.gunzipped(packed) == data == gzip.decompress(packed)


def test_cut_files_give_what_there_is():
    packed = warc.members(b"a" * 1000) + warc.members(bytes(range(256)) * 300)
    assert warc.gunzipped(packed[:-9])[:1000] == b"a" * 1000 and warc.gunzipped(b"plain") == b"plain" and warc.gunzipped(b"") == b""


def test_revisits_are_held_against_their_response(spark):
    rows = [("<urn:x-page:2:D>", "response", None, 5, "D"), ("<urn:x-page:3:T#0-1>", "response", None, 5, "T"), ("<urn:x-page:3:T#0-2>", "response", None, 5, "T")]
    rows += [(f"r{i}", "revisit", to, n, d) for i, (to, n, d) in enumerate([("<urn:x-page:2:D>", 5, "D"), ("<urn:x-page:3:T>", 5, "T"), ("<urn:x-page:2:D>", 6, "D"), ("<urn:x-page:2:D>", 5, "E"), ("<urn:x-page:9:D>", 5, "D"), (None, 5, "D")])]
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, error string, _name string")
    got = {r["record_id"]: r["error"] for r in warc.checked_revisits(df).collect()}
    assert {k for k, e in got.items() if e} == {"r2", "r3", "r4", "r5"} and len(got) == len(rows)

import hashlib
import struct
import zlib

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from flowloom.llm import matroska as mk
from flowloom.llm.queries import QUERIES


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.integers(0, 5000), st.integers(60000, 140000)), st.integers(0, 255))
def test_round_trip(n, seed):
    payload = bytes((i * 31 + seed) % 256 for i in range(n))
    data = mk.mux(payload)
    got = mk.parse(data)
    assert got.error is None and mk.demux(data, got) == payload
    assert [p[1] for p in got.packets] == [i * mk.FRAME * 10**9 // mk.RATE for i in range(len(got.packets))]
    assert len(got.cues) == got.clusters and got.tracks == [(1, 2, "A_PCM/INT/LIT")]
    for _, _, at in got.cues:
        assert data[at : at + 4] == mk.CLUSTER.to_bytes(4, "big")


@example([b""], mk.EBML_LACING)
@example([b"a" * 300, b"", b"b" * 20000, b"c"], mk.EBML_LACING)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=9), st.sampled_from([mk.XIPH, mk.EBML_LACING]))
def test_lacings(frames, lacing):
    data = file_of(mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 9) + mk.block(1, -2, frames, lacing)))
    got = mk.parse(data)
    assert [data[at : at + n] for _, _, at, n, _, _ in got.packets] == frames
    assert got.packets[0][1] == 7_000_000


def file_of(body, size=None):
    tracks = mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk.number(mk.TRACK_NUMBER, 1)))
    segment = mk.SEGMENT.to_bytes(4, "big") + (size or mk.vint(len(tracks + body))) + tracks + body
    return mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"matroska")) + segment


def test_unknown_sizes_groups_and_voids():
    unknown = b"\x01" + b"\xff" * 7
    void = mk.element(0xEC, b"junk")
    one = mk.CLUSTER.to_bytes(4, "big") + unknown + mk.number(mk.TIMESTAMP, 5) + void + mk.block(1, 0, [b"abc"], mk.NO_LACING, key=False)
    raw = mk.vint(1) + struct.pack(">hB", 3, 0) + b"delta"
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, raw) + mk.number(0x9B, 1) + mk.number(0xFB, 1))
    two = mk.CLUSTER.to_bytes(4, "big") + b"\xff" + mk.number(mk.TIMESTAMP, 8) + group
    data = file_of(one + two + mk.element(mk.CUES, b""), unknown)
    got = mk.parse(data)
    assert got.error is None and got.clusters == 2
    assert [(t, ns, data[a : a + n], k, c) for t, ns, a, n, k, c in got.packets] == [(1, 5_000_000, b"abc", False, 0), (1, 11_000_000, b"delta", False, 1)]


def test_damaged_files_keep_what_is_before():
    data = mk.mux(bytes(range(256)) * 600)
    whole = mk.parse(data).packets
    for cut in range(0, len(data), 997):
        fixed = data[:40] + data[40:cut]
        got = mk.parse(fixed) if cut > 40 else mk.parse(data[:cut])
        assert got.packets == whole[: len(got.packets)] and (cut == len(data) or got.error)
    for bad in (b"", b"\0", b"RIFF" * 9, data[:1] + b"\xff" * 50):
        assert mk.parse(bad).error


def slow(text):
    data = (text or "").encode()
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def check(rows, docs):
    want = {}
    for d, t in docs:
        p = slow(t)
        want.setdefault(d, []).append((len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(mk.mux(p)), hashlib.sha256(mk.mux(p)).hexdigest()))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:7])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_whole_table(spark, sf, documents):
    check(QUERIES["op7_matroska_media"](spark, sf).collect(), [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_edge_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "é" * 32), (3, "é" * 32), (None, "x" * 65), (4, "long " * 60000)]
    media = mk.to_media(docs_of(rows))
    check(mk.media_digests(media).collect(), rows)
    packets = mk.packet_table(media).filter("doc_id = 4").orderBy("packet").collect()
    assert [r["byte_size"] for r in packets[:-1]] == [mk.FRAME] * (len(packets) - 1) and all(r["error"] is None for r in packets)
    assert packets[0]["cued"] and packets[0]["codec"] == "A_PCM/INT/LIT"
    assert mk.media_digests(mk.to_media(docs_of([]))).collect() == []


def test_packets_of_no_media(spark):
    df = spark.createDataFrame([(1, None), (2, b"nonsense")], "doc_id long, media binary")
    assert [(r["doc_id"], r["packet"], bool(r["error"])) for r in mk.packet_table(df).collect()] == [(1, None, True), (2, None, True)]


def test_tail_is_fetched_through_the_cues(monkeypatch):
    for n in (64, 512, 70_016, 200_000):
        payload = bytes(i * 7 % 251 for i in range(n))
        data = mk.mux(payload)
        got = mk.parse(data)
        for size in (1, 64, 65_536):
            assert mk.tail(data, got, size) == payload[-size:]
    read = []
    monkeypatch.setattr(mk, "packets_from", lambda data, place, f=mk.packets_from: read.append(place) or f(data, place))
    mk.tail(data, got, 64)
    assert read == [got.cues[-1][2]] and len(got.cues) > 2


def test_header_stripping_and_other_encodings():
    def track(algorithm):
        how = mk.element(mk.COMPRESSION, mk.number(mk.ALGORITHM, algorithm) + mk.element(mk.SETTINGS, b"AB"))
        return mk.element(mk.TRACKS, mk.element(mk.TRACK_ENTRY, mk.number(mk.TRACK_NUMBER, 1) + mk.element(mk.ENCODINGS, mk.element(mk.ENCODING, how))))

    cluster = mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 0) + mk.block(1, 0, [b"x", b"yz"], mk.XIPH))
    head = mk.element(mk.EBML, mk.element(mk.DOC_TYPE, b"matroska"))
    data = head + mk.element(mk.SEGMENT, track(3) + cluster)
    got = mk.parse(data)
    assert got.error is None and mk.demux(data, got) == b"ABxAByz" and [p[3] for p in got.packets] == [1, 2]
    zipped = mk.parse(head + mk.element(mk.SEGMENT, track(0) + cluster))
    assert "compressed" in zipped.error and zipped.packets == []


def test_block_durations_time_laced_frames():
    raw = mk.vint(1) + struct.pack(">hB", 0, mk.XIPH << 1) + bytes([2, 1, 1]) + b"abc"
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, raw) + mk.number(mk.BLOCK_DURATION, 30))
    got = mk.parse(file_of(mk.element(mk.CLUSTER, mk.number(mk.TIMESTAMP, 5) + group)))
    assert [p[1] for p in got.packets] == [5_000_000, 15_000_000, 25_000_000]

"""Media columns in Matroska: a muxer for raw bytes, and a parser from files to packet tables.

The parser reads variable-length EBML elements: segments and clusters of known or unknown size, simple blocks and
block groups, all lacings (none, Xiph, EBML, fixed), default and block durations, header stripping and cues.  Each
frame becomes a packet with its track, timestamp and byte range, so readers can fetch frames from the stored bytes
without parsing again.  Damaged files yield the packets before the damage and a message, and so do files whose frames
are compressed or encrypted: their byte ranges would not be frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowloom.llm.columns import map_batches, utf8

#: Fixed values of the format: element ids.
EBML, DOC_TYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
BLOCK_DURATION, REFERENCE, MUXING_APP, WRITING_APP = 0x9B, 0xFB, 0x4D80, 0x5741
ENCODINGS, ENCODING, COMPRESSION, ALGORITHM, SETTINGS, ENCRYPTION, STRIPPED = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035, 3
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x1254C367, 0x114D9B74, 0x1043A770, 0x1941A469, SEGMENT, EBML}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: The muxer's own layout: bytes of a frame, frames of a block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, RATE = 512, 8, 16, 8000
APP = b"flowloom"


# --- writing


def vint(value: int, length: int = 0) -> bytes:
    """A number in the shortest variable-length form, or in ``length`` bytes; all ones stay reserved."""
    n = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(id_: int, data: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(id_: int, value: int) -> bytes:
    return element(id_, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, time: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    """A simple block; ``time`` is relative to its cluster."""
    head = vint(track) + struct.pack(">hB", time, key << 7 | lacing << 1)
    if lacing == NO_LACING:
        return element(SIMPLE_BLOCK, head + frames[0])
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            diff = n - before
            length = next(k for k in range(1, 9) if abs(diff) < (1 << 7 * k - 1) - 1)
            head += vint(diff + (1 << 7 * length - 1) - 1, length)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file with the payload as unsigned 8-bit mono samples.

    Blocks of equal frames use fixed lacing; a block that ends in a shorter frame uses Xiph or EBML lacing in turn.
    """
    ms = FRAME * 1000 // RATE
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, APP) + element(WRITING_APP, APP) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    entry = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    span = FRAME * LACED
    for c in range(0, len(payload), span * BLOCKS):
        start, body = c // FRAME * ms, []
        for i, b in enumerate(range(c, min(c + span * BLOCKS, len(payload)), span)):
            frames = [payload[f : min(f + FRAME, b + span)] for f in range(b, min(b + span, len(payload)), FRAME)]
            lacing = NO_LACING if len(frames) == 1 else FIXED if len(frames[-1]) == FRAME else (XIPH, EBML_LACING)[i % 2]
            body.append(block(1, (b - c) // FRAME * ms, frames, lacing))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, number(TIMESTAMP, start) + b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# --- parsing


@dataclass
class Parsed:
    tracks: list[tuple[int, int, str]] = field(default_factory=list)  # number, type, codec
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)  # track, ns, offset, size, key, cluster
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # ns, track, byte offset of the cluster
    stripped: dict[int, bytes] = field(default_factory=dict)  # what each frame of a track begins with and does not store
    clusters: int = 0
    duration_ns: float = 0.0
    error: str | None = None


class _Parser:
    def __init__(self, data: bytes):
        self.data, self.out, self.scale, self.defaults = data, Parsed(), 1_000_000, {}
        self.raw_duration, self.origin = 0.0, 0

    def head(self, at: int, end: int) -> tuple[int, int, int | None]:
        """Id, start of the content, and its end, which is None where the size is unknown."""
        data = self.data
        if at >= end or not data[at]:
            raise ValueError(f"no element at byte {at}")
        n = 9 - data[at].bit_length()
        if n > 4 or at + n >= end:
            raise ValueError(f"bad element id at byte {at}")
        id_ = int.from_bytes(data[at : at + n], "big")
        size, start = self.vint(at + n, end)
        if size == (1 << 7 * (start - at - n)) - 1:
            return id_, start, None
        if start + size > end:
            raise ValueError(f"element at byte {at} ends beyond its parent")
        return id_, start, start + size

    def vint(self, at: int, end: int) -> tuple[int, int]:
        if at >= end or not self.data[at]:
            raise ValueError(f"no number at byte {at}")
        n = 9 - self.data[at].bit_length()
        if at + n > end:
            raise ValueError(f"cut number at byte {at}")
        return int.from_bytes(self.data[at : at + n], "big") & (1 << 7 * n) - 1, at + n

    def children(self, at: int, end: int):
        while at < end:
            id_, start, stop = self.head(at, end)
            yield id_, start, end if stop is None else stop, at
            at = end if stop is None else stop

    def uint(self, start: int, stop: int) -> int:
        return int.from_bytes(self.data[start:stop], "big")

    def float(self, start: int, stop: int) -> float:
        return struct.unpack(">f" if stop - start == 4 else ">d", self.data[start:stop])[0] if stop > start else 0.0

    def file(self) -> Parsed:
        try:
            seen, at = False, 0
            while at < len(self.data):
                id_, start, stop = self.head(at, len(self.data))
                if not seen and id_ != EBML:
                    raise ValueError("not an EBML file")
                seen = True
                if id_ == SEGMENT:
                    self.origin = start
                    self.segment(start, len(self.data) if stop is None else stop)
                at = len(self.data) if stop is None else stop
            if not seen:
                raise ValueError("empty file")
        except (ValueError, struct.error) as e:
            self.out.error = str(e)
        self.out.duration_ns = self.raw_duration * self.scale
        return self.out

    def segment(self, at: int, end: int) -> None:
        while at < end:
            id_, start, stop = self.head(at, end)
            if id_ == CLUSTER:
                at = self.cluster(start, end if stop is None else stop, stop is None)
                continue
            stop = end if stop is None else stop
            if id_ == INFO:
                for child, a, b, _ in self.children(start, stop):
                    if child == TIMESTAMP_SCALE:
                        self.scale = self.uint(a, b)
                    elif child == DURATION:
                        self.raw_duration = self.float(a, b)
            elif id_ == TRACKS:
                for child, a, b, _ in self.children(start, stop):
                    if child == TRACK_ENTRY:
                        self.track(a, b)
            elif id_ == CUES:
                for child, a, b, _ in self.children(start, stop):
                    if child == CUE_POINT:
                        self.cue(a, b)
            at = stop

    def track(self, at: int, end: int) -> None:
        n, kind, codec, default, stripped = 0, 0, "", 0, b""
        for child, a, b, _ in self.children(at, end):
            if child == TRACK_NUMBER:
                n = self.uint(a, b)
            elif child == TRACK_TYPE:
                kind = self.uint(a, b)
            elif child == CODEC_ID:
                codec = self.data[a:b].decode("ascii", "replace")
            elif child == DEFAULT_DURATION:
                default = self.uint(a, b)
            elif child == ENCODINGS:
                stripped = self.encodings(a, b)
        if stripped:
            self.out.stripped[n] = stripped
        self.out.tracks.append((n, kind, codec))
        self.defaults[n] = default

    def encodings(self, at: int, end: int) -> bytes:
        """The bytes that header stripping has taken from each frame; another encoding is an error."""
        stripped = b""
        for child, a, b, _ in self.children(at, end):
            if child == ENCODING:
                inside = {c: (x, y) for c, x, y, _ in self.children(a, b)}
                how = {c: (x, y) for c, x, y, _ in self.children(*inside[COMPRESSION])} if COMPRESSION in inside else {}
                if ENCRYPTION in inside or ALGORITHM not in how or self.uint(*how[ALGORITHM]) != STRIPPED:
                    raise ValueError(f"frames are compressed or encrypted, at byte {a}")
                stripped += self.data[slice(*how[SETTINGS])] if SETTINGS in how else b""
        return stripped

    def cue(self, at: int, end: int) -> None:
        time, places = 0, []
        for child, a, b, _ in self.children(at, end):
            if child == CUE_TIME:
                time = self.uint(a, b)
            elif child == CUE_POSITIONS:
                inside = {c: self.uint(x, y) for c, x, y, _ in self.children(a, b)}
                places.append((inside.get(CUE_TRACK, 0), inside.get(CUE_CLUSTER, 0)))
        self.out.cues += [(time * self.scale, track, self.origin + place) for track, place in places]

    def cluster(self, at: int, end: int, unknown: bool) -> int:
        """Reads a cluster and returns where it ends."""
        self.out.clusters += 1
        time = 0
        while at < end:
            id_, start, stop = self.head(at, end)
            if unknown and id_ in TOP_LEVEL:
                return at
            stop = end if stop is None else stop
            if id_ == TIMESTAMP:
                time = self.uint(start, stop)
            elif id_ == SIMPLE_BLOCK:
                self.block(start, stop, time)
            elif id_ == BLOCK_GROUP:
                found = {c: (a, b) for c, a, b, _ in self.children(start, stop)}
                if BLOCK in found:  # a group that refers to no other block is a key frame
                    lasts = self.uint(*found[BLOCK_DURATION]) * self.scale if BLOCK_DURATION in found else 0
                    self.block(*found[BLOCK], time, REFERENCE not in found, lasts)
            at = stop
        return end

    def block(self, at: int, end: int, cluster_time: int, key: bool | None = None, lasts: int = 0) -> None:
        track, at = self.vint(at, end)
        if at + 3 > end:
            raise ValueError(f"cut block at byte {at}")
        time, flags = struct.unpack(">hB", self.data[at : at + 3])
        at += 3
        lacing = flags >> 1 & 3
        sizes: list[int] = []
        if lacing != NO_LACING:
            if at >= end:
                raise ValueError(f"cut block at byte {at}")
            count = self.data[at] + 1
            at += 1
            if lacing == XIPH:
                for _ in range(count - 1):
                    size = 0
                    while at < end and self.data[at] == 255:
                        size, at = size + 255, at + 1
                    if at >= end:
                        raise ValueError(f"cut lace at byte {at}")
                    sizes.append(size + self.data[at])
                    at += 1
            elif lacing == EBML_LACING and count > 1:
                size, at = self.vint(at, end)
                sizes.append(size)
                for _ in range(count - 2):
                    diff, after = self.vint(at, end)
                    size += diff - ((1 << 7 * (after - at) - 1) - 1)
                    at = after
                    sizes.append(size)
            elif lacing == FIXED:
                if (end - at) % count:
                    raise ValueError(f"uneven fixed lace at byte {at}")
                sizes = [(end - at) // count] * (count - 1)
        rest = end - at - sum(sizes)
        if rest < 0 or min(sizes, default=0) < 0:
            raise ValueError(f"lace beyond its block at byte {at}")
        base, step = (cluster_time + time) * self.scale, self.defaults.get(track, 0) or lasts // (len(sizes) + 1)
        for i, size in enumerate([*sizes, rest]):
            self.out.packets.append((track, base + i * step, at, size, bool(flags >> 7) if key is None else key, self.out.clusters - 1))
            at += size


def parse(data: bytes | None) -> Parsed:
    return _Parser(data or b"").file()


def packets_from(data: bytes, place: int) -> list[tuple[int, int, int, int, bool, int]]:
    """Packets of the one cluster that begins at a byte, without anything before it being read; times count from
    the file's scale of 1 ms."""
    parser = _Parser(data)
    id_, start, stop = parser.head(place, len(data))
    if id_ != CLUSTER:
        raise ValueError(f"no cluster at byte {place}")
    parser.cluster(start, len(data) if stop is None else stop, stop is None)
    return parser.out.packets


def tail(data: bytes, got: Parsed, n: int, track: int = 1) -> bytes:
    """The last ``n`` bytes of a track: the cues lead to its last clusters, and only these are read again."""
    parts: list[bytes] = []
    for place in sorted({at for _, t, at in got.cues if t == track}, reverse=True):
        parts.insert(0, b"".join(got.stripped.get(track, b"") + data[a : a + size] for t, _, a, size, _, _ in packets_from(data, place) if t == track))
        if sum(map(len, parts)) >= n:
            break
    return b"".join(parts)[-n:]


# --- tables


def to_media(docs: DataFrame, pad: int = 64) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text in UTF-8, padded with zeros to a positive multiple of ``pad``,
    stored as the samples of a Matroska file.

    Null text is empty; other columns are ignored; repeated rows and null ids give a file each, an empty table none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        media = [mux(t + bytes(-len(t) % pad or (0 if t else pad))) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


#: A packet's columns after the file's key.
_PACKET = "track long, codec string, packet long, timestamp_ns long, byte_offset long, byte_size long, keyframe boolean, cluster long, cued boolean"


def packet_rows(got: Parsed) -> list[tuple]:
    """Rows of ``packet_table`` without key and error."""
    codec, cues = {n: c for n, _, c in got.tracks}, {(ns, t) for ns, t, _ in got.cues}
    return [(t, codec.get(t), i, ns, at, n, key, c, (ns, t) in cues) for i, (t, ns, at, n, key, c) in enumerate(got.packets)]


def packet_table(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """``(key, track, codec, packet, timestamp_ns, byte_offset, byte_size, keyframe, cluster, cued, error)``.

    One row per frame in file order; ``cued`` says whether a cue points at the frame's cluster and track at the
    time of the frame.  A file without any packet gives one row whose packet columns are null; ``error`` is the
    damage at which parsing stopped.  Null media is an empty file, repeated rows are files of their own, an empty
    table has no packets.
    """
    kind = files.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {_PACKET}, error string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = parse(data)
            rows += [(k, *row, got.error) for row in packet_rows(got)] or [(k, *[None] * 9, got.error)]
        types = [batch.schema.field(0).type, pa.int64(), pa.string(), *[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
        names = [f.split()[0] for f in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_batches(files.select(key, media), run, schema)


def demux(data: bytes, got: Parsed, track: int = 1) -> bytes:
    """The frames of a track, fetched by the byte ranges of its packet rows and joined."""
    head = got.stripped.get(track, b"")
    return b"".join(head + data[at : at + n] for t, _, _, _, at, n, _, _, _ in packet_rows(got) if t == track)


def feature(payload: bytes, got: Parsed) -> str:
    """Packets, clusters, cues and milliseconds of the file; sum, energy and midline crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"{len(got.packets)}:{got.clusters}:{len(got.cues)}:{got.duration_ns / 1e6:.0f}:{x.sum()}:{(x * x).sum()}:{crossings}"


def media_digests(files: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)`` of media as
    ``to_media`` makes them, from the stored bytes.

    The payload is what the packets' byte ranges hold, its last 64 bytes are fetched through the cues.  A file that
    does not parse is an error.  Repeated rows and null ids are digested like others; an empty table gives no rows.
    """
    kind = files.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(2).to_pylist():
            got = parse(data)
            if got.error:
                raise ValueError(got.error)
            payload = demux(data, got)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(tail(data, got, 64)), len(data), hashlib.sha256(data).hexdigest(), feature(payload, got)))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(files.select("doc_id", "n_bytes", "media"), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

"""Media columns: Matroska files in a binary column, as packet tables.

`parse` reads EBML: identifiers and sizes of variable length, masters of known and unknown size, clusters, simple
blocks and block groups, and all forms of lacing (none, Xiph, fixed, EBML). A packet has its track, timestamp, key
flag and the range of bytes that it takes in the file, so readers fetch packets without copying the file. Cues are
followed and must point at clusters. `mux` writes the format: one track of 8-bit PCM samples, with laced blocks.

Nulls and edges: a null file has no packets; a damaged one raises ValueError in `parse`, and packet_table gives it
no packets and its error; the query stores a null or empty text as one frame of blanks. Texts of any length are
stored whole; equal texts give equal files. Repeated rows and null ids pass through."""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, prepare

# Element identifiers of EBML and Matroska.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, KIND, LACING, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_PLACES))
TOP = frozenset((INFO, TRACKS, CLUSTER, CUES))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Rows of a batch of the packet table.
PACKETS_A_BATCH = 100_000

FRAME = 192
SAMPLE_RATE = 8000
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 125


class Packet(NamedTuple):
    track: int
    timestamp: int
    key: bool
    start: int
    size: int


class Packets:
    """Packets as columns: 33 bytes for each, whatever their number."""

    def __init__(self):
        self.track, self.timestamp, self.start, self.size, self.key = array("q"), array("q"), array("q"), array("q"), array("b")

    def add(self, track: int, timestamp: int, key: bool, start: int, size: int) -> None:
        for column, value in zip((self.track, self.timestamp, self.key, self.start, self.size), (track, timestamp, key, start, size), strict=True):
            column.append(value)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, k: int) -> Packet:
        return Packet(self.track[k], self.timestamp[k], bool(self.key[k]), self.start[k], self.size[k])

    def __iter__(self) -> Iterator[Packet]:
        return map(self.__getitem__, range(len(self)))

    def runs(self) -> Iterator[tuple[int, int]]:
        """(start, end) of the packets' bytes, those that follow each other as one."""
        starts, ends = np.array(self.start, np.int64), np.array(self.start, np.int64) + np.array(self.size, np.int64)
        breaks = np.flatnonzero(starts[1:] != ends[:-1]) + 1
        return zip(starts[np.concatenate([[0], breaks])].tolist(), ends[np.concatenate([breaks - 1, [len(ends) - 1]])].tolist(), strict=True) if len(starts) else iter(())


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: Packets
    clusters: list[int]
    cues: list[tuple[int, int, int]]
    scale: int
    doc_type: str


# --- reading ------------------------------------------------------------------------------------------------------


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """(identifier with its marker, next place)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no identifier at byte {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError(f"bad identifier at byte {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(value without its marker, next place); None stands for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no size at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"a size is cut off at byte {at}")
    value = int.from_bytes(data[at : at + n], "big") - (1 << 7 * n)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, stops: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, place, payload's start and end) of each element in a master; one of unknown size ends where an element of its own level or above begins."""
    while at < end:
        place = at
        name, at = read_id(data, at)
        if name in stops:
            return
        size, at = read_size(data, at)
        if size is None:
            if name not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size at byte {place}")
            stop = end if name == SEGMENT else next_top(data, at, end)
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"the element at byte {place} goes beyond its parent")
        yield name, place, at, stop
        at = stop


def next_top(data: bytes, at: int, end: int) -> int:
    while at < end:
        name, start = read_id(data, at)
        if name in TOP:
            return at
        size, start = read_size(data, start)
        if size is None:
            raise ValueError(f"unknown size at byte {at}")
        at = start + size
    return end


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(sizes of the frames of a block, where the first begins)."""
    if kind == NO_LACING:
        return [end - at], at
    n = data[at] + 1
    at += 1
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't divide its block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        first, at = read_size(data, at)
        sizes.append(first or 0)
        for _ in range(n - 2):  # differences, with half of the range below zero
            before = at
            raw, at = read_size(data, at)
            width = at - before
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing goes beyond its block")
    return sizes, at


def block(packets: Packets, data: bytes, at: int, end: int, base: int, key: bool | None) -> None:
    track, at = read_size(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    sizes, at = lace_sizes(data, at + 3, end, flags >> 1 & 3)
    for size in sizes:
        packets.add(track or 0, base + relative, bool(flags & 0x80) if key is None else key, at, size)
        at += size


def parse(data: bytes) -> Media:
    """Tracks, packets, places of clusters, and cues (time, track, place of a cluster) of a file."""
    tracks: dict[int, dict] = {}
    packets = Packets()
    clusters: list[int] = []
    cues: list[tuple[int, int, int]] = []
    scale, doc_type = 1_000_000, ""
    for name, _, a, b in elements(data, 0, len(data)):
        if name == EBML:
            doc_type = next((data[c:d].decode() for x, _, c, d in elements(data, a, b) if x == DOC_TYPE), "")
        if name != SEGMENT:
            continue
        for top, place, c, d in elements(data, a, b):
            if top == INFO:
                scale = next((unsigned(data, e, f) for x, _, e, f in elements(data, c, d) if x == SCALE), scale)
            elif top == TRACKS:
                for x, _, e, f in elements(data, c, d):
                    if x == TRACK:
                        own = read_track(data, e, f)
                        tracks[own["number"]] = own
            elif top == CLUSTER:
                clusters.append(place)
                base = 0
                for x, _, e, f in elements(data, c, d):
                    if x == TIMESTAMP:
                        base = unsigned(data, e, f)
                    elif x == SIMPLE_BLOCK:
                        block(packets, data, e, f, base, None)
                    elif x == BLOCK_GROUP:
                        inner = list(elements(data, e, f))
                        key = not any(y == REFERENCE for y, *_ in inner)
                        for y, _, g, h in inner:
                            if y == BLOCK:
                                block(packets, data, g, h, base, key)
            elif top == CUES:
                cues += read_cues(data, c, d, a)
    if wrong := {at for *_, at in cues} - set(clusters):
        raise ValueError(f"cues point at no cluster: {sorted(wrong)[:3]}")
    return Media(tracks, packets, clusters, cues, scale, doc_type)


def read_track(data: bytes, a: int, b: int) -> dict:
    out = {"number": 0, "kind": 0, "codec": "", "rate": 0.0, "channels": 1, "depth": 0}
    for x, _, c, d in elements(data, a, b):
        if x == NUMBER:
            out["number"] = unsigned(data, c, d)
        elif x == KIND:
            out["kind"] = unsigned(data, c, d)
        elif x == CODEC:
            out["codec"] = data[c:d].decode()
        elif x == AUDIO:
            for y, _, e, f in elements(data, c, d):
                if y == RATE:
                    out["rate"] = real(data, e, f)
                elif y == CHANNELS:
                    out["channels"] = unsigned(data, e, f)
                elif y == DEPTH:
                    out["depth"] = unsigned(data, e, f)
    return out


def read_cues(data: bytes, a: int, b: int, segment: int) -> Iterator[tuple[int, int, int]]:
    for x, _, c, d in elements(data, a, b):
        if x != CUE_POINT:
            continue
        inner = list(elements(data, c, d))
        time = next((unsigned(data, e, f) for y, _, e, f in inner if y == CUE_TIME), 0)
        for y, _, e, f in inner:
            if y == CUE_PLACES:
                place = {z: unsigned(data, g, h) for z, _, g, h in elements(data, e, f)}
                yield time, place.get(CUE_TRACK, 0), segment + place.get(CUE_CLUSTER, 0)


# --- writing ------------------------------------------------------------------------------------------------------


def size_bytes(n: int) -> bytes:
    """The shortest form; all ones is kept for unknown sizes."""
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) + n).to_bytes(width, "big")


def element(name: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING and len(sizes) > 1:
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += ((1 << 7 * width) + b - a + (1 << 7 * width - 1) - 1).to_bytes(width, "big")
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, rate: int = SAMPLE_RATE, lacing: int = FIXED) -> bytes:
    """8-bit samples as one PCM track: frames in laced blocks, clusters of bounded time, and a cue for each cluster."""
    step, each = frame * 1000 // rate, 1 if lacing == NO_LACING else FRAMES_A_BLOCK
    frames = [payload[k : k + frame] for k in range(0, len(payload), frame)]
    header = element(
        EBML, number(VERSION, 1), number(READ_VERSION, 1), number(MAX_ID, 4), number(MAX_SIZE, 8), element(DOC_TYPE, b"matroska"), number(DOC_VERSION, 4), number(DOC_READ_VERSION, 2)
    )
    info = element(INFO, number(SCALE, 1_000_000), element(MUXING_APP, b"tessera"), element(WRITING_APP, b"tessera"), element(DURATION, struct.pack(">d", len(frames) * step)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)), number(CHANNELS, 1), number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(NUMBER, 1), number(UID, 1), number(KIND, 2), number(LACING, 1), element(CODEC, b"A_PCM/INT/LIT"), audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for c in range(0, len(frames), FRAMES_A_BLOCK * BLOCKS_A_CLUSTER):  # at most that many frames keep block times in 16 bits
        base = c * step
        body = [number(TIMESTAMP, base)]
        for k in range(c, min(c + FRAMES_A_BLOCK * BLOCKS_A_CLUSTER, len(frames)), each):
            group = frames[k : k + each]
            kind = NO_LACING if len(group) == 1 else EBML_LACING if lacing == FIXED and len(group[-1]) < frame else lacing
            body.append(element(SIMPLE_BLOCK, b"\x81", struct.pack(">hB", k * step - base, 0x80 | kind << 1), lace(group, kind)))
        parts.append(element(CLUSTER, *body))
        cues.append(element(CUE_POINT, number(CUE_TIME, base), element(CUE_PLACES, number(CUE_TRACK, 1), number(CUE_CLUSTER, at))))
        at += len(parts[-1])
    return header + element(SEGMENT, *parts, element(CUES, *cues))


# --- tables -------------------------------------------------------------------------------------------------------


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each packet: id, packet, track, timestamp in ns, key, start, size; a damaged file has one row with its error."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        names = ("packet", "track", "timestamp_ns", "key", "start", "size", "error")
        for batch in batches:
            for k in range(len(batch)):  # one file at a time bounds the rows that are held
                if (data := batch.column(1)[k].as_py()) is None:
                    continue
                own, owner = batch.column(0)[k].as_py(), batch.schema.field(0).type
                try:
                    m = parse(data)
                except (ValueError, IndexError, struct.error, UnicodeDecodeError) as e:
                    yield pa.RecordBatch.from_arrays([pa.array([own], owner), *(pa.nulls(1, t) for t in kinds[:-1]), pa.array([str(e)])], [id_col, *names])
                    continue
                p, n = m.packets, len(m.packets)
                for a in range(0, n, PACKETS_A_BATCH):
                    b = min(a + PACKETS_A_BATCH, n)
                    times = np.array(p.timestamp[a:b], np.int64) * m.scale
                    cols = [np.arange(a, b), np.array(p.track[a:b], np.int32), times, np.array(p.key[a:b], bool), np.array(p.start[a:b], np.int64), np.array(p.size[a:b], np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([own] * (b - a), owner), *(pa.array(c, t) for c, t in zip(cols, kinds[:-1], strict=True)), pa.nulls(b - a, pa.string())], [id_col, *names])

    slim = df.select(F.col(id_col), F.col(media_col))
    own = f"`{id_col}` {slim.schema[0].dataType.simpleString()}"
    return slim.mapInArrow(run, f"{own}, packet long, track int, timestamp_ns long, key boolean, start long, size long, error string")


def padded(text: str | None, unit: int = FRAME) -> tuple[bytes, int]:
    """(the text's bytes with blanks up to a positive multiple of unit, how many bytes it has)."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" "), len(raw)


def digest(text: str | None) -> tuple:
    payload, n = padded(text)
    media = mux(payload)
    m = parse(media)
    view = memoryview(media)
    back = b"".join([view[a:b] for a, b in m.packets.runs()])
    samples = np.frombuffer(back, np.uint8)
    last = m.packets[len(m.packets) - 1]
    end = (last.timestamp * m.scale) // 1_000_000 + last.size * 1000 // int(m.tracks[last.track]["rate"])
    feature = f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};ms={end};keys={sum(m.packets.key)};min={samples.min()};max={samples.max()};sum={int(samples.sum(dtype=np.int64))}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as media, reads it back and describes both."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            cols = list(zip(*(digest(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            )

    slim = df.select(F.col(id_col), F.col(text_col))
    own = f"`{id_col}` {slim.schema[0].dataType.simpleString()}"
    return slim.mapInArrow(run, f"{own}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))

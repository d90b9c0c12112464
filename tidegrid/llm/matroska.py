"""Matroska columns: write and parse EBML elements, clusters, lacing and cues into packet tables.

``demux`` turns a column of Matroska bytes into one row a packet, with track, time and byte range; ``mux_text`` stores a
text's bytes as 8-bit PCM audio, the lossless form the query needs. A file is one record, parsed where it lies; nothing
is shuffled, and packets refer to byte ranges rather than copying them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE = 0x4282, 0x2AD7B1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, EBML}

#: The stored form: 8000 samples a second, frames of 1024 samples, up to 4 frames a block, 16 blocks a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 1024, 4, 16
FRAME_MS = FRAME * 1000 // RATE
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


# --- writing ---


def size_vint(n: int, width: int = 0) -> bytes:
    """A size with its length marker; all ones of a width stand for an unknown size, so they are skipped."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def uint(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(frames: list[bytes], at_ms: int, lacing: int) -> bytes:
    head = b"\x81" + at_ms.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing == NO_LACE:
        return element(SIMPLE_BLOCK, head + frames[0])
    sizes, lace = [len(x) for x in frames], b""
    if lacing == XIPH:
        lace = b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACE:
        lace = size_vint(sizes[0])
        for was, n in zip(sizes, sizes[1:-1]):
            lace += size_vint(n - was + (1 << 13) - 1, 2)  # signed: stored about the middle of its range
    return element(SIMPLE_BLOCK, head + bytes([len(frames) - 1]) + lace + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """One track of 8-bit PCM; blocks take Xiph, EBML and fixed lacing in turn, and each cluster has a cue."""
    entry = uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT")
    entry += uint(DEFAULT_DURATION, FRAME_MS * 1_000_000)
    entry += element(AUDIO, element(SAMPLING, np.array(RATE, ">f8").tobytes()) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    body = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000)), element(TRACKS, element(TRACK_ENTRY, entry))]
    cues, position = b"", sum(map(len, body))
    step = FRAME * LACED * BLOCKS
    for base in range(0, len(payload), step):
        begin_ms, blocks = base // FRAME * FRAME_MS, []
        for k, start in enumerate(range(base, min(base + step, len(payload)), FRAME * LACED)):
            frames = [payload[x : x + FRAME] for x in range(start, min(start + FRAME * LACED, len(payload)), FRAME)]
            lacing = NO_LACE if len(frames) == 1 else (XIPH, EBML_LACE, FIXED)[k % 3]
            lacing = EBML_LACE if lacing == FIXED and len(frames[-1]) != FRAME else lacing
            blocks.append(_block(frames, start // FRAME * FRAME_MS - begin_ms, lacing))
        cluster = element(CLUSTER, uint(TIMESTAMP, begin_ms) + b"".join(blocks))
        cues += element(CUE_POINT, uint(CUE_TIME, begin_ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, position)))
        body.append(cluster)
        position += len(cluster)
    body.append(element(CUES, cues))
    return element(EBML, element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


# --- parsing ---


@dataclass
class Packet:
    track: int
    cluster: int
    timestamp_ns: int
    start: int
    size: int
    keyframe: bool
    lacing: int
    cued: bool | int = False  # while parsing, where the packet's cluster starts


def vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, next position, and whether all value bits are ones (an unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError("no element here")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("cut off")
    n = int.from_bytes(data[at : at + width], "big")
    value = n & ((1 << 7 * width) - 1)
    return (n if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, body start, body end) of the elements in a range, parents not entered.

    An unknown size runs to the next element of the level above, so the range's end is taken and the children of the
    unknown one are found by whoever enters it. Stops quietly at damage: what lies before it is whole.
    """
    while at < end:
        try:
            code, body, _ = vint(data, at, True)
            size, body, unknown = vint(data, body, False)
        except ValueError:
            return
        stop = end if unknown else body + size
        if unknown and code == CLUSTER:
            stop = _open_end(data, body, end)
        if stop > end:
            if code not in PARENTS:
                return
            stop = end
        yield code, body, stop
        at = stop


def _open_end(data: bytes, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: before the next top-level element."""
    while at < end:
        try:
            code, body, _ = vint(data, at, True)
            size, body, _ = vint(data, body, False)
        except ValueError:
            return end
        if code in TOP_LEVEL:
            return at
        at = body + size
    return end


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block's body and where its first frame starts."""
    if lacing == NO_LACE:
        return [end - at], at
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            begin = at
            size, at, _ = vint(data, at, False)
            if k:
                size += sizes[-1] - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def parse(data: bytes) -> list[Packet]:
    """All packets in file order. Damaged or foreign bytes give the packets before the damage, at worst none."""
    packets: list[Packet] = []
    for code, start, end in elements(data, 0, len(data)):
        if code != SEGMENT:
            continue
        scale, spans, cued, clusters = 1_000_000, {}, set(), 0
        for code, a, b in elements(data, start, end):
            if code == INFO:
                scale = next((number(data, x, y) for c, x, y in elements(data, a, b) if c == TIMESTAMP_SCALE), scale)
            elif code == TRACKS:
                for c, x, y in elements(data, a, b):
                    if c == TRACK_ENTRY:
                        own = {k: number(data, p, q) for k, p, q in elements(data, x, y) if k in (TRACK_NUMBER, DEFAULT_DURATION)}
                        spans[own.get(TRACK_NUMBER, 0)] = own.get(DEFAULT_DURATION, 0)
            elif code == CUES:
                for _, x, y in elements(data, a, b):
                    for c, p, q in elements(data, x, y):
                        if c == CUE_POSITIONS:
                            own = {k: number(data, s, t) for k, s, t in elements(data, p, q)}
                            cued.add((own.get(CUE_CLUSTER, -1), own.get(CUE_TRACK, 0)))
            elif code == CLUSTER:
                packets += _cluster(data, a, b, clusters, scale, spans, start)
                clusters += 1
        for p in packets:
            p.cued = (p.cued, p.track) in cued
    return packets


def _cluster(data: bytes, a: int, b: int, index: int, scale: int, spans: dict[int, int], segment: int) -> list[Packet]:
    base, out = 0, []
    where = data.rfind(CLUSTER.to_bytes(4, "big"), 0, a) - segment  # cues count from the segment's body
    for code, x, y in elements(data, a, b):
        if code == TIMESTAMP:
            base = number(data, x, y)
        blocks = [(x, y, False)] if code == SIMPLE_BLOCK else [(p, q, True) for c, p, q in elements(data, x, y) if c == BLOCK] if code == BLOCK_GROUP else []
        for p, q, grouped in blocks:
            try:
                track, at, _ = vint(data, p, False)
                shift, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
                sizes, at = lace_sizes(data, at + 3, q, flags >> 1 & 3)
            except (ValueError, IndexError):
                return out
            if min(sizes) < 0:
                return out
            for k, size in enumerate(sizes):
                time = (base + shift) * scale + k * spans.get(track, 0)
                out.append(Packet(track, index, time, at, size, bool(flags & 0x80) and not grouped, flags >> 1 & 3, where))
                at += size
    return out


# --- Spark ---


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def mux_text(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) to (doc_id, n_bytes, media): the text's UTF-8 bytes, padded with zeros to a positive
    multiple of 64, as a Matroska file. Null text counts as empty; equal texts give equal files; repeated rows stay;
    other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _parts(b)):
            texts = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len((t or "").encode()) for t in texts], pa.int64()),
                    pa.array([mux(padded(t)) for t in texts], pa.binary()),
                ],
                ["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "track int, cluster int, timestamp_ns long, start long, size long, keyframe boolean, lacing string, cued boolean"
LACING = ["none", "xiph", "fixed", "ebml"]


def demux(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A column of Matroska bytes to one row a packet: (key, track, cluster, timestamp_ns, start, size, keyframe,
    lacing, cued), byte ranges from 0. Null or foreign bytes have no packets; a damaged file has those before the
    damage; repeated rows repeat; an empty table gives no rows."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _parts(b, 16)):
            found = [(k, p) for k, m in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for p in parse(m or b"")]
            own = [p for _, p in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in found], part.schema.field(0).type),
                    pa.array([p.track for p in own], pa.int32()), pa.array([p.cluster for p in own], pa.int32()),
                    pa.array([p.timestamp_ns for p in own], pa.int64()), pa.array([p.start for p in own], pa.int64()),
                    pa.array([p.size for p in own], pa.int64()), pa.array([p.keyframe for p in own], pa.bool_()),
                    pa.array([LACING[p.lacing] for p in own], pa.string()), pa.array([p.cued for p in own], pa.bool_()),
                ],
                [key, "track", "cluster", "timestamp_ns", "start", "size", "keyframe", "lacing", "cued"],
            )

    return files.select(key, media).mapInArrow(run, f"`{key}` {kind}, {PACKETS}")


def feature(samples: np.ndarray, packets: int) -> str:
    """packets:samples:sum:energy:peak:crossings of the middle line, all exact integers."""
    wide = samples.astype(np.int64)
    above = samples >= 128
    return ":".join(map(str, (packets, len(wide), int(wide.sum()), int((wide * wide).sum()), int(wide.max(initial=0)), int(np.count_nonzero(above[1:] != above[:-1])))))


def media_digest(docs: DataFrame) -> DataFrame:
    """The query's columns; the payload is read back from the stored bytes by the packets' byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for b in batches for x in _parts(b)):
            columns: list[list] = [[] for _ in range(6)]
            for media in part.column(2).to_pylist():
                packets = sorted((p for p in parse(media) if p.track == 1), key=lambda p: p.timestamp_ns)
                payload = b"".join([media[p.start : p.start + p.size] for p in packets])
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8), len(packets)))
                for c, x in zip(columns, row):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return mux_text(docs).mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )

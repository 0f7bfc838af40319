"""Matroska media columns: a writer for PCM payloads and a parser that turns files into packet tables.

The parser reads EBML elements with variable-length ids and sizes (unknown sizes included), tracks, clusters, SimpleBlocks
and BlockGroups with all four lacings, and cues. A packet row holds its track, timestamp, cluster, lacing, key-frame flag and
the byte range of its data within the file, so data can be cut out without parsing again. The packets of a lace follow one
another by the track's default duration, else by the samples that PCM bytes make, else by their share of the block's duration,
else all have the block's time. Packets of a group are key frames unless it refers to another block.

Null media have no packets, and null texts are stored as empty ones. Repeated rows are kept, equal texts give equal values, an
empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.words import sliced, small_batches
from strandmill.session import ship

# Matroska's element ids.
EBML, SEGMENT, INFO, SCALE, DURATION = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, ENTRY, NUMBER, UID, KIND, CODEC, EACH, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, LASTS, REFERS = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Bytes of a packet, samples a second, packets in a block and blocks in a cluster of the writer.
FRAME, SAMPLES, FRAMES, BLOCKS = 576, 8000, 8, 8


class Packet(NamedTuple):
    track: int
    time_ns: int
    cluster: int
    block: int
    lacing: int
    key: bool
    offset: int
    size: int


class Media(NamedTuple):
    tracks: list[tuple[int, int, str]]  # number, kind, codec
    packets: list[Packet]
    cues: list[tuple[int, int, int]]  # time, track, position of the cluster within the file
    clusters: list[int]


def _number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def _size(n: int) -> bytes:
    """A variable-length size; all ones is reserved."""
    k = 1
    while n >= (1 << (7 * k)) - 1:
        k += 1
    return (n | 1 << (7 * k)).to_bytes(k, "big")


def element(id_: int, body: bytes) -> bytes:
    return _number(id_) + _size(len(body)) + body


def _signed(n: int) -> bytes:
    """A signed variable-length number, as EBML lacing has."""
    k = 1
    while not -(1 << (7 * k - 1)) + 1 <= n <= (1 << (7 * k - 1)) - 1:
        k += 1
    return (n + (1 << (7 * k - 1)) - 1 | 1 << (7 * k)).to_bytes(k, "big")


def block_body(track: int, time: int, frames: list[bytes], lacing: int, key: bool = True) -> bytes:
    out = [_size(track), struct.pack(">hB", time, (0x80 if key else 0) | lacing << 1)]
    if lacing != NO_LACING:
        out.append(bytes([len(frames) - 1]))
    elif len(frames) != 1:
        raise ValueError("several frames need a lacing")
    if lacing == XIPH:
        out += [b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]]
    elif lacing == EBML_LACING and len(frames) > 1:
        out.append(_size(len(frames[0])))
        out += [_signed(len(b) - len(a)) for a, b in zip(frames[:-2], frames[1:-1], strict=True)]
    elif lacing == FIXED and len({len(f) for f in frames}) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return b"".join([*out, *frames])


def write(payload: bytes, frame: int = FRAME) -> bytes:
    """payload, a multiple of ``frame`` bytes, as 8-bit PCM samples: lossless, and equal for equal payloads."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    head = element(EBML, element(0x4282, b"matroska") + element(0x4287, b"\x04") + element(0x4285, b"\x02"))
    info = element(INFO, element(SCALE, _number(1_000_000)) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLES)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLES))) + element(CHANNELS, b"\x01") + element(DEPTH, b"\x08"))
    tracks = element(TRACKS, element(ENTRY, element(NUMBER, b"\x01") + element(UID, b"\x01") + element(KIND, b"\x02") + element(CODEC, b"A_PCM/INT/LIT") + element(EACH, _number(frame * 10**9 // SAMPLES)) + audio))
    body, at, points = [info, tracks], len(info) + len(tracks), []
    for c in range(0, len(frames), FRAMES * BLOCKS):
        base = c * frame * 1000 // SAMPLES
        parts = [element(TIME, _number(base))]
        for b in range(c, min(c + FRAMES * BLOCKS, len(frames)), FRAMES):
            own = frames[b : b + FRAMES]
            lacing = NO_LACING if len(own) == 1 else (FIXED, XIPH, EBML_LACING)[b // FRAMES % 3]
            parts.append(element(SIMPLE, block_body(1, b * frame * 1000 // SAMPLES - base, own, lacing)))
        cluster = element(CLUSTER, b"".join(parts))
        points.append(element(POINT, element(CUE_TIME, _number(base)) + element(CUE_AT, element(CUE_TRACK, b"\x01") + element(CUE_CLUSTER, _number(at)))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(points)))
    return head + element(SEGMENT, b"".join(body))


def _vint(data: bytes, i: int, keep: bool) -> tuple[int, int, bool]:
    """A variable-length number, where it ends, and whether it is the reserved 'unknown' one. keep: with its marker, as in ids."""
    first = data[i]
    if not first:
        raise ValueError(f"bad EBML number at byte {i}")
    k = 9 - first.bit_length()
    raw = int.from_bytes(data[i : i + k], "big")
    if i + k > len(data):
        raise ValueError(f"EBML number cut off at byte {i}")
    value = raw & ((1 << (7 * k)) - 1)
    return raw if keep else value, i + k, value == (1 << (7 * k)) - 1


_OVER = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}


def elements(data: bytes, start: int, end: int, inside_cluster: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(id, where it starts, where its body starts, where it ends) of the elements in [start, end)."""
    i = start
    while i < end:
        id_, j, _ = _vint(data, i, keep=True)
        if inside_cluster and id_ in _OVER:
            return
        size, body, unknown = _vint(data, j, keep=False)
        if unknown:
            if id_ == CLUSTER:
                stop = body
                for *_, stop in elements(data, body, end, inside_cluster=True):  # noqa: B007
                    pass
            else:
                stop = end
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element {id_:X} at byte {i} runs over its parent")
        yield id_, i, body, stop
        i = stop


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _frames(data: bytes, i: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if lacing == NO_LACING:
        return [(i, end)]
    n = data[i] + 1
    i += 1
    sizes = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[i] == 255:
                size += 255
                i += 1
            sizes.append(size + data[i])
            i += 1
    elif lacing == EBML_LACING and n > 1:
        size, i, _ = _vint(data, i, keep=False)
        sizes.append(size)
        for _ in range(n - 2):
            first = data[i]
            raw, j, _ = _vint(data, i, keep=False)
            k = 9 - first.bit_length()
            size += raw - ((1 << (7 * k - 1)) - 1)
            sizes.append(size)
            i = j
    elif lacing == FIXED:
        if (end - i) % n:
            raise ValueError("fixed lacing over frames of several sizes")
        sizes = [(end - i) // n] * (n - 1)
    out = []
    for size in sizes:
        out.append((i, i + size))
        i += size
    if i > end or any(a > b for a, b in out):
        raise ValueError("laced frames run over their block")
    return [*out, (i, end)]


def _real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b - a in (4, 8) else 0.0


def _duration(data: bytes, own: dict[int, tuple[int, int]]):
    """How many nanoseconds a packet of a track lasts by its bytes; None where the track does not tell."""
    if EACH in own:
        each = _uint(data, *own[EACH])
        return lambda size: each
    if AUDIO in own and data[slice(*own[CODEC])].startswith(b"A_PCM"):
        audio = {y: (r, s) for y, _, r, s in elements(data, *own[AUDIO])}
        rate = _real(data, *audio[RATE]) if RATE in audio else 8000.0
        bits = (_uint(data, *audio[CHANNELS]) if CHANNELS in audio else 1) * (_uint(data, *audio[DEPTH]) if DEPTH in audio else 0)
        if rate > 0 and bits:
            return lambda size: round(size * 8 * 1e9 / bits / rate)
    return None


def parse(data: bytes) -> Media:
    tracks, packets, cues, clusters, scale = [], [], [], [], 1_000_000
    lasts: dict[int, object] = {}
    for top, _, at, stop in elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        segment, block = at, 0
        for id_, start, a, b in elements(data, at, stop):
            if id_ == INFO:
                for x, _, p, q in elements(data, a, b):
                    if x == SCALE:
                        scale = _uint(data, p, q)
            elif id_ == TRACKS:
                for x, _, p, q in elements(data, a, b):
                    if x == ENTRY:
                        own = {y: (r, s) for y, _, r, s in elements(data, p, q)}
                        lasts[_uint(data, *own[NUMBER])] = _duration(data, own)
                        tracks.append((_uint(data, *own[NUMBER]), _uint(data, *own[KIND]), data[slice(*own[CODEC])].decode("ascii", "replace")))
            elif id_ == CLUSTER:
                clusters.append(start)
                base = 0
                for x, _, p, q in elements(data, a, b):
                    if x == TIME:
                        base = _uint(data, p, q)
                        continue
                    inner: dict[int, tuple[int, int]] = {}
                    if x == GROUP:
                        for y, _, r, s in elements(data, p, q):
                            inner.setdefault(y, (r, s))
                        if BLOCK not in inner:
                            continue
                        p, q = inner[BLOCK]
                    elif x != SIMPLE:
                        continue
                    track, i, _ = _vint(data, p, keep=False)
                    time, flags = struct.unpack_from(">hB", data, i)
                    lacing = flags >> 1 & 3
                    key = bool(flags & 0x80) if x == SIMPLE else REFERS not in inner
                    frames, now = _frames(data, i + 3, q, lacing), (base + time) * scale
                    each = lasts.get(track)
                    if each is None:
                        share = _uint(data, *inner[LASTS]) * scale // len(frames) if LASTS in inner else 0
                        each = lambda size, share=share: share
                    for r, s in frames:
                        packets.append(Packet(track, now, len(clusters) - 1, block, lacing, key, r, s - r))
                        now += each(s - r)
                    block += 1
            elif id_ == CUES:
                for x, _, p, q in elements(data, a, b):
                    if x == POINT:
                        time = 0
                        for y, _, r, s in elements(data, p, q):
                            if y == CUE_TIME:
                                time = _uint(data, r, s)
                            elif y == CUE_AT:
                                own = {z: _uint(data, t, u) for z, _, t, u in elements(data, r, s)}
                                cues.append((time, own.get(CUE_TRACK, 0), segment + own.get(CUE_CLUSTER, 0)))
    return Media(tracks, packets, cues, clusters)


PACKETS = "key long, track int, time_ns long, cluster int, block int, lacing int, key_frame boolean, offset long, size long"


def packet_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each packet of a binary column of Matroska files."""
    ship(media.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if rows := [(k, *p) for p in parse(data or b"").packets]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["key", "track", "time_ns", "cluster", "block", "lacing", "key_frame", "offset", "size"])

    return media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media")).mapInArrow(task, PACKETS)


def padded(text: bytes, unit: int = FRAME) -> bytes:
    return text + b"\xff" * ((-len(text)) % unit if text else unit)


def stored(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store every text as a Matroska file, parse it, and describe what the packets hold; with keep_media, the file too.

    Null texts are empty: one packet of padding. Files are made row by row, so memory follows the longest text.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(text: bytes) -> tuple:
        media = write(padded(text))
        m = parse(media)
        data = b"".join([media[p.offset : p.offset + p.size] for p in m.packets])
        where = zlib.crc32(b"".join([struct.pack("<QQI", p.time_ns, p.offset, p.size) for p in m.packets]))
        feature = f"{len(m.tracks)}:{len(m.clusters)}:{len(m.packets)}:{len(m.cues)}:{m.packets[-1].time_ns // 1_000_000}:{sum(p.lacing for p in m.packets)}:{where}"
        return len(text), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, media

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            rows = list(zip(*[row((t or "").encode()) for t in b.column("text").to_pylist()], strict=True))
            columns = [b.column("doc_id"), *(pa.array(x, k) for x, k in zip(rows, kinds[1:], strict=False))]
            if keep_media:
                columns.append(pa.array(rows[-1], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *["media"] * keep_media])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(task, schema)

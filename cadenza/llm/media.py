"""Matroska columns: mux samples into EBML, and parse EBML into packet tables.

``mux`` stores 8-bit samples losslessly: one PCM audio track, frames of ``FRAME`` bytes laced into simple
blocks, blocks in clusters, one cue per cluster.  ``parse`` reads any such stream: variable-length element ids
and sizes (unknown sizes of segment and cluster too), simple blocks and block groups, all four lacings, cues.

Nulls: a null media value parses to no packets; a null text is empty and is stored as one frame of zeros.
Malformed streams raise in ``parse`` and give a row with ``error`` set in ``packets``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import common

# Element ids of the container format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, ENTRY, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_VERSION = 0x4282, 0x4287
LACINGS = ("none", "xiph", "fixed", "ebml")

FRAME, RATE_HZ = 64, 8000  # 64 samples at 8 kHz last 8 ms, so that timestamps in ms are exact
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 16


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], lacing: str) -> bytes:
    """The body of a block after its flags."""
    sizes = [len(f) for f in frames]
    if lacing == "none":
        return frames[0]
    head = bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < 1 << 7 * w - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(payload: bytes, lacing: str = "fixed") -> bytes:
    """``payload``, a multiple of ``FRAME`` long, as a Matroska stream of 8-bit PCM."""
    frames = [payload[k : k + FRAME] for k in range(0, len(payload), FRAME)]
    ms = FRAME * 1000 // RATE_HZ
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * ms)))
    audio = element(AUDIO, element(RATE, struct.pack(">d", RATE_HZ)) + uint(CHANNELS, 1) + uint(DEPTH, 8))
    tracks = element(TRACKS, element(ENTRY, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at, per_block = len(info) + len(tracks), 1 if lacing == "none" else FRAMES_PER_BLOCK
    for first in range(0, len(frames), per_block * BLOCKS_PER_CLUSTER):
        blocks = [uint(TIMESTAMP, first * ms)]
        for k in range(first, min(first + per_block * BLOCKS_PER_CLUSTER, len(frames)), per_block):
            group = frames[k : k + per_block]
            how = lacing if len(group) > 1 else "none"
            flags = 0x80 | LACINGS.index(how) << 1
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", (k - first) * ms, flags) + lace(group, how)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * ms) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return element(EBML, uint(DOC_VERSION, 4) + element(DOC_TYPE, b"matroska")) + element(SEGMENT, b"".join(body))


@dataclass
class Stream:
    #: (cluster, track, timestamp in ns, offset, size, lacing, keyframe) of each frame, in stream order
    packets: list[tuple[int, int, int, int, int, str, bool]] = field(default_factory=list)
    #: (time in ns, track, offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    codec: str = ""
    duration_ns: int = 0
    scale: int = 1_000_000


def _vint(data: bytes, at: int, marker: bool = False) -> tuple[int, int, int]:
    """(value, position after it, width); element ids keep their marker bit."""
    first = data[at]
    if not first:
        raise ValueError("element longer than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("cut off in a number")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if marker else value & (1 << 7 * width) - 1), at + width, width


def elements(data: bytes, at: int, end: int):
    """(id, body start, body end) of the elements side by side in a range."""
    while at < end:
        key, at, _ = _vint(data, at, True)
        size, at, width = _vint(data, at)
        unknown = size == (1 << 7 * width) - 1
        stop = end if unknown else at + size
        if unknown and key == CLUSTER:  # it lasts until an element of the level above
            stop = at
            while stop < end:
                inner, body, _ = _vint(data, stop, True)
                if inner in (CLUSTER, CUES, INFO, TRACKS):
                    break
                n, body, _ = _vint(data, body)
                stop = body + n
        if stop > end:
            raise ValueError("element ends after what holds it")
        yield key, at, stop
        at = stop


def _sizes(data: bytes, at: int, end: int, how: str) -> tuple[list[int], int]:
    """Frame sizes of a laced block and where its first frame begins."""
    if how == "none":
        return [end - at], at
    count, at = data[at] + 1, at + 1
    if how == "fixed":
        if (end - at) % count:
            raise ValueError("fixed lacing doesn't divide the block")
        return [(end - at) // count] * count, at
    sizes: list[int] = []
    for k in range(count - 1):
        if how == "xiph":
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            value, at, width = _vint(data, at)
            n = value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1)
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than the block")
    return sizes, at


def parse(data: bytes) -> Stream:
    out = Stream()
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    base = 0

    def block(a: int, b: int, cluster: int, time: int, simple: bool) -> None:
        track, a, _ = _vint(data, a)
        relative, flags = struct.unpack_from(">hB", data, a)
        how = LACINGS[flags >> 1 & 3]
        sizes, at = _sizes(data, a + 3, b, how)
        # Frames of a lace follow each other at the default duration; for PCM that is their length.
        stamp = (time + relative) * out.scale
        for n in sizes:
            out.packets.append((cluster, track, stamp, at, n, how, bool(flags & 0x80) or not simple))
            stamp += n * 1_000_000_000 // RATE_HZ
            at += n

    for key, a, b in elements(data, 0, len(data)):
        if key != SEGMENT:
            continue
        base = a
        for kind, c, d in elements(data, a, b):
            if kind == INFO:
                duration = 0.0
                for k, e, f in elements(data, c, d):
                    if k == SCALE:
                        out.scale = number(e, f)
                    elif k == DURATION:
                        duration = struct.unpack(">d" if f - e == 8 else ">f", data[e:f])[0]
                out.duration_ns = round(duration * out.scale)
            elif kind == TRACKS:
                for _, e, f in elements(data, c, d):
                    out.codec = next((data[g:h].decode() for k, g, h in elements(data, e, f) if k == CODEC), out.codec)
            elif kind == CLUSTER:
                time = 0
                out.clusters.append(c)
                for k, e, f in elements(data, c, d):
                    if k == TIMESTAMP:
                        time = number(e, f)
                    elif k == SIMPLE_BLOCK:
                        block(e, f, len(out.clusters) - 1, time, True)
                    elif k == BLOCK_GROUP:
                        for k2, g, h in elements(data, e, f):
                            if k2 == BLOCK:
                                block(g, h, len(out.clusters) - 1, time, False)
            elif kind == CUES:
                for _, e, f in elements(data, c, d):
                    time = next((number(g, h) for k, g, h in elements(data, e, f) if k == CUE_TIME), 0)
                    for k, g, h in elements(data, e, f):
                        if k == CUE_POSITIONS:
                            found = {k2: number(i, j) for k2, i, j in elements(data, g, h)}
                            out.cues.append((time * out.scale, found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
    return out


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 with zero bytes up to a positive multiple of ``FRAME``, and the length before."""
    raw = text.encode()
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\0"), len(raw)


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table doc_id, n_bytes, media: every whole text as a Matroska stream."""

    def run(ids, rows):
        found = [padded(t) for t in rows.to_pylist()]
        return [ids, [n for _, n in found], [mux(p) for p, _ in found]]

    schema = f"doc_id {common.id_type(df, id_col)}, n_bytes long, media binary"
    return common.written(common.map_rows(common.texts(df, id_col, text_col), run, schema), "media", compression="zstd")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The packet table: doc_id, packet, cluster, track, timestamp_ns, offset, size, lacing, keyframe, error."""
    schema = f"doc_id {common.id_type(df, id_col)}, packet int, cluster int, track int, timestamp_ns long, offset long, size long, lacing string, keyframe boolean, error string"
    arrow = common.arrow_of(schema)

    def run(batches):
        for batch in batches:
            for doc, data in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows = [(doc, k, *p, None) for k, p in enumerate(parse(data or b"").packets)]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(doc, *[None] * 8, str(e))]
                if rows:
                    yield common.batch_of(arrow, [*zip(*rows)])

    return df.select(id_col, media_col).mapInArrow(run, schema)


def features(df: DataFrame) -> DataFrame:
    """From the stored bytes alone: payload and stored digests and a feature string, one row a document."""
    schema = f"doc_id {common.id_type(df, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    arrow = common.arrow_of(schema)

    def one(doc, n_bytes: int, data: bytes) -> tuple:
        s = parse(data)
        payload = b"".join([data[p[3] : p[3] + p[4]] for p in s.packets])
        x = np.frombuffer(payload, np.uint8).astype(np.int64)
        crossings = int(np.count_nonzero(np.diff((x >= 128).astype(np.int8))))
        what = f"codec={s.codec};clusters={len(s.clusters)};packets={len(s.packets)};cues={len(s.cues)};duration_ms={s.duration_ns // 1_000_000};last_ns={s.packets[-1][2]};sum={x.sum()};energy={(x * x).sum()};peak={x.max()};crossings={crossings}"
        return doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), what

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield common.batch_of(arrow, [*zip(*(one(*r) for r in zip(*(c.to_pylist() for c in part.columns))))])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)

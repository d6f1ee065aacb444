"""Matroska media columns: a muxer for raw samples and a demuxer to packet tables.

The demuxer reads variable-length EBML elements (known and unknown sizes), Info, Tracks, Clusters with
SimpleBlocks and BlockGroups, all four kinds of lacing, and Cues.  Each packet gets its track, timestamp,
flags and byte range in the file.  Only the standard library and numpy are used; one file at a time is in
memory.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import utf8
from ._spark import tune

# Element ids, fixed by the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: Samples of one frame, frames of one laced block, blocks of one cluster, samples a second.
FRAME, LACE, BLOCKS, RATE = 576, 8, 32, 8000
_LACINGS = {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}


def number(value: int, width: int | None = None) -> bytes:
    """An EBML variable-length size."""
    width = width or next(w for w in range(1, 9) if value < (1 << (7 * w)) - 1)
    return (value | (1 << (7 * width))).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + number(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(track: int, at: int, frames: list[bytes], lacing: str) -> bytes:
    head = number(track) + struct.pack(">hB", at, 0x80 | (_LACINGS[lacing] if len(frames) > 1 else 0))
    if len(frames) > 1:
        head += bytes([len(frames) - 1])
        sizes = [len(f) for f in frames]
        if lacing == "xiph":
            head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
        elif lacing == "ebml":
            head += number(sizes[0])
            for a, b in zip(sizes, sizes[1:-1]):
                width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
                head += number(b - a + (1 << (7 * width - 1)) - 1, width)
        elif len(set(sizes)) > 1:
            raise ValueError("fixed lacing needs frames of one size")
    return element(SIMPLE_BLOCK, head + b"".join(frames))


def mux(payload: bytes, lacing: str = "fixed", frame: int = FRAME, lace: int = LACE) -> bytes:
    """A Matroska file with ``payload`` as unsigned 8-bit mono samples, losslessly and deterministically."""
    lace = 1 if lacing == "none" else lace
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    span = lambda n: n * frame * 1000 // RATE
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    parts = [
        element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", span(len(frames)))) + element(MUXING_APP, b"resolvent") + element(WRITING_APP, b"resolvent")),
        element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, int(lace > 1)) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)),
    ]
    at, cues = sum(map(len, parts)), []
    for i in range(0, len(frames), lace * BLOCKS):
        begin = span(i)
        cues.append(element(CUE_POINT, uint(CUE_TIME, begin) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        blocks = [_block(1, span(k) - begin, frames[k : k + lace], lacing) for k in range(i, min(i + lace * BLOCKS, len(frames)), lace)]
        parts.append(element(CLUSTER, uint(TIMESTAMP, begin) + b"".join(blocks)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


@dataclass
class Media:
    """What a file holds: tracks, (track, timestamp in ns, key frame, offset, size) per packet, (time, track, offset) per cue."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def _vint(data: bytes, at: int, keep: bool) -> tuple[int | None, int]:
    """A variable-length number at ``at`` and the offset behind it; None for the reserved unknown size."""
    if at >= len(data):
        raise ValueError(f"the file ends at byte {at}, inside an element")
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"broken element at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value &= (1 << (7 * width)) - 1
        if value == (1 << (7 * width)) - 1:
            return None, at + width
    return value, at + width


def _children(data: bytes, at: int, end: int, stop: tuple[int, ...] = ()):
    """(id, begin, end) of the elements in a range; an element of unknown size ends at its parent's next sibling."""
    while at < end:
        ident, p = _vint(data, at, True)
        if ident in stop:
            return
        size, p = _vint(data, p, False)
        if size is None:
            close = end
            if ident == CLUSTER:
                for kind, a, b in _children(data, p, end, (CLUSTER, CUES, TRACKS, INFO)):
                    close = b
        else:
            close = p + size
            if close > end:
                raise ValueError(f"element at byte {at} ends behind its parent")
        yield ident, p, close
        at = close


def _sizes(data: bytes, p: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Frame sizes of a block whose lacing byte is at ``p``, and where its first frame begins."""
    if not lacing:
        return [end - p], p
    n, p = data[p] + 1, p + 1
    if lacing == 4:
        if (end - p) % n:
            raise ValueError("fixed lacing does not divide the block")
        return [(end - p) // n] * n, p
    sizes: list[int] = []
    if lacing == 2:
        for _ in range(n - 1):
            size = 0
            while data[p] == 255:
                size, p = size + 255, p + 1
            sizes, p = [*sizes, size + data[p]], p + 1
    else:
        for k in range(n - 1):
            q = p
            value, p = _vint(data, p, False)
            if value is None:
                value = (1 << (7 * (p - q))) - 1
            sizes.append(value if not k else sizes[-1] + value - ((1 << (7 * (p - q) - 1)) - 1))
    last = end - p - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced frames are longer than their block")
    return [*sizes, last], p


def demux(data: bytes) -> Media:
    """Parse a file; raises ValueError where it is broken."""
    try:
        return _demux(data)
    except (IndexError, struct.error) as e:
        raise ValueError("the file ends inside an element") from e


def _demux(data: bytes) -> Media:
    out = Media()
    value = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]

    def block(p: int, end: int, base: int, key: bool | None) -> None:
        track, p = _vint(data, p, False)
        rel, flags = struct.unpack_from(">hB", data, p)
        sizes, p = _sizes(data, p + 3, end, flags & 6)
        ns = (base + rel) * out.scale
        info = out.tracks.get(track, {})
        step = 1e9 / info["rate"] / max(1, info.get("channels", 1)) / max(1, info.get("bits", 8) // 8) if info.get("rate") else 0.0
        done = 0
        for n in sizes:
            out.packets.append((track, ns + round(done * step), bool(flags & 0x80) if key is None else key, p, n))
            p, done = p + n, done + n

    for top, a, b in _children(data, 0, len(data)):
        if top == EBML:
            out.doc_type = next((data[x:y].decode("ascii", "replace") for i, x, y in _children(data, a, b) if i == DOC_TYPE), "")
        if top != SEGMENT:
            continue
        for ident, c, d in _children(data, a, b):
            if ident == INFO:
                for i, x, y in _children(data, c, d):
                    if i == TIMESTAMP_SCALE:
                        out.scale = value(x, y)
                    elif i == DURATION:
                        out.duration = real(x, y)
            elif ident == TRACKS:
                for _, e, f in (t for t in _children(data, c, d) if t[0] == TRACK_ENTRY):
                    track: dict = {}
                    for i, x, y in _children(data, e, f):
                        if i in (TRACK_NUMBER, TRACK_TYPE):
                            track["number" if i == TRACK_NUMBER else "type"] = value(x, y)
                        elif i == CODEC_ID:
                            track["codec"] = data[x:y].decode("ascii", "replace")
                        elif i == AUDIO:
                            for j, v, w in _children(data, x, y):
                                if j == SAMPLING:
                                    track["rate"] = real(v, w)
                                elif j in (CHANNELS, BIT_DEPTH):
                                    track["channels" if j == CHANNELS else "bits"] = value(v, w)
                    out.tracks[track.get("number", 0)] = track
            elif ident == CLUSTER:
                base = 0
                for i, x, y in _children(data, c, d):
                    if i == TIMESTAMP:
                        base = value(x, y)
                    elif i == SIMPLE_BLOCK:
                        block(x, y, base, None)
                    elif i == BLOCK_GROUP:
                        inner = list(_children(data, x, y))
                        for _, v, w in (t for t in inner if t[0] == BLOCK):
                            block(v, w, base, all(t[0] != 0xFB for t in inner))  # key frame: refers to no other
            elif ident == CUES:
                for _, e, f in (t for t in _children(data, c, d) if t[0] == CUE_POINT):
                    time, where = 0, []
                    for i, x, y in _children(data, e, f):
                        if i == CUE_TIME:
                            time = value(x, y)
                        elif i == CUE_POSITIONS:
                            got = {j: value(v, w) for j, v, w in _children(data, x, y)}
                            where.append((got.get(CUE_TRACK, 0), a + got.get(CUE_CLUSTER, 0)))
                    out.cues += [(time * out.scale, t, p) for t, p in where]
    return out


def features(samples: np.ndarray, media: Media) -> str:
    """Figures of the samples and the container, of fixed precision."""
    x = samples.astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={len(media.packets)};cues={len(media.cues)};ms={media.duration:.0f};mean={x.sum() / n:.4f};rms={(float((x * x).sum()) / n) ** 0.5:.4f};zcr={crossings / n:.6f};peak={int(abs(x).max(initial=0))}"


def to_media(docs: DataFrame, frame: int = FRAME, lacing: str = "fixed") -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_bytes, media binary)``: the text's UTF-8 (null: empty), padded
    with bytes 255 to a positive multiple of ``frame``, as one audio track."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            buf, off = utf8(b.column(1))
            text, ends = buf.tobytes(), off.tolist()
            i = 0
            while i < b.num_rows:
                media, j, size = [], i, 0
                while j < b.num_rows and size < 1 << 22:
                    n = ends[j + 1] - ends[j]
                    media.append(mux(text[ends[j] : ends[j + 1]] + b"\xff" * (-n % frame if n else frame), lacing, frame))
                    size += len(media[-1])
                    j += 1
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(np.diff(off[i : j + 1])), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """``media(doc_id, media)`` -> one row per packet: ``doc_id, packet, track, ns, key, offset, size``.

    Null and empty media have no packets, broken ones raise ValueError; repeated rows give repeated packets, other columns
    are ignored, an empty table gives no rows."""

    def run(batches):
        for b in batches:
            for ident, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = demux(data).packets if data else []
                yield pa.RecordBatch.from_arrays([pa.array([ident] * len(got), pa.int64()), pa.array(range(len(got)), pa.int64()), *(pa.array([g[k] for g in got], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())))], ["doc_id", "packet", "track", "ns", "key", "offset", "size"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet long, track int, ns long, key boolean, offset long, size long")


def digests(media: DataFrame) -> DataFrame:
    """``media(doc_id, n_bytes, media)`` -> payload and container digests and features, read from the stored bytes.

    Null media have null figures, broken ones raise ValueError; repeated rows give repeated results, other columns are
    ignored, an empty table gives no rows."""

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                if data is None:
                    rows.append((None,) * 6)
                    continue
                got = demux(data)
                payload = b"".join([data[p : p + n] for _, _, _, p, n in got.packets])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(np.frombuffer(payload, np.uint8), got)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_digests(docs: DataFrame, frame: int = FRAME, lacing: str = "fixed") -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``.  A null or empty text is one frame of bytes 255; repeated
    rows give repeated results, equal texts equal values; other columns are ignored."""
    return digests(to_media(docs, frame, lacing))

"""Matroska as a column: a writer and a reader of EBML, with packet tables.

The writer stores a payload as one track of 8-bit samples (``A_PCM/INT/LIT``) in blocks of 576 samples: clusters of
laced blocks, Xiph, EBML and fixed-size lacing in turn, and cues to every cluster. Nothing in a file hangs on time or
chance, so equal payloads give equal files. The reader walks elements by their variable-length identifiers and sizes,
unknown sizes of segment and clusters included, and undoes all lacings.

Timestamps are in ticks of the file's own scale and in nanoseconds; frames of a lace follow each other by the track's default
duration.

Cases of the columns: null text is empty; an empty text is padded to one block of 576 bytes 255; equal texts give equal
values; repeated rows stay; an empty table gives no rows; other columns are not read. A text is handled whole, one at a time.
A damaged file ends no job: its row says why in ``error``, after the packets that stand before the damage; a null file has
no packets and no features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import arrow_map, batch, texts

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, RATE, PAD = 576, 8, 32, 48_000, 255
#: Fixed values of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x114D9B74, 0x1254C367
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP_SCALE = 0xE7, 0xA3, 0xA0, 0xA1, 0x2AD7B1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
_TOP = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def size_vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are left for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def signed_vint(n: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1))
    return size_vint(n + (1 << 7 * width - 1) - 1, width)


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """Value and end of the integer at ``at``; None is an unknown size."""
    first = data[at]
    if not first:
        raise ValueError("an integer of over eight bytes")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError("cut short")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return None if n == (1 << 7 * width) - 1 else n, at + width


def lace(frames: list[bytes], kind: int) -> bytes:
    """The head of lace sizes and the frames."""
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACE:
        head += size_vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    elif len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return head + b"".join(frames)


def unlace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if kind == NO_LACE:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % n:
            raise ValueError("a fixed-size lace that does not divide")
        sizes = [(end - at) // n] * n
    else:
        for i in range(n - 1):
            if kind == XIPH:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            elif not i:
                size, at = read_vint(data, at)
            else:
                start = at
                delta, at = read_vint(data, at)
                size = sizes[-1] + delta - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) != end:
        raise ValueError("lace sizes that do not fit the block")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


def payload_of(text: bytes) -> bytes:
    """``text`` with bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def mux(payload: bytes) -> bytes:
    """A file that holds the payload, a whole number of frames, one millisecond tick a timestamp of 12 for a frame."""
    head = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"docstruct") + element(0x5741, b"docstruct"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    body, cues, per = [info, element(TRACKS, track)], [], FRAME * FRAMES_A_BLOCK
    at = sum(map(len, body))
    for c, start in enumerate(range(0, len(payload), per * BLOCKS_A_CLUSTER)):
        part = payload[start : start + per * BLOCKS_A_CLUSTER]
        began = start // FRAME * FRAME * 1000 // RATE
        blocks = [number(TIMESTAMP, began)]
        for i, lo in enumerate(range(0, len(part), per)):
            frames = [part[k : k + FRAME] for k in range(lo, min(lo + per, len(part)), FRAME)]
            kind = (XIPH, EBML_LACE, FIXED)[(c + i) % 3] if len(frames) > 1 else NO_LACE
            ticks = (start + lo) // FRAME * FRAME * 1000 // RATE - began
            blocks.append(element(SIMPLE_BLOCK, size_vint(1) + struct.pack(">hB", ticks, 0x80 | kind << 1) + (lace(frames, kind) if kind else frames[0])))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, began) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


class Packet(NamedTuple):
    track: int
    timestamp: int
    nanoseconds: int
    first_byte: int
    last_byte: int
    cluster: int
    lacing: int
    keyframe: bool


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict[str, object]]
    clusters: list[int]
    cues: list[tuple[int, int, int]]
    scale: int
    error: str | None


def _children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Identifier, start and end of each child; one of unknown size ends before the next top-level element."""
    while at < end:
        ident, at = read_vint(data, at, keep_mark=True)
        size, at = read_vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            if ident in (SEGMENT, CLUSTER):  # what is there is looked at before the damage is told
                yield ident, at, end
            raise ValueError("an element runs over its parent's end")
        if size is None and ident == CLUSTER:
            stop = at
            while stop < end:
                inner, k = read_vint(data, stop, keep_mark=True)
                if inner in _TOP:
                    break
                n, k = read_vint(data, k)
                stop = end if n is None else k + n
        yield ident, at, stop
        at = stop


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _block(data: bytes, at: int, end: int, cluster: int, began: int, simple: bool, scale: int, out: list[Packet], tracks: dict) -> None:
    track, at = read_vint(data, at)
    ticks, flags = struct.unpack_from(">hB", data, at)
    kind, time = flags >> 1 & 3, (began + ticks) * scale
    step = tracks.get(track, {}).get("default_duration", 0) or 0
    for k, (lo, hi) in enumerate(unlace(data, at + 3, end, kind)):
        out.append(Packet(track, (time + k * step) // scale, time + k * step, lo, hi, cluster, kind, bool(flags & 0x80) or not simple))


def _track(data: bytes, at: int, end: int) -> tuple[int, dict[str, object]]:
    of = {k: (x, y) for k, x, y in _children(data, at, end)}
    audio = {k: (x, y) for k, x, y in _children(data, *of[AUDIO])} if AUDIO in of else {}
    known = lambda held, k: _uint(data, *held[k]) if k in held else None
    return _uint(data, *of[TRACK_NUMBER]), {"type": known(of, TRACK_TYPE), "codec": data[slice(*of[CODEC_ID])].decode(errors="replace") if CODEC_ID in of else None, "default_duration": known(of, DEFAULT_DURATION), "bits": known(audio, BIT_DEPTH)}


def _parts(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Each element of a segment: the segment's start, identifier, start and end."""
    for ident, at, end in _children(data, 0, len(data)):
        if ident == SEGMENT:
            for part, lo, hi in _children(data, at, end):
                yield at, part, lo, hi


def demux(data: bytes, strict: bool = True) -> Media:
    """Packet table, tracks, cluster offsets (from the segment's start) and cues; byte ranges count from the file's start.

    A damaged file raises ``ValueError``; unless ``strict``, what stands before the damage is given with the ``error``.
    """
    packets: list[Packet] = []
    tracks: dict[int, dict[str, object]] = {}
    clusters, cues, scale, error = [], [], 1_000_000, None
    try:
        seen, segment = None, None
        for segment_at, part, lo, hi in _parts(data):
            if segment_at != segment:
                seen = segment = segment_at
            if part == INFO:
                scale = next((_uint(data, a, b) for i, a, b in _children(data, lo, hi) if i == TIMESTAMP_SCALE), scale) or 1_000_000
            elif part == TRACKS:
                tracks.update(_track(data, a, b) for i, a, b in _children(data, lo, hi) if i == TRACK_ENTRY)
            elif part == CLUSTER:
                clusters.append(seen - segment)
                began = 0
                for i, a, b in _children(data, lo, hi):
                    if i == TIMESTAMP:
                        began = _uint(data, a, b)
                    elif i == SIMPLE_BLOCK:
                        _block(data, a, b, len(clusters) - 1, began, True, scale, packets, tracks)
                    elif i == BLOCK_GROUP:
                        for k, x, y in _children(data, a, b):
                            if k == BLOCK:
                                _block(data, x, y, len(clusters) - 1, began, False, scale, packets, tracks)
            elif part == CUES:
                for i, a, b in _children(data, lo, hi):
                    if i == CUE_POINT:
                        point = {k: (x, y) for k, x, y in _children(data, a, b)}
                        place = {k: _uint(data, x, y) for k, x, y in _children(data, *point[CUE_TRACK_POSITIONS])}
                        cues.append((_uint(data, *point[CUE_TIME]), place[CUE_TRACK], place[CUE_CLUSTER_POSITION]))
            seen = hi
        if segment is None:
            raise ValueError("no segment")
    except (ValueError, IndexError, KeyError, struct.error) as e:
        if strict:
            raise ValueError(str(e) or type(e).__name__) from e
        error = f"{type(e).__name__}: {e}"
    return Media(packets, tracks, clusters, cues, scale, error)


def read_payload(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.first_byte : p.last_byte] for p in media.packets if p.track == track)


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """Packets, clusters and lacings, whether each cue leads to a cluster, the last timestamp, mean and deviation of samples, and their 8-bin histogram."""
    samples = np.frombuffer(payload, np.uint8)
    kinds = np.bincount([p.lacing for p in media.packets], minlength=4)
    n, total, squares = len(samples), int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    mean = total / n if n else 0.0
    spread = max(0.0, squares / n - mean * mean) ** 0.5 if n else 0.0
    clusters = set(media.clusters)
    led = sum(c[2] in clusters for c in media.cues)
    histogram = np.bincount(samples >> 5, minlength=8)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};laces={','.join(map(str, kinds))};cues={led}/{len(media.cues)};end={media.packets[-1].timestamp if media.packets else 0};mean={mean:.4f};sd={spread:.4f};bins={','.join(map(str, histogram))}"


PACKETS = "id long, packet int, track int, timestamp long, nanoseconds long, first_byte long, last_byte long, cluster int, lacing int, keyframe boolean, error string"
_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_PACKETS = pa.schema([("id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("timestamp", pa.int64()), ("nanoseconds", pa.int64()), ("first_byte", pa.int64()), ("last_byte", pa.int64()), ("cluster", pa.int32()), ("lacing", pa.int32()), ("keyframe", pa.bool_()), ("error", pa.string())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
#: Stored bytes in one Arrow batch, about.
_BATCH = 16 << 20


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text stored as a file in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                rows.append((doc_id, len(text), mux(payload_of(text))))
                held += len(rows[-1][2])
                if held > _BATCH:
                    yield batch(_MEDIA, *zip(*rows, strict=True))
                    rows, held = [], 0
            if rows:
                yield batch(_MEDIA, *zip(*rows, strict=True))

    return arrow_map(docs, run, "doc_id long, n_bytes long, media binary", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file, in file order, and one with ``error`` alone after those of a damaged file. Null files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ident, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not data.is_valid:
                    continue
                found = demux(data.as_py(), strict=False)
                if found.packets:
                    yield batch(_PACKETS, [ident] * len(found.packets), list(range(len(found.packets))), *zip(*found.packets, strict=True), [None] * len(found.packets))
                if found.error:
                    yield batch(_PACKETS, [ident], *[[None]] * (len(_PACKETS) - 2), [found.error])

    return arrow_map(media, run, PACKETS, F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the feature of each stored file, all from the file's bytes; of a damaged one its own digest and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = value.as_py()
                if data is None:
                    rows.append((doc_id, n, *[None] * 7))
                    continue
                found = demux(data, strict=False)
                if found.error:
                    rows.append((doc_id, n, None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, found.error))
                    continue
                payload = read_payload(data, found)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(data, found, payload), None))
            if rows:
                yield batch(_FEATURES, *zip(*rows, strict=True))

    return arrow_map(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string", "doc_id", "n_bytes", "media")

"""Media columns: AVI motion-JPEG files in a binary column, and their shots.

Storing: a payload of bytes, filled up to whole frames of WIDTH x HEIGHT
samples, becomes one motion-JPEG stream, each sample an even 8x8 block, with an
index. Reading: RIFF chunks and the index are parsed, each frame (all are
intra) is decoded, and a shot ends where the grey histogram changes by far more
than it did in the frames before. A chunk of the file's own says how many bytes
the payload has: what fills up the last frame counts in no histogram and no mean,
and a last frame that is more filler than payload begins no shot.

Defined cases: a null text is the empty payload, which fills one frame; equal
texts give equal files; a file without an index is read by walking its
chunks; a file that doesn't say how long its payload is has no filler; a file
without frames has no clip, one of filler alone has one of level 0; a broken
file raises; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from struct import pack, unpack_from
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import lean, ranges, spread, text_slices

WIDTH = HEIGHT = 24
SAMPLES = WIDTH * HEIGHT
FILL = 255
#: The chunk that holds the payload's bytes, 64 bits.
LENGTH = b"plen"
FRAME_MS = 40
#: Files are decoded together until they have so many bytes.
GROUP_BYTES = 2_000_000
#: A cut: the histogram's change is above FLOOR and above the mean of the last WINDOW changes by SPREAD deviations.
WINDOW, SPREAD, FLOOR, BINS = 12, 3.0, 0.12, 32


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def avi(frames: list[bytes], width: int, height: int, frame_ms: int = FRAME_MS, payload: int | None = None) -> bytes:
    """An AVI file of one motion-JPEG stream, with its index, and the bytes of its payload if they are given."""
    most = max(map(len, frames), default=0)
    main = pack("<10I16x", frame_ms * 1000, most * 1000 // frame_ms, 0, 0x10, len(frames), 0, 1, most, width, height)
    stream = pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, frame_ms, 1000, 0, len(frames), most, -1, 0, 0, 0, width, height)
    form = pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", form)))
    index, at = [], 4
    for f in frames:
        index.append(pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    if payload is not None:
        head += _chunk(LENGTH, pack("<Q", payload))
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", b"".join([_chunk(b"00dc", f) for f in frames])) + _chunk(b"idx1", b"".join(index)))


def parse_avi(data: bytes) -> tuple[int, list[bytes]]:
    """(microseconds of a frame, the video frames in order) of an AVI file, by its index where it has one."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    us, movi, index, at, end = 0, None, None, 12, min(len(data), 8 + unpack_from("<I", data, 4)[0])
    while at + 8 <= end:
        name, n = data[at : at + 4], unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            found = data.find(b"avih", at, at + 8 + n)
            us = unpack_from("<I", data, found + 8)[0] if found >= 0 else 0
        elif name == b"LIST" and kind == b"movi":
            movi = (at + 8, at + 8 + n)
        elif name == b"idx1":
            index = (at + 8, n // 16)
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    if index:
        entries = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]), index[1], index[0])
        base = movi[0] if not len(entries) or entries["at"][0] < movi[0] else 0  # from the list, or from the file's start
        for name, a, n in zip(entries["id"].tolist(), entries["at"].tolist(), entries["n"].tolist(), strict=True):
            if name[2:] in (b"dc", b"db"):
                a += base
                if data[a : a + 4] != name or unpack_from("<I", data, a + 4)[0] != n:
                    raise ValueError("the index doesn't fit its chunks")
                frames.append(data[a + 8 : a + 8 + n])
        return us, frames
    at = movi[0] + 4
    while at + 8 <= movi[1]:
        n = unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"LIST":  # a rec list: its chunks follow
            at += 12
            continue
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            frames.append(data[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return us, frames


def payload_bytes(data: bytes) -> int | None:
    """What the file says of its payload's length, if anything."""
    at = 12
    while at + 16 <= len(data) and data[at : at + 4] != b"idx1":
        if data[at : at + 4] == LENGTH:
            return unpack_from("<Q", data, at + 8)[0]
        n = unpack_from("<I", data, at + 4)[0]
        at += 8 + n + (n & 1)
    return None


def cuts(planes: np.ndarray, known: int | None = None) -> np.ndarray:
    """First frames of all shots but the first, from the grey histograms of frames x samples, of which the first `known` count."""
    n, width = planes.shape
    if n < 3:
        return np.zeros(0, int)
    known = planes.size if known is None else known
    slot = (np.arange(n)[:, None] * BINS + (planes >> 3)).ravel()[:known]
    hist = np.bincount(slot, minlength=n * BINS).reshape(n, BINS)
    size = np.clip(known - np.arange(n) * width, 0, width)
    hist = hist / np.maximum(size, 1)[:, None]
    change = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    change[2 * size[1:] < width] = 0
    one = np.concatenate([[0.0], np.cumsum(change)])
    two = np.concatenate([[0.0], np.cumsum(change**2)])
    k = np.arange(1, len(change))
    low = np.maximum(k - WINDOW, 0)
    mean = (one[k] - one[low]) / (k - low)
    deviation = np.sqrt(np.maximum((two[k] - two[low]) / (k - low) - mean**2, 0))
    return k[(change[1:] > FLOOR) & (change[1:] > mean + SPREAD * deviation + 1e-9)] + 1


def shots(planes: np.ndarray, us: int, known: int | None = None) -> list[tuple[int, int, float]]:
    """(start ms, end ms, mean grey) of each shot; samples from `known` on are filler."""
    if not len(planes):
        return []
    bounds = [0, *cuts(planes, known).tolist(), len(planes)]
    width, flat = planes.shape[1], planes.ravel()[:known]
    level = lambda a, b: float(part.mean()) if (part := flat[a * width : b * width]).size else 0.0
    return [(a * us // 1000, b * us // 1000, level(a, b)) for a, b in zip(bounds, bounds[1:], strict=False)]


def filled(payload: bytes) -> bytes:
    """payload with bytes FILL up to a positive multiple of a frame's samples."""
    whole = max(1, -(-len(payload) // SAMPLES)) * SAMPLES
    return payload + bytes([FILL]) * (whole - len(payload))


def store(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as an AVI file."""
    slim = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, texts in text_slices(b, 1_000_000):
                raw = [t.encode() for t in texts]
                whole = [filled(x) for x in raw]
                planes = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, SAMPLES)
                frames, at, media = jpeg.encode(planes, WIDTH, HEIGHT), 0, []
                for x, own in zip(whole, raw, strict=True):
                    n = len(x) // SAMPLES
                    media.append(avi(frames[at : at + n], WIDTH * 8, HEIGHT * 8, payload=len(own)))
                    at += n
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return slim.mapInArrow(lean(run), f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def _decoded(media: list[bytes]) -> Iterator[tuple[int, np.ndarray, int | None]]:
    """(microseconds of a frame, frames x block means, payload's bytes) of each file; frames of all are decoded together."""
    files = [parse_avi(m) for m in media]
    planes, at = jpeg.decode([f for _, frames in files for f in frames]), 0
    for (us, frames), data in zip(files, media, strict=True):
        own = planes[at : at + len(frames)]
        at += len(frames)
        yield us, np.stack(own) if own else np.zeros((0, 0), np.uint8), payload_bytes(data)


def describe(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keep, and what reading the stored files back gives: the payload's figures, the file's and its features."""
    slim = df.select(*keep, F.col(media).alias("media"))
    fields = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media")
            for i, j in ranges(pc.binary_length(files).to_pylist(), GROUP_BYTES):
                own, out = files.slice(i, j - i).to_pylist(), []
                for m, (us, planes, known) in zip(own, _decoded(own), strict=True):
                    payload = planes.tobytes()
                    clips = shots(planes, us, known)
                    feature = f"{len(planes)} frames, {len(clips)} shots: " + ", ".join(f"{a}-{z} ms {g:.2f}" for a, z, g in clips)
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, j - i) for k in keep), *cols], [*keep, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return slim.mapInArrow(lean(run), f"{fields}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def clips(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(id, clip, start_ms, end_ms, mean_level): a row for each shot of each file; null files have none."""
    slim = df.select(F.col(id_col).alias("id"), F.col(media).alias("media")).filter("media is not null")
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column("media")
            for i, j in ranges(pc.binary_length(files).to_pylist(), GROUP_BYTES):
                rows = []
                for key, (us, planes, known) in zip(b.column("id").slice(i, j - i), _decoded(files.slice(i, j - i).to_pylist()), strict=True):
                    rows += [(key.as_py(), k, *shot) for k, shot in enumerate(shots(planes, us, known))]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (b.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "clip", "start_ms", "end_ms", "mean_level"])

    return slim.mapInArrow(lean(run), f"id {kind}, clip int, start_ms bigint, end_ms bigint, mean_level double").withColumnRenamed("id", id_col)

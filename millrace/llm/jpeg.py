"""Baseline JPEG for motion-JPEG frames: an exact writer of sample planes, and a decoder.

The writer makes one 8x8 block of even grey from each sample: the DC step is 8,
so a decoded pixel is the sample itself, without loss. The decoder reads any
baseline frame (grey or with chroma, whose luma it returns). Frames of even
blocks, as the writer makes them, are decoded many at a time: one table lookup
for each block and all frames in step.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from struct import pack, unpack

import numpy as np

# Fixed values of the format: the order of coefficients in a block, by diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
#: Code lengths of the writer's DC categories 0 to 8, and its one AC code, the end of a block.
DC_LENGTHS = (2, 3, 3, 3, 3, 3, 4, 5, 6)
EOB_LENGTH = 1


def _segment(marker: int, body: bytes) -> bytes:
    return pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), codes in order of length and then of the given order."""
    out, code, before = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - before
        out[symbol], before = (code, n), n
        code += 1
    return out


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    counts = bytes(sum(1 for n in lengths.values() if n == k) for k in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(sorted(lengths, key=lambda s: lengths[s])))


@lru_cache(maxsize=8)
def header(width: int, height: int) -> bytes:
    """All of a frame before its scan data, for a plane of width x height samples."""
    quant = _segment(0xDB, bytes([0, 8] + [1] * 63))
    frame = _segment(0xC0, pack(">BHHB", 8, height * 8, width * 8, 1) + bytes([1, 0x11, 0]))
    tables = _table(0, dict(enumerate(DC_LENGTHS))) + _table(0x10, {0: EOB_LENGTH})
    return b"\xff\xd8" + quant + frame + tables + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


@lru_cache(maxsize=1)
def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255 to 255, at +255: code with extra bits and end of block, and its length."""
    dc, value, length = _canonical(dict(enumerate(DC_LENGTHS))), np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = (code << size | extra) << EOB_LENGTH
        length[d + 255] = n + size + EOB_LENGTH
    return value, length


def encode(planes: np.ndarray, width: int, height: int) -> list[bytes]:
    """JPEG frames of planes (frames x width * height samples, uint8)."""
    frames = len(planes)
    levels = planes.astype(np.int64) - 128
    change = np.diff(levels, axis=1, prepend=0) + 255
    value, length = (t[change] for t in _codes())
    bits = length.sum(1)
    size = (bits + 7) >> 3
    starts = np.concatenate([[0], np.cumsum(size)])
    at = starts[:-1, None] * 8 + np.cumsum(length, 1) - length
    word = (value.astype(np.int64) << (24 - (at & 7) - length)).ravel()  # at most 15 bits, so within 3 bytes
    first, total = (at >> 3).ravel(), int(starts[-1]) + 3
    raw = np.zeros(total, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        raw += np.bincount(first + k, (word >> shift) & 255, total).astype(np.int64)  # bits are apart: a sum is an or
    raw[starts[1:] - 1] |= (1 << (size * 8 - bits)) - 1  # the rest of the last byte is ones
    raw = raw[: starts[-1]].astype(np.uint8)
    data, head = raw.tobytes(), header(width, height)
    return [head + data[a:b].replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)] if frames else []


@dataclass(frozen=True)
class Component:
    id: int
    across: int
    down: int
    quant: tuple[int, ...]
    dc: tuple
    ac: tuple


@dataclass(frozen=True)
class Frame:
    width: int
    height: int
    components: tuple[Component, ...]
    restart: int
    scan: int  # where its data begins


def _huffman(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, at = {}, 0, 16
    for n, count in enumerate(body[:16], 1):
        for _ in range(count):
            out[n, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse(data: bytes) -> Frame:
    """The header of a baseline frame."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    quants, tables, shape, parts, restart, at = {}, {}, None, [], 0, 2
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        mark, n = data[at + 1], unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                body = body[129 if wide else 65 :]
        elif mark == 0xC4:
            while body:
                used = 17 + sum(body[1:17])
                tables[body[0]] = tuple(sorted(_huffman(body[1:used]).items()))
                body = body[used:]
        elif mark in (0xC0, 0xC1):
            shape = unpack(">HH", body[1:5])
            parts = [tuple(body[6 + 3 * k : 9 + 3 * k]) for k in range(body[5])]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only baseline frames are read")
        elif mark == 0xDD:
            restart = unpack(">H", body)[0]
        elif mark == 0xDA:
            uses = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
            made = tuple(Component(i, s >> 4, s & 15, quants[q], tables[uses[i] >> 4], tables[0x10 | uses[i] & 15]) for i, s, q in parts)
            return Frame(shape[1], shape[0], made, restart, at)


_BASIS = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan ends too early")
        return self.value >> self.left & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        x = self.take(size) if size else 0
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _segments(data: bytes) -> list[bytes]:
    """Scan data between restart marks, without stuffed zeros; ends at the first other mark."""
    out, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            out.append(data[begin:])
            break
        mark = data[at + 1]
        if mark == 0:
            at += 2
        elif 0xD0 <= mark <= 0xD7:
            out.append(data[begin:at])
            begin = at = at + 2
        else:
            out.append(data[begin:at])
            break
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def decode_one(data: bytes) -> np.ndarray:
    """The luma of one baseline frame, height x width, uint8."""
    f = parse(data)
    wide, high = max(c.across for c in f.components), max(c.down for c in f.components)
    if len(f.components) == 1:
        wide = high = 1
    columns, rows = -(-f.width // (8 * wide)), -(-f.height // (8 * high))
    luma = f.components[0]
    across, down = (luma.across, luma.down) if len(f.components) > 1 else (1, 1)
    blocks = np.zeros((rows * down, columns * across, 64))
    tables = [(dict(c.dc), dict(c.ac)) for c in f.components]
    parts = iter(_segments(data[f.scan :]))
    for unit in range(rows * columns):
        if unit == 0 or f.restart and unit % f.restart == 0:
            bits, before = _Bits(next(parts)), [0] * len(f.components)
        for k, c in enumerate(f.components):
            dc, ac = tables[k]
            for v in range(c.down if len(f.components) > 1 else 1):
                for h in range(c.across if len(f.components) > 1 else 1):
                    block = np.zeros(64)
                    before[k] += bits.number(bits.symbol(dc))
                    block[0] = before[k]
                    at = 1
                    while at < 64:
                        run, size = divmod(bits.symbol(ac), 16)
                        if not size:
                            if run != 15:
                                break
                            at += 16
                            continue
                        at += run
                        block[at] = bits.number(size)
                        at += 1
                    if not k:
                        blocks[unit // columns * down + v, unit % columns * across + h] = block
    plain = np.zeros_like(blocks)
    plain[:, :, ZIGZAG] = blocks * np.array(luma.quant)
    pixels = np.einsum("ux,ijuv,vy->ixjy", _BASIS, plain.reshape(*plain.shape[:2], 8, 8), _BASIS)
    pixels = pixels.reshape(plain.shape[0] * 8, -1)[: f.height, : f.width]
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)


@lru_cache(maxsize=4)
def _even_blocks(dc: tuple, ac: tuple) -> np.ndarray:
    """By the next 16 bits: (difference << 8) + bits used, for a DC code with its extra bits and an end of block at once; else 0."""
    ends = [k for k, symbol in ac if symbol == 0]
    out = np.zeros(1 << 16, np.int32)
    for (n, code), size in dc:
        for m, end in ends:
            used = n + size + m
            if used > 16:
                continue
            for extra in range(1 << size):
                change = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                low = ((code << size | extra) << m | end) << (16 - used)
                out[low : low + (1 << (16 - used))] = change * 256 + used
    return out


_parsed: dict[bytes, Frame] = {}


def decode(frames: list[bytes]) -> list[np.ndarray]:
    """Means of the 8x8 blocks of each frame's luma, row by row, uint8."""
    out: list[np.ndarray | None] = [None] * len(frames)
    alike: dict[bytes, list[int]] = {}
    for k, data in enumerate(frames):
        for head in _parsed:
            if data.startswith(head):
                break
        else:
            frame = parse(data)
            head = data[: frame.scan]
            if len(_parsed) > 16:
                _parsed.clear()
            _parsed[head] = frame
        alike.setdefault(head, []).append(k)
    for head, which in alike.items():
        f = _parsed[head]
        if len(f.components) == 1 and not f.restart:
            which = _in_step(f, which, frames, out)
        for k in which:
            pixels = decode_one(frames[k]).astype(float)
            pixels = np.pad(pixels, ((0, -len(pixels) % 8), (0, -pixels.shape[1] % 8)), "edge")
            out[k] = np.rint(pixels.reshape(len(pixels) // 8, 8, -1, 8).mean((1, 3))).astype(np.uint8).ravel()
    return out


def _in_step(f: Frame, which: list[int], frames: list[bytes], out: list) -> list[int]:
    """Decodes the frames that hold even blocks only; returns the others."""
    scans = [frames[k][f.scan : -2].replace(b"\xff\x00", b"\xff") for k in which]
    raw = np.frombuffer(b"".join(scans) + b"\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    ends = np.cumsum([len(s) for s in scans])
    at = (ends - [len(s) for s in scans]) * 8
    c = f.components[0]
    table, blocks = _even_blocks(c.dc, c.ac), -(-f.width // 8) * -(-f.height // 8)
    level, good = np.zeros(len(which), np.int64), np.ones(len(which), bool)
    made = np.empty((blocks, len(which)), np.int32)
    for k in range(blocks):
        byte = np.minimum(at >> 3, len(window) - 1)
        found = table[(window[byte] >> (8 - (at & 7)).astype(np.uint32)) & np.uint32(0xFFFF)]
        used = found & 255
        good &= used > 0
        level += found >> 8
        at += used
        made[k] = level
    good &= at <= ends * 8
    means = np.clip(np.rint(made * (c.quant[0] / 8)) + 128, 0, 255).astype(np.uint8).T
    for i, k in enumerate(which):
        if good[i]:
            out[k] = np.ascontiguousarray(means[i])
    return [k for i, k in enumerate(which) if not good[i]]

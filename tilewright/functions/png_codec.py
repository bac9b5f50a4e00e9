"""Bytes of PNG files: rows filtered and deflated band by band, and back, with zlib and numpy inside a task.

A band is deflated on its own and ends on a whole byte (full flush), so bands made in different tasks
can be laid end to end as one zlib stream; only its check sum spans them, and check sums of parts
combine by arithmetic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: The signature, colour types by number of channels, channels by colour type, bit depths by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOUR_OF = {1: 0, 2: 4, 3: 2, 4: 6}
CHANNELS_OF = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS_OF = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: First column and row, steps of columns and rows, of the seven passes of an interlaced image.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
_ADLER = 65521
#: An empty last block of deflate, and the two bytes before a zlib stream.
_LAST_BLOCK, _ZLIB_HEAD = b"\x03\x00", b"\x78\x9c"
_READ = 1 << 16


class BadImage(ValueError):
    """The bytes are no whole PNG."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


# --- writing ---------------------------------------------------------------------------------------


def _near(rows: np.ndarray, channels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte the one to the left, the one above and the one above left; 0 beyond the band."""
    left, above, corner = (np.zeros_like(rows) for _ in range(3))
    left[:, channels:] = rows[:, :-channels]
    above[1:] = rows[:-1]
    corner[1:, channels:] = rows[:-1, :-channels]
    return left, above, corner


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    a, b, c = (v.astype(np.int16) for v in (a, b, c))
    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def encode_band(pixels: np.ndarray, top: bool) -> tuple[bytes, int, int]:
    """A band of pixels (rows, width, channels): deflated bytes, check sum and number of the bytes deflated.

    Every row takes the filter with the least sum of absolute differences. The first row of a band
    other than the top one does not know the row above it and takes a filter that needs none.
    """
    h, w, channels = pixels.shape
    rows = np.ascontiguousarray(pixels, np.uint8).reshape(h, w * channels)
    left, above, corner = _near(rows, channels)
    mean = ((left.astype(np.uint16) + above) // 2).astype(np.uint8)
    tried = np.stack([rows, rows - left, rows - above, rows - mean, rows - _paeth(left, above, corner)])
    sums = np.minimum(tried, -tried).astype(np.int64).sum(2)
    if not top:
        sums[2:, 0] = np.iinfo(np.int64).max
    best = sums.argmin(0)
    raw = np.concatenate([best[:, None].astype(np.uint8), tried[best, np.arange(h)]], 1).tobytes()
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    return squeeze.compress(raw) + squeeze.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def joined_sum(first: int, second: int, second_bytes: int) -> int:
    """The check sum of two parts laid end to end, from theirs and the length of the second."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (a1 + a2 - 1) % _ADLER | (b1 + b2 + second_bytes * (a1 - 1)) % _ADLER << 16


def file_head(width: int, height: int, channels: int) -> bytes:
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOUR_OF[channels], 0, 0, 0))


def band_chunk(data: bytes, first: bool) -> bytes:
    return chunk(b"IDAT", (_ZLIB_HEAD if first else b"") + data)


def file_end(total: int) -> bytes:
    """total: the check sum of all bands."""
    return chunk(b"IDAT", _LAST_BLOCK + struct.pack(">I", total)) + chunk(b"IEND", b"")


# --- reading ---------------------------------------------------------------------------------------


@dataclass
class Header:
    width: int
    height: int
    depth: int
    colour: int
    interlaced: bool
    palette: np.ndarray | None = None  # (entries, 4)
    clear: tuple[int, ...] | None = None  # the one colour that is transparent

    @property
    def channels(self) -> int:
        return CHANNELS_OF[self.colour]

    def passes(self) -> list[tuple[int, int, int, int, int, int]]:
        """first column and row, steps, width and height of each pass that has pixels."""
        every = PASSES if self.interlaced else ((0, 0, 1, 1),)
        sized = [(x, y, dx, dy, -(-(self.width - x) // dx), -(-(self.height - y) // dy)) for x, y, dx, dy in every]
        return [p for p in sized if p[4] > 0 and p[5] > 0]

    def row_bytes(self, width: int) -> int:
        return -(-width * self.channels * self.depth // 8)

    def raw_bytes(self) -> int:
        return sum(h * (1 + self.row_bytes(w)) for *_, w, h in self.passes())


def chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Chunks up to IEND; a cut or damaged one raises."""
    if content[:8] != SIGNATURE:
        raise BadImage("signature")
    at = 8
    while True:
        if at + 12 > len(content):
            raise BadImage("cut")
        size, kind = struct.unpack_from(">I4s", content, at)
        if at + 12 + size > len(content):
            raise BadImage("cut")
        data = content[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", content, at + 8 + size)[0]:
            raise BadImage("check sum")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def header_of(content: bytes) -> tuple[Header, list[bytes]]:
    """The header with palette and transparency, and the pieces of the pixel stream."""
    head: Header | None = None
    pieces: list[bytes] = []
    for kind, data in chunks(content):
        if head is None:
            if kind != b"IHDR" or len(data) != 13:
                raise BadImage("header")
            w, h, depth, colour, deflate, filters, interlace = struct.unpack(">IIBBBBB", data)
            if not (0 < w < 1 << 31 and 0 < h < 1 << 31) or depth not in DEPTHS_OF.get(colour, ()) or deflate or filters or interlace > 1:
                raise BadImage("header")
            head = Header(w, h, depth, colour, bool(interlace))
        elif kind == b"PLTE":
            if not data or len(data) % 3 or len(data) > 768:
                raise BadImage("palette")
            head.palette = np.concatenate([np.frombuffer(data, np.uint8).reshape(-1, 3), np.full((len(data) // 3, 1), 255, np.uint8)], 1)
        elif kind == b"tRNS" and head.colour == 3 and head.palette is not None:
            n = min(len(data), len(head.palette))
            head.palette[:n, 3] = np.frombuffer(data[:n], np.uint8)
        elif kind == b"tRNS" and head.colour in (0, 2):
            if len(data) != 2 * head.channels:
                raise BadImage("transparency")
            head.clear = struct.unpack(f">{head.channels}H", data)
        elif kind == b"IDAT":
            pieces.append(data)
        elif kind[0] < 97 and kind != b"IEND":
            raise BadImage("unknown critical chunk")
    if head is None or not pieces or head.colour == 3 and head.palette is None:
        raise BadImage("parts missing")
    return head, pieces


def inflated(pieces: list[bytes], limit: int) -> Iterator[bytes]:
    """The stream in small parts, at most limit bytes: a bomb is never blown up. A cut stream raises."""
    grow = zlib.decompressobj()
    left = limit
    for piece in pieces:
        while piece and left:
            try:
                part = grow.decompress(piece, min(left, _READ))
            except zlib.error as error:
                raise BadImage(str(error)) from None
            piece = grow.unconsumed_tail
            left -= len(part)
            if part:
                yield part
    if left:
        raise BadImage("cut")


def has_alpha(content: bytes) -> bool:
    """Whether a whole file's kind of pixels has transparency, whatever the pixels are."""
    head, _ = header_of(content)
    return head.colour in (4, 6) or head.clear is not None or head.palette is not None and bool((head.palette[:, 3] < 255).any())


def check(content: bytes, max_pixels: int) -> str | None:
    """The import ladder's error of a PNG, or null: the header's size first, then a whole decode without its pixels."""
    try:
        head, pieces = header_of(content)
        if head.width * head.height > max_pixels:
            return "file_too_large"
        for _, row, place in _rows(head, pieces, whole=head.colour == 3):
            if row is not None:
                _rgba(head, row, place[-1])  # an index beyond the palette
    except BadImage:
        return "invalid_image"
    return None


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes from what its filter left (fixed values: the five kinds)."""
    if kind == 0:
        return row
    if kind == 1:
        padded = np.zeros(-(-len(row) // step) * step, np.uint8)
        padded[: len(row)] = row
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
    if kind == 2:
        return row + above
    out = bytearray(step) + row.tobytes()
    up = bytes(step) + above.tobytes()
    if kind == 3:
        for i in range(step, len(out)):
            out[i] = out[i] + (out[i - step] + up[i] >> 1) & 255
    elif kind == 4:
        for i in range(step, len(out)):
            a, b, c = out[i - step], up[i], up[i - step]
            da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            out[i] = out[i] + (a if da <= db and da <= dc else b if db <= dc else c) & 255
    else:
        raise BadImage("filter")
    return np.frombuffer(bytes(out[step:]), np.uint8)


def _rows(head: Header, pieces: list[bytes], whole: bool = False) -> Iterator[tuple[int, np.ndarray | None, tuple[int, int, int, int, int]]]:
    """(row, its bytes, (first column, first row, step of columns, of rows, width)) of every pass. Bytes are made only if whole; filters are always checked."""
    stream = inflated(pieces, head.raw_bytes())
    held = bytearray()
    step = max(1, head.channels * head.depth // 8)
    for x, y, dx, dy, w, h in head.passes():
        n = head.row_bytes(w)
        above = np.zeros(n, np.uint8)
        for k in range(h):
            while len(held) <= n:
                held += next(stream, b"") or _cut()
            kind, data = held[0], bytes(held[1 : n + 1])
            del held[: n + 1]
            if kind > 4:
                raise BadImage("filter")
            if whole:
                above = _unfiltered(kind, np.frombuffer(data, np.uint8), above, step)
            yield k, above if whole else None, (x, y, dx, dy, w)


def _cut() -> bytes:
    raise BadImage("cut")


def _rgba(head: Header, row: np.ndarray, w: int) -> np.ndarray:
    """A row's pixels as (w, 4) bytes: 16 bits are rounded to 8, fewer are stretched, grey and palette become colour."""
    n = w * head.channels
    if head.depth == 16:
        values = row.view(">u2")[:n].astype(np.int64)
    elif head.depth == 8:
        values = row[:n].astype(np.int64)
    else:
        bits = np.unpackbits(row).reshape(-1, head.depth)
        values = (bits @ (1 << np.arange(head.depth)[::-1]))[:n].astype(np.int64)
    values = values.reshape(w, head.channels)
    if head.colour == 3:
        if values.max() >= len(head.palette):
            raise BadImage("palette index")
        return head.palette[values[:, 0]]
    alpha = np.full((w, 1), 255, np.int64)
    if head.clear is not None:
        alpha[(values == np.array(head.clear)).all(1)] = 0
    small = (values + 128) // 257 if head.depth == 16 else values * 255 // ((1 << head.depth) - 1)
    if head.colour in (4, 6):
        small, alpha = small[:, :-1], small[:, -1:]
    return np.concatenate([np.repeat(small, 3, 1) if small.shape[1] == 1 else small, alpha], 1).astype(np.uint8)


def decode(content: bytes) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(columns, row, pixels (n, 4)) of every row of every pass; of an interlaced image a row comes in parts."""
    head, pieces = header_of(content)
    for k, row, (x, y, dx, dy, w) in _rows(head, pieces, whole=True):
        yield x + dx * np.arange(w), y + dy * k, _rgba(head, row, w)

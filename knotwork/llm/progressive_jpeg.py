"""Progressive JPEG (SOF2) columns: a decoder in numpy, and a writer that keeps a payload in the coefficients.

The decoder gathers all scans, of spectral selection and successive approximation, in coefficient arrays, then transforms the blocks back, repeats chroma samples up to full resolution and makes RGB. Scans whose layout is regular are read as arrays: refinements of DC, runs of finished blocks in refinements of AC, and first AC scans whose table has a single code, so that every coefficient has the same width. All others are read code by code.

JPEG's samples come back inexact, its quantised coefficients exactly. A payload therefore goes into the coefficients, one byte each, in units of 6 blocks (4 Y, Cb, Cr; chroma at half the width and height). DC holds the byte itself. AC holds the number whose JPEG magnitude category is 8 and whose appended bits are the byte: the byte itself from 128 on, the byte less 255 below. A comment segment tells the payload's length; the last unit is filled with 255.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from knotwork.llm.bpe import slices
from knotwork.llm.common import refuse, table, whole

#: Fixed by the JPEG standard: the zigzag order of a block's coefficients is the walk along its diagonals, alternately up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
PAD = 576
UNIT = 384
_TALLEST = 4095  # units of 16 lines in a JPEG image's 65,535 lines


def _inverse_transform() -> np.ndarray:
    """Coefficients in zigzag order to samples in rows: the two-dimensional inverse cosine transform as one matrix."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.kron(one, one)[:, ZIGZAG].T.copy()


INVERSE = _inverse_transform()


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks of the component itself
    tall: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # padded to whole units
    orders: dict[bool, np.ndarray] = field(default_factory=dict)
    dc_table: int = 0
    ac_table: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""

    def rgb(self) -> np.ndarray:
        """(height, width, 3) uint8; one component gives three alike."""
        planes = []
        most_h, most_v = max(c.h for c in self.components), max(c.v for c in self.components)
        for c in self.components:
            tall, wide = c.blocks.shape[:2]
            samples = (c.blocks.reshape(-1, 64) * self.quant[c.quant]).astype(np.float64) @ INVERSE
            plane = samples.reshape(tall, wide, 8, 8).transpose(0, 2, 1, 3).reshape(tall * 8, wide * 8).astype(np.float32) + np.float32(128)
            np.rint(plane, out=plane)
            np.clip(plane, 0, 255, out=plane)
            if (c.v, c.h) != (most_v, most_h):
                plane = np.repeat(np.repeat(plane, most_v // c.v, 0), most_h // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
        y, cb, cr = planes[0], planes[1] - np.float32(128), planes[2] - np.float32(128)
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, p in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[:, :, i] = np.clip(np.rint(p), 0, 255)
        return out


class Huffman:
    """One table: codes by length. window: for each 16 bits that may come next, (length of the code, symbol)."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.codes: dict[int, tuple[int, int]] = {}
        self.window = [(0, 0)] * 65536
        code = at = 0
        for n, count in enumerate(lengths, 1):
            for _ in range(count):
                self.codes[symbols[at]] = (code, n)
                first = code << (16 - n)
                self.window[first : first + (1 << (16 - n))] = [(n, symbols[at])] * (1 << (16 - n))
                code, at = code + 1, at + 1
            code <<= 1
        self.only = next(iter(self.codes.items())) if len(self.codes) == 1 else None


@functools.lru_cache(maxsize=256)
def _huffman(lengths: bytes, symbols: bytes) -> Huffman:
    return Huffman(lengths, symbols)


class Bits:
    """A stretch of entropy-coded bytes without stuffing; reads past its end give ones."""

    def __init__(self, raw: bytes):
        self.raw = raw.replace(b"\xff\x00", b"\xff") if b"\xff" in raw else raw
        self.padded = self.raw + b"\xff\xff\xff\xff"
        self.at = 0

    def peek16(self) -> int:
        i = self.at >> 3
        return int.from_bytes(self.padded[i : i + 3].ljust(3, b"\xff"), "big") >> (8 - (self.at & 7)) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        v = self.peek16() >> (16 - n)
        self.at += n
        return v

    def code(self, table: Huffman) -> int:
        n, symbol = table.window[self.peek16()]
        if not n:
            raise ValueError("no such code in the scan's table")
        self.at += n
        return symbol

    def array(self, n: int) -> np.ndarray:
        """The next n bits as an array of 0 and 1."""
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        raw = np.frombuffer(self.raw[first:last], np.uint8)
        bits = np.unpackbits(raw)[self.at & 7 :]
        if len(bits) < n:
            raise ValueError("the scan ends early")
        self.at += n
        return bits[:n]

    def octets(self, n: int) -> np.ndarray | None:
        """The next n bytes, if the stream stands at a byte's start."""
        if self.at & 7:
            return None
        first = self.at >> 3
        if first + n > len(self.raw):
            raise ValueError("the scan ends early")
        self.at += 8 * n
        return np.frombuffer(self.raw, np.uint8, n, first)


def _extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def decode(data: bytes) -> Image:
    """Reads a progressive JPEG into its coefficients; Image.rgb() makes the picture."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, image, tables, quant, restart, comment = 2, None, {}, {}, 0, b""
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 65 + 64 * wide
                quant[body[0] & 15] = np.frombuffer(body[1:n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[n:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(bytes(body[1:17]), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = body[0] << 8 | body[1]
        elif marker == 0xFE:
            comment = bytes(body)
        elif marker == 0xC2:
            image = _frame(body)
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("the JPEG is not progressive")
        elif marker == 0xDA:
            found = _NEXT.search(data, at)
            end = found.start() if found else len(data)
            if image is None:
                raise ValueError("a scan before the frame")
            _scan(image, body, data[at:end], tables, restart)
            at = end
    if image is None:
        raise ValueError("no frame")
    image.quant, image.comment = quant, comment
    return image


def _frame(body: bytes) -> Image:
    if body[0] != 8:
        raise ValueError("samples of 8 bits only")
    height, width, n = body[1] << 8 | body[2], body[3] << 8 | body[4], body[5]
    parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    for c in parts:
        c.wide, c.tall = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
        c.blocks = np.zeros((down * c.v, across * c.h, 64), np.int32)
    return Image(width, height, parts, {})


def _scan(image: Image, body: bytes, raw: bytes, tables: dict[int, Huffman], restart: int) -> None:
    n = body[0]
    parts = []
    for i in range(n):
        c = next(x for x in image.components if x.id == body[1 + 2 * i])
        c.dc_table, c.ac_table = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
        parts.append(c)
    start, end, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    order = [(c, _order(image, c, n == 1)) for c in parts]
    units = len(order[0][1])
    pieces = _RESTART.split(raw) if restart else [raw]
    step = restart or units
    for k, piece in enumerate(pieces):
        if k * step >= units:
            break
        bits = Bits(piece)
        here = [(c, rows[k * step : (k + 1) * step]) for c, rows in order]
        if start == 0:
            (_dc_refine if high else _dc_first)(bits, here, low, tables)
        else:
            c, rows = here[0]
            flat = c.blocks.reshape(-1, 64)
            # All blocks of the component in their own order, as most often: then a view of them serves as well as a list.
            which = slice(None) if len(rows) == len(flat) else rows[:, 0]
            (_ac_refine if high else _ac_first)(bits, flat, which, len(rows), start, end, low, tables[16 + c.ac_table])


def _order(image: Image, c: Component, alone: bool) -> np.ndarray:
    """The component's blocks in the order of a scan, as rows of the flat coefficients: a line for each unit."""
    if alone not in c.orders:
        tall, wide = c.blocks.shape[:2]
        grid = np.arange(tall * wide)
        c.orders[alone] = grid.reshape(tall, wide)[: c.tall, : c.wide].reshape(-1, 1) if alone else grid.reshape(tall // c.v, c.v, wide // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)
    return c.orders[alone]


def _dc_first(bits: Bits, here: list, low: int, tables: dict[int, Huffman]) -> None:
    """All differences in the order of the scan, then running sums for each component."""
    kinds = [tables[c.dc_table].window for c, rows in here for _ in range(rows.shape[1])]
    units = len(here[0][1])
    raw = np.frombuffer(bits.padded, np.uint8).astype(np.int64)
    words = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
    at, found, last = bits.at, [], len(words) - 1
    for _ in range(units):
        for window in kinds:
            i = at >> 3
            if i > last:
                raise ValueError("the scan ends early")
            n, size = window[words[i] >> (16 - (at & 7)) & 0xFFFF]
            if not n:
                raise ValueError("no such code in the scan's table")
            at += n
            if size:
                i = at >> 3
                if i > last:
                    raise ValueError("the scan ends early")
                v = words[i] >> (32 - size - (at & 7)) & ((1 << size) - 1)
                at += size
                found.append(v if v >> (size - 1) else v - (1 << size) + 1)
            else:
                found.append(0)
    bits.at = at
    diffs, first = np.array(found, np.int64).reshape(units, len(kinds)), 0
    for c, rows in here:
        k = rows.shape[1]
        c.blocks.reshape(-1, 64)[rows.ravel(), 0] = np.cumsum(diffs[:, first : first + k].ravel()) << low
        first += k


def _dc_refine(bits: Bits, here: list, low: int, tables: dict[int, Huffman]) -> None:
    units, each = len(here[0][1]), sum(rows.shape[1] for _, rows in here)
    got, first = bits.array(units * each).reshape(units, each).astype(np.int32) << low, 0
    for c, rows in here:
        k = rows.shape[1]
        c.blocks.reshape(-1, 64)[rows.ravel(), 0] |= got[:, first : first + k].ravel()
        first += k


def _ac_first(bits: Bits, flat: np.ndarray, which: slice | np.ndarray, count: int, start: int, end: int, low: int, table: Huffman) -> None:
    if table.only and table.only[0] >> 4 == 0 and table.only[0] & 15:
        size, width = table.only[0] & 15, (table.only[0] & 15) + table.only[1][1]
        n = count * (end - start + 1)
        if width == 8 and (octets := bits.octets(n)) is not None:
            v = _extended(size, low)[octets]
        else:
            v = _extended(size, low, 16)[bits.array(n * width).reshape(n, width)[:, width - size :] @ (1 << np.arange(size - 1, -1, -1)).astype(np.int32)]
        flat[which, start : end + 1] = v.reshape(count, -1)
        return
    left = 0
    for row in np.arange(len(flat))[which]:
        if left:
            left -= 1
            continue
        k = start
        while k <= end:
            symbol = bits.code(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                flat[row, k] = _extend(bits.take(size), size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                left = (1 << run) + bits.take(run) - 1
                break


@functools.lru_cache(maxsize=64)
def _extended(size: int, low: int, width: int = 8) -> np.ndarray:
    """What the last `size` of `width` bits stand for, by those bits."""
    v = np.arange(1 << width, dtype=np.int32) & ((1 << size) - 1)
    return np.where(v >> (size - 1), v, v - (1 << size) + 1) * (1 << low)


def _ac_refine(bits: Bits, flat: np.ndarray, which: slice | np.ndarray, count: int, start: int, end: int, low: int, table: Huffman) -> None:
    bit, i = 1 << low, 0
    rows = None if isinstance(which, slice) else which

    def correct(first: int, last: int, k: int) -> None:
        """The correction bits of all coefficients from k on that aren't 0 in these blocks of the scan."""
        at = slice(first, last) if rows is None else rows[first:last]
        band = flat[at, k : end + 1]
        there = band != 0
        n = int(np.count_nonzero(there))
        got = bits.array(n).astype(np.int32)
        if n == band.size:
            flat[at, k : end + 1] = band + np.where(band > 0, bit, -bit) * got.reshape(band.shape)
        else:
            band[there] += np.where(band[there] > 0, bit, -bit) * got
            flat[at, k : end + 1] = band

    while i < count:
        row, k = i if rows is None else rows[i], start
        while k <= end:
            symbol = bits.code(table)
            run, size = symbol >> 4, symbol & 15
            if not size and run < 15:
                more = (1 << run) + bits.take(run)  # this block's rest and the blocks after it
                if k > start:
                    correct(i, i + 1, k)
                    correct(i + 1, min(i + more, count), start)
                else:
                    correct(i, min(i + more, count), start)
                i += more - 1
                break
            new = (bit if bits.take(1) else -bit) if size else 0
            while k <= end:
                if flat[row, k]:
                    if bits.take(1):
                        flat[row, k] += bit if flat[row, k] > 0 else -bit
                elif run:
                    run -= 1
                else:
                    if new:
                        flat[row, k] = new
                    k += 1
                    break
                k += 1
        i += 1


# ---- the writer -------------------------------------------------------------------------------------------------------

_DC_LENGTHS, _DC_SYMBOLS = bytes([0, 0, 0, 12] + [0] * 12), bytes(range(12))  # twelve categories, 4 bits each
_AC_LENGTHS, _AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0x07])  # one bit and seven more make a byte of each coefficient
_RUN_LENGTHS, _RUN_SYMBOLS = bytes([0, 0, 0, 15] + [0] * 12), bytes(r << 4 for r in range(15))
#: The appended lowest bit of a coefficient's magnitude, by byte.
_LAST_BIT = np.array([b & 1 if b >= 128 else 1 - (b & 1) for b in range(256)], np.uint8)
_TO_AC = np.array([b if b >= 128 else b - 255 for b in range(256)], np.int32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_TABLES = (
    _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC4, bytes([0x00]) + _DC_LENGTHS + _DC_SYMBOLS + bytes([0x10]) + _AC_LENGTHS + _AC_SYMBOLS + bytes([0x11]) + _RUN_LENGTHS + _RUN_SYMBOLS)
)


def _dc_bits() -> list[str]:
    out = []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        out.append(f"{size:04b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else ""))
    return out


_DC_BITS = _dc_bits()


def _sos(parts: list[tuple[int, int]], start: int, end: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(parts)]) + b"".join(bytes(p) for p in parts) + bytes([start, end, high << 4 | low]))


def _stuffed(raw: bytes) -> bytes:
    return raw.replace(b"\xff", b"\xff\x00") if b"\xff" in raw else raw


def _packed(bits: np.ndarray) -> bytes:
    """Bits to bytes, the last filled with ones."""
    over = -len(bits) % 8
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(over, np.uint8)]) if over else bits).tobytes())


_SCAN_DC, _SCAN_DC_LAST = _sos([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1), _sos([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0)
_SCANS_AC = [(0, 1, 5, _sos([(1, 0)], 1, 5, 0, 1)), (0, 6, 63, _sos([(1, 0)], 6, 63, 0, 1)), (1, 1, 63, _sos([(2, 0)], 1, 63, 0, 1)), (2, 1, 63, _sos([(3, 0)], 1, 63, 0, 1))]
_SCANS_LAST = [(0, _sos([(1, 1)], 1, 63, 1, 0)), (1, _sos([(2, 1)], 1, 63, 1, 0)), (2, _sos([(3, 1)], 1, 63, 1, 0))]


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients hold the payload."""
    units = max(1, -(-len(payload) // UNIT))
    across = -(-units // _TALLEST)
    down = -(-units // across)
    if across * 16 > 65535:
        raise ValueError("a JPEG image has no room for this payload")
    cells = np.frombuffer(payload.ljust(across * down * UNIT, b"\xff"), np.uint8).reshape(down, across, 6, 64)
    luma = cells[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) if across > 1 else cells[:, :, :4].reshape(-1, 64)
    planes = [luma, cells[:, :, 4].reshape(-1, 64), cells[:, :, 5].reshape(-1, 64)]
    size = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, b"payload %d" % len(payload)), _TABLES, _segment(0xC2, size), _SCAN_DC]
    dc = (cells[:, :, :, 0].reshape(-1, 6) >> 1).astype(np.int64)
    diffs = np.empty_like(dc)
    y = dc[:, :4].ravel()
    diffs[:, :4] = np.diff(y, prepend=0).reshape(-1, 4)
    diffs[:, 4:] = np.diff(dc[:, 4:], axis=0, prepend=0)
    text = "".join(map(_DC_BITS.__getitem__, (diffs.ravel() + 255).tolist()))
    text += "1" * (-len(text) % 8)
    out.append(_stuffed(int(text, 2).to_bytes(len(text) // 8, "big")))
    for plane, first, last, head in _SCANS_AC:
        out += [head, (planes[plane][:, first : last + 1] >> 1).tobytes()]
    out += [_SCAN_DC_LAST, _packed(cells[:, :, :, 0].ravel() & 1)]
    for plane, head in _SCANS_LAST:
        low, parts = _LAST_BIT[planes[plane][:, 1:]], []
        for at in range(0, len(low), 32767):
            run = min(32767, len(low) - at)
            n = run.bit_length() - 1
            lead = f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")
            parts += [np.frombuffer(lead.encode(), np.uint8) - 48, low[at : at + 32767].ravel()]
        out += [head, _packed(np.concatenate(parts))]
    out.append(b"\xff\xd9")
    return b"".join(out)


def payload_of(image: Image) -> bytes:
    """The payload that encode() put into the coefficients."""
    if not image.comment.startswith(b"payload "):
        raise ValueError("this JPEG holds no payload")
    n = int(image.comment[8:])
    down, across = image.components[1].blocks.shape[:2]
    cells = np.empty((down, across, 6, 64), np.int32)
    cells[:, :, :4] = image.components[0].blocks.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    cells[:, :, 4], cells[:, :, 5] = image.components[1].blocks, image.components[2].blocks
    cells[cells < 0] += 255
    return cells.astype(np.uint8).tobytes()[:n]


def padded(raw: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of PAD."""
    return raw.ljust(max(1, -(-len(raw) // PAD)) * PAD, b"\xff")


def feature(rgb: np.ndarray) -> str:
    """Means and deviations of R, G and B, an eight-step histogram of brightness, and the mean step between lines."""
    flat = rgb.reshape(-1, 3)
    n = len(flat)
    total, squares = flat.sum(0, dtype=np.int64), np.einsum("ij,ij->j", flat, flat, dtype=np.int64)
    bright = (flat[:, 0].astype(np.uint16) + flat[:, 1] + flat[:, 2]) // 96
    steps = int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=0)).sum(dtype=np.int64))
    means = [t / n for t in total.tolist()]
    spreads = [max(0.0, s / n - m * m) ** 0.5 for s, m in zip(squares.tolist(), means)]
    return ",".join([f"{rgb.shape[0]}x{rgb.shape[1]}", *(f"{v:.3f}" for v in means + spreads), *map(str, np.bincount(np.minimum(bright, 7), minlength=8).tolist()), f"{steps / n:.3f}"])


# ---- columns ----------------------------------------------------------------------------------------------------------


def with_media(df: DataFrame, payload: str, to: str = "media") -> DataFrame:
    """df with one more binary column: the JPEG that holds the payload; null gives null."""
    refuse(df, to)
    names = df.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, payload):
                media = pa.array([None if p is None else encode(p) for p in part.column(names.index(payload)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, media], names=[*names, to])

    return df.mapInArrow(run, f"{df._jdf.schema().toDDL()}, `{to}` binary")


def with_tensor(df: DataFrame, media: str = "media", to: str = "rgb") -> DataFrame:
    """df with one more column, struct<height, width, channels, data>: the full-resolution RGB tensor of a progressive JPEG, data in rows. Null, and bytes that are no progressive JPEG, give null."""
    refuse(df, to)
    names = df.columns
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def tensor(raw: bytes | None):
        if raw is None:
            return None
        try:
            rgb = decode(raw).rgb()
        except (ValueError, KeyError, IndexError, StopIteration):
            return None
        return {"height": rgb.shape[0], "width": rgb.shape[1], "channels": 3, "data": rgb.tobytes()}

    def run(batches):
        for batch in batches:
            for part in slices(batch, media, 1 << 21):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([tensor(x) for x in part.column(names.index(media)).to_pylist()], kind)], names=[*names, to])

    return df.mapInArrow(run, f"{df._jdf.schema().toDDL()}, `{to}` struct<height:int,width:int,channels:int,data:binary>")


def digests(docs: DataFrame) -> DataFrame:
    """Each whole text as a payload in a progressive JPEG, read back from the stored bytes.

    Null text is empty, which is one unit of PAD. Repeated rows and equal texts give equal values. One pass without a shuffle; a task holds one document's image at a time. Columns other than doc_id and text are not looked at."""
    out = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def row(text: str):
        raw = text.encode("utf-8", "surrogatepass")
        media = encode(padded(raw))
        image = decode(media)
        back = payload_of(image)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(image.rgb())

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                columns = list(zip(*map(row, part.column(1).to_pylist()))) or [()] * len(out)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, out))], names=["doc_id", *out.names])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", whole().alias("text")).mapInArrow(run, kinds)


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

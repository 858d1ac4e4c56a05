"""Whether an image decodes: PNG data is inflated and counted, JPEG scans are walked code by code.

Both run in bounded memory at any size. Nothing is rendered: a check ends where every row or block that the
header promises has been met with valid codes, and nothing is left over.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache
from typing import BinaryIO

import numpy as np

BLOCK = 1 << 20
FEED = 1 << 18


def _at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


# PNG

# Samples a pixel and allowed bit depths of each colour type.
PNG_COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}
# First column, first row, column step and row step of the seven passes of an interlaced image.
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class _Rows:
    """Counts inflated bytes into rows and looks at the filter byte that begins each."""

    def __init__(self, head: bytes) -> None:
        wide, high, depth, colour, packing, filters, interlaced = struct.unpack(">IIBBBBB", head)
        samples, depths = PNG_COLOURS.get(colour, (0, ()))
        if not wide or not high or depth not in depths or packing or filters or interlaced > 1:
            raise ValueError("bad PNG header")
        row = lambda w: 1 + (w * samples * depth + 7) // 8
        self.left = [(high, row(wide))]
        if interlaced:
            sizes = [(-(-(high - y) // dy), -(-(wide - x) // dx)) for x, y, dx, dy in PNG_PASSES]
            self.left = [(h, row(w)) for h, w in sizes if h > 0 and w > 0]
        self.left.reverse()
        self.inside = 0  # bytes of the present row that were met

    def take(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            if not self.left:
                raise ValueError("extraneous bytes in PNG data")
            rows, width = self.left[-1]
            begins = data[at + (width - self.inside if self.inside else 0) :][: (rows - bool(self.inside)) * width : width]
            if begins and max(begins) > 4:
                raise ValueError("corrupt PNG data: bad filter")
            met = min(len(data) - at, rows * width - self.inside)
            done = self.inside + met
            rows, self.inside, at = rows - done // width, done % width, at + met
            self.left[-1] = (rows, width)
            if not rows:
                self.left.pop()


def png_problem(f: BinaryIO) -> str | None:
    f.seek(8)
    rows, inflate, first = None, zlib.decompressobj(), True
    try:
        while len(start := f.read(8)) == 8:
            (n,), kind = struct.unpack(">I", start[:4]), start[4:]
            crc, head = zlib.crc32(kind), b""
            if first != (kind == b"IHDR") or first and n != 13:
                return "bad PNG header"
            first = False
            damage = None
            while n and (block := f.read(min(n, BLOCK))):
                crc, n = zlib.crc32(block, crc), n - len(block)
                if kind == b"IHDR":
                    head += block
                if kind == b"IDAT" and damage is None:
                    try:
                        while block:
                            rows.take(inflate.decompress(block, BLOCK))
                            block = inflate.unconsumed_tail
                    except (zlib.error, ValueError) as e:
                        damage = str(e) if isinstance(e, ValueError) else f"corrupt PNG data: {e}"
            want = f.read(4)
            if len(want) < 4:
                return "truncated PNG chunk"
            if crc != struct.unpack(">I", want)[0]:
                return "corrupt PNG chunk"
            if damage:
                return damage
            if kind == b"IHDR":
                rows = _Rows(head)
            if kind == b"IEND":
                while not inflate.eof and (more := inflate.decompress(inflate.unconsumed_tail, BLOCK)):
                    rows.take(more)
                return "truncated PNG data" if rows.left or not inflate.eof else None
    except (ValueError, zlib.error) as e:
        return str(e)
    return "truncated PNG"


# JPEG

#: Markers that may follow scan data: tables, further scans, restart intervals, line counts, application data, comments, the end.
_AFTER_SCAN = {0xC4, 0xCC, 0xDA, 0xDB, 0xDC, 0xDD, 0xDF, 0xD9, 0xFE, *range(0xE0, 0xF0)}
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
_END = 1 << 20


class Damage(Exception):
    """What is wrong with the data."""


@lru_cache(maxsize=64)
def _codes(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code length, symbol) of every 16-bit window of one Huffman table; length 0: no code begins so."""
    length, symbol = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    at, code = 16, 0
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            if code >= 1 << bits:
                raise Damage("corrupt JPEG tables")
            first = code << (16 - bits)
            length[first : first + (1 << (16 - bits))], symbol[first : first + (1 << (16 - bits))] = bits, table[at]
            at, code = at + 1, code + 1
        code <<= 1
    return length, symbol


@lru_cache(maxsize=64)
def _dc(table: bytes) -> list[int]:
    """Bits of a difference, code and value together; 0: no code."""
    length, symbol = _codes(table)
    return np.where((length > 0) & (symbol <= 16), length + symbol, 0).tolist()


@lru_cache(maxsize=64)
def _ac(table: bytes) -> tuple[list[int], list[int]]:
    """For each window (bits << 8 | coefficients passed, with _END where the block ends): of as many codes as it holds whole, and of the first alone; 0: no code."""
    length, symbol = _codes(table)
    run, size = symbol >> 4, symbol & 15
    ends = (size == 0) & (run < 15)
    bits, passed = length + size, np.where(ends, 0, run + 1)
    one = np.where(length > 0, bits << 8 | passed, 0) | np.where((length > 0) & ends, _END, 0)
    total, far, over, window = bits.copy(), passed.copy(), ends | (length == 0), np.arange(1 << 16)
    for _ in range(4):
        rest = (window << np.minimum(total, 16)) & 0xFFFF
        fits = ~over & (length[rest] > 0) & (total + bits[rest] <= 16)
        total, far = np.where(fits, total + bits[rest], total), np.where(fits, far + passed[rest], far)
        over = over | ~fits | ends[rest]
        last = fits & ends[rest]
        one_more = np.where(last, _END, 0)
        ends_here = one_more if _ == 0 else ends_here | one_more
    many = np.where(length > 0, total << 8 | far, 0) | ends_here | np.where((length > 0) & ends, _END, 0)
    return many.tolist(), one.tolist()


class _Bits:
    """Bits of one restart interval, stuffing removed, fed in pieces. ``windows[k]``: four bytes from byte k on."""

    def __init__(self, f: BinaryIO, begin: int, end: int) -> None:
        self.f, self.next, self.end = f, begin, end
        self.data, self.p, self.have, self.last = b"", 0, 0, False
        self.feed()

    def feed(self) -> None:
        raw = _at(self.f, self.next, min(FEED, self.end - self.next))
        self.next += len(raw)
        if raw.endswith(b"\xff") and self.next < self.end:
            raw += self.f.read(1)
            self.next += 1
        self.last = self.next >= self.end
        self.data = self.data[self.p >> 3 :] + raw.replace(b"\xff\x00", b"\xff")
        self.p &= 7
        self.have = 8 * len(self.data)
        b = np.frombuffer(self.data + bytes(8), np.uint8).astype(np.uint32)
        self.windows = (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]).tolist()

    def room(self, bits: int = 4096) -> None:
        """So many bits lie ahead, unless the interval ends before."""
        while self.p + bits > self.have and not self.last:
            self.feed()

    def peek(self) -> int:
        p = self.p
        return self.windows[p >> 3] >> (16 - (p & 7)) & 0xFFFF if p < self.have else 0

    def skip(self, n: int) -> None:
        self.p += n
        if self.p > self.have:
            raise Damage("truncated JPEG data")

    def take(self, n: int) -> int:
        out = self.peek() >> (16 - n) if n else 0
        self.skip(n)
        return out


def _sequential(bits: _Bits, dc: list[int], many: list[int], one: list[int]) -> None:
    """One block: a difference, then coefficients up to the 63rd."""
    p, have, windows = bits.p, bits.have, bits.windows
    if p >= have:
        raise Damage("truncated JPEG data")
    n = dc[windows[p >> 3] >> (16 - (p & 7)) & 0xFFFF]
    if not n:
        raise Damage("corrupt JPEG data: bad code")
    p, k = p + n, 1
    while k < 64:
        if p >= have:
            raise Damage("truncated JPEG data")
        at = windows[p >> 3] >> (16 - (p & 7)) & 0xFFFF
        v = many[at]
        if k + (v & 255) > 64 or v & _END and k + (v & 255) >= 64:
            v = one[at]
        if not v:
            raise Damage("corrupt JPEG data: bad code")
        p, k = p + ((v & ~_END) >> 8), k + (v & 255)
        if v & _END:
            break
    if k > 64:
        raise Damage("corrupt JPEG data: too many coefficients")
    bits.p = p
    if p > have:
        raise Damage("truncated JPEG data")


class _Progressive:
    """Blocks of a scan of a progressive image. ``known``: for each block the coefficients that are not zero so far, as bits."""

    def __init__(self, first: int, last: int, high: int, dc: list[int] | None, ac: tuple | None) -> None:
        self.first, self.last, self.high, self.dc, self.ac, self.run = first, last, high, dc, ac, 0

    def _symbol(self, bits: _Bits) -> int:
        length, symbol = self.ac
        at = bits.peek()
        if bits.p >= bits.have:
            raise Damage("truncated JPEG data")
        if not length[at]:
            raise Damage("corrupt JPEG data: bad code")
        bits.skip(length[at])
        return symbol[at]

    def block(self, bits: _Bits, known: list[int], which: int) -> None:
        if self.first == 0:
            if self.high:
                bits.skip(1)
            else:
                n = self.dc[bits.peek()] if bits.p < bits.have else -1
                if n <= 0:
                    raise Damage("corrupt JPEG data: bad code" if n == 0 else "truncated JPEG data")
                bits.skip(n)
            return
        k, mask = self.first, known[which]
        if not self.high:
            if self.run:
                self.run -= 1
                return
            while k <= self.last:
                r, s = divmod(self._symbol(bits), 16)
                if s:
                    k += r
                    if k > self.last:
                        raise Damage("corrupt JPEG data: too many coefficients")
                    bits.skip(s)
                    mask |= 1 << k
                    k += 1
                elif r < 15:
                    self.run = (1 << r) + bits.take(r) - 1
                    break
                else:
                    k += 16
            known[which] = mask
            return
        fresh = 0
        if not self.run:
            while k <= self.last:
                r, s = divmod(self._symbol(bits), 16)
                if s > 1:
                    raise Damage("corrupt JPEG data: bad code")
                if s:
                    bits.skip(1)
                elif r < 15:
                    self.run = (1 << r) + bits.take(r)
                    break
                while k <= self.last:
                    if mask >> k & 1:
                        bits.skip(1)
                    elif r == 0:
                        break
                    else:
                        r -= 1
                    k += 1
                if s:
                    if k > self.last:
                        raise Damage("corrupt JPEG data: too many coefficients")
                    fresh |= 1 << k
                k += 1
        if self.run:
            bits.skip((mask >> k & (1 << max(0, self.last + 1 - k)) - 1).bit_count())
            self.run -= 1
        known[which] = mask | fresh


def _scan_end(f: BinaryIO, at: int) -> tuple[int, list[tuple[int, int]]]:
    """(place of the marker that ends JPEG scan data, -1 if there is none; places and numbers of its restart markers)."""
    marker, restarts = re.compile(rb"\xff[^\x00\xff]"), []
    f.seek(at)
    tail = b""
    while block := f.read(BLOCK):
        both = tail + block
        for found in marker.finditer(both):
            place, kind = at - len(tail) + found.start(), both[found.start() + 1]
            if not 0xD0 <= kind <= 0xD7:
                return place, restarts
            restarts.append((place, kind - 0xD0))
        at, tail = at + len(block), both[-1:] if both.endswith(b"\xff") else b""
    return -1, restarts


class _Jpeg:
    def __init__(self, f: BinaryIO) -> None:
        self.f, self.tables, self.restart, self.frame, self.scans = f, {}, 0, None, set()

    def table(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            n = sum(body[at + 1 : at + 17])
            self.tables[body[at]] = body[at + 1 : at + 17 + n]
            if len(self.tables[body[at]]) < 16 + n:
                raise Damage("corrupt JPEG tables")
            at += 17 + n

    def start(self, kind: int, body: bytes) -> None:
        if self.frame is not None or len(body) < 6 or len(body) < 6 + 3 * body[5] or not body[5]:
            raise Damage("corrupt JPEG frame")
        _, high, wide, n = struct.unpack(">BHHB", body[:6])
        parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(n)}
        if not wide or any(not 1 <= x <= 4 for p in parts.values() for x in p):
            raise Damage("corrupt JPEG frame")
        self.frame, self.kind, self.high, self.wide = parts, kind, high, wide
        self.most = tuple(max(p[k] for p in parts.values()) for k in (0, 1))
        self.known: dict[int, list[int]] = {}

    def _grid(self, part: int) -> tuple[int, int, int]:
        """(blocks across and down of a component alone, blocks across in whole MCUs)."""
        (h, v), (hm, vm) = self.frame[part], self.most
        return -(-(-(-self.wide * h // hm)) // 8), -(-(-(-self.high * v // vm)) // 8), -(-self.wide // (8 * hm)) * h

    def scan(self, body: bytes, begin: int, end: int, restarts: list[tuple[int, int]]) -> None:
        if self.frame is None:
            raise Damage("JPEG scan without a frame")
        if len(body) < 1 or len(body) < 4 + 2 * body[0] or not body[0]:
            raise Damage("corrupt JPEG marker")
        own = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
        first, last, steps = body[1 + 2 * body[0] :][:3]
        if any(c not in self.frame for c, _ in own):
            raise Damage("corrupt JPEG marker")
        self.scans |= {c for c, _ in own}
        if self.kind > 0xC2 or not self.high:  # arithmetic, lossless and hierarchical data, or a height that comes later: markers only
            return
        progressive = self.kind == 0xC2
        if progressive and (first > last or last > 63 or first and len(own) > 1):
            raise Damage("corrupt JPEG marker")
        (hm, vm), walkers = self.most, []
        for c, tables in own:
            dc, ac = self.tables.get(tables >> 4), self.tables.get(0x10 | tables & 15)
            high = steps >> 4
            if (not progressive or first == 0 and not high) and dc is None or (not progressive or first) and ac is None:
                raise Damage("JPEG scan without its tables")
            if progressive:
                down = -(-self.high // (8 * vm)) * self.frame[c][1]
                known = self.known.setdefault(c, [0] * (self._grid(c)[2] * down) if first else [])
                if first and not known:
                    known.extend([0] * (self._grid(c)[2] * down))
                walkers.append((_Progressive(first, last, high, dc and _dc(dc), ac and tuple(x.tolist() for x in _codes(ac))), known))
            else:
                walkers.append((_dc(dc), *_ac(ac)))
        across, down, wide = self._grid(own[0][0])
        alone = len(own) == 1
        units = across * down if alone else -(-self.wide // (8 * hm)) * -(-self.high // (8 * vm))
        each = [1] if alone else [self.frame[c][0] * self.frame[c][1] for c, _ in own]
        pieces = list(zip([begin, *[p + 2 for p, _ in restarts]], [*[p for p, _ in restarts], end], strict=True))
        want = -(-units // self.restart) if self.restart else 1
        if [n for _, n in restarts] != [k % 8 for k in range(want - 1)]:
            raise Damage("corrupt JPEG data: bad restart markers")
        for k, (a, b) in enumerate(pieces):
            bits = _Bits(self.f, a, b)
            if progressive:
                for walker, _ in walkers:
                    walker.run = 0
            for unit in range(k * self.restart, min(units, (k + 1) * self.restart) if self.restart else units):
                bits.room()
                if progressive:
                    which = unit // across * wide + unit % across if alone else 0
                    for (walker, known), n in zip(walkers, each, strict=True):
                        for _ in range(n):
                            walker.block(bits, known, which)
                else:
                    for tables, n in zip(walkers, each, strict=True):
                        for _ in range(n):
                            bits.room()
                            _sequential(bits, *tables)
            bits.room()
            if bits.have - bits.p >= 8:
                raise Damage("corrupt JPEG data: extraneous bytes before marker")


def jpeg_problem(f: BinaryIO, size: int) -> str | None:
    """Walks all segments and the codes of all scans as far as the end marker; what follows it (motion photos) is not looked at."""
    at, image = 2, _Jpeg(f)
    try:
        while len(start := _at(f, at, 4)) >= 2:
            kind = start[1]
            if start[0] != 0xFF:
                return "corrupt JPEG marker"
            if kind == 0xFF:
                at += 1
            elif kind == 0xD9:
                if image.frame is None or not image.scans:
                    return "truncated JPEG"
                return None if image.scans == set(image.frame) else "JPEG without all of its scans"
            elif kind == 0x01 or 0xD0 <= kind <= 0xD7:
                at += 2
            elif len(start) < 4:
                break
            elif (n := struct.unpack(">H", start[2:])[0]) < 2:
                return "corrupt JPEG marker"
            else:
                body = _at(f, at + 4, n - 2) if kind in (0xC4, 0xDD, 0xDA) or kind in _FRAMES else b""
                at += 2 + n
                if kind == 0xC4:
                    image.table(body)
                elif kind == 0xDD and len(body) >= 2:
                    image.restart = struct.unpack(">H", body[:2])[0]
                elif kind in _FRAMES:
                    image.start(kind, body)
                elif kind == 0xDA:
                    end, restarts = _scan_end(f, at)
                    if end < 0:
                        return "missing EOI"
                    if _at(f, end + 1, 1)[0] not in _AFTER_SCAN:
                        return "corrupt JPEG data"
                    image.scan(body, at, end, restarts)
                    at = end
    except Damage as e:
        return str(e)
    except (struct.error, ValueError):
        return "corrupt JPEG marker"
    return "missing EOI" if image.scans else "truncated JPEG"


# Exif: where its TIFF block begins

def exif_place(f: BinaryIO, mime: str, size: int) -> int | None:
    """Place of the TIFF header in an APP1 segment, an eXIf or EXIF chunk, an Exif item, or at the start of a TIFF file."""
    if mime == "image/jpeg":
        at = 2
        while len(start := _at(f, at, 10)) == 10 and start[0] == 0xFF and start[1] not in (0xDA, 0xD9):
            if start[1] == 0xE1 and start[4:] == b"Exif\0\0":
                return at + 10
            at += 1 if start[1] == 0xFF else 2 + struct.unpack(">H", start[2:4])[0]
        return None
    if mime == "image/png":
        at = 8
        while len(start := _at(f, at, 8)) == 8 and start[4:] != b"IEND":
            if start[4:] == b"eXIf":
                return at + 8
            at += 12 + struct.unpack(">I", start[:4])[0]
        return None
    if mime == "image/webp":
        at = 12
        while len(start := _at(f, at, 14)) >= 8:
            if start[:4] == b"EXIF":
                return at + (14 if start[8:14] == b"Exif\0\0" else 8)
            n = struct.unpack("<I", start[4:8])[0]
            at += 8 + n + n % 2
        return None
    if mime == "image/tiff":
        return 0
    return _exif_item(f, size) if mime == "image/heic" else None


def _exif_item(f: BinaryIO, size: int) -> int | None:
    """HEIC: the item of type Exif that the meta box names, and where it lies in the file."""
    from filelake.sources.containers import boxes

    meta = next(((a, b) for kind, a, b in boxes(f, 0, size) if kind == b"meta"), None)
    inner = {kind: (a, b) for kind, a, b in boxes(f, meta[0] + 4, meta[1])} if meta else {}
    if not {b"iinf", b"iloc"} <= inner.keys():
        return None
    a, b = inner[b"iinf"]
    item = None
    for kind, x, y in boxes(f, a + (6 if _at(f, a, 1) == b"\0" else 8), b):
        raw = _at(f, x, min(y - x, 16))
        wide = 4 if raw[:1] == b"\x03" else 2
        if kind == b"infe" and raw[:1] in (b"\x02", b"\x03") and raw[6 + wide : 10 + wide] == b"Exif":
            item = int.from_bytes(raw[4 : 4 + wide], "big")
    a, b = inner[b"iloc"]
    raw = _at(f, a, min(b - a, BLOCK))
    version, at = raw[0], 6
    of, ln, base, index = raw[4] >> 4, raw[4] & 15, raw[5] >> 4, raw[5] & 15 if version else 0
    number = lambda at, n: int.from_bytes(raw[at : at + n], "big")
    ids = 4 if version == 2 else 2
    count, at = number(at, ids), at + ids
    for _ in range(count):
        own, at = number(at, ids), at + ids + (2 if version else 0) + 2
        start, at = number(at, base), at + base
        extents, at = number(at, 2), at + 2
        if own == item and extents:
            place = start + number(at + index, of)
            return place + 4 + int.from_bytes(_at(f, place, 4), "big")
        at += extents * (index + of + ln)
    return None

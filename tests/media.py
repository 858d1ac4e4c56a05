"""Small images and videos for tests and the bench, written from random coefficients."""

import random
import struct
import zlib

DC = bytes([0, 0, 0, 12, *[0] * 12, *range(12)])  # twelve codes of four bits
_AC = [0x00, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 11)]]
AC = bytes([0] * 7 + [len(_AC)] + [0] * 8 + _AC)  # codes of eight bits
_EOB = [r << 4 for r in range(1, 7)]
PROGRESSIVE = bytes([0] * 7 + [len(_AC) + len(_EOB)] + [0] * 8 + _AC + _EOB)


def segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, 2 + len(body)) + body


def stuffed(bits: str) -> bytes:
    bits += "1" * (-len(bits) % 8)
    return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\0") if bits else b""


def block(rnd: random.Random) -> str:
    out, k = f"{(n := rnd.randrange(8)):04b}" + "".join(rnd.choice("01") for _ in range(n)), 1
    while k < 64:
        at = rnd.randrange(len(_AC)) if rnd.random() < 0.9 else 0
        r, s = divmod(_AC[at], 16)
        if _AC[at] == 0 or k + r + 1 > 64:
            return out + f"{0:08b}"
        out, k = out + f"{at:08b}" + "".join(rnd.choice("01") for _ in range(s)), k + r + 1
    return out


def frame(kind: int, wide: int, high: int, parts: list[tuple[int, int]]) -> bytes:
    return segment(kind, struct.pack(">BHHB", 8, high, wide, len(parts)) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(parts)))


def units(bits: list[str], restart: int) -> bytes:
    """Scan data of MCUs, with restart markers in between."""
    if not restart:
        return stuffed("".join(bits))
    pieces = [stuffed("".join(bits[k : k + restart])) for k in range(0, len(bits), restart)]
    return b"".join(p + (bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(pieces) else b"") for k, p in enumerate(pieces))


def jpeg_image(seed: int, wide: int = 40, high: int = 24, parts: tuple = ((1, 1),), restart: int = 0, note: bytes = b"", extra: bytes = b"") -> bytes:
    """A sequential image of whole MCUs. ``note`` goes into comments, ``extra`` before them."""
    rnd = random.Random(seed)
    hm, vm = max(h for h, _ in parts), max(v for _, v in parts)
    n = -(-wide // 8) * -(-high // 8) if len(parts) == 1 else -(-wide // (8 * hm)) * -(-high // (8 * vm))
    each = 1 if len(parts) == 1 else sum(h * v for h, v in parts)
    data = units(["".join(block(rnd) for _ in range(each)) for _ in range(n)], restart)
    notes = b"".join(segment(0xFE, note[k : k + 60_000]) for k in range(0, len(note), 60_000))
    head = b"\xff\xd8" + extra + notes + segment(0xDB, bytes([0] + [1] * 64)) + frame(0xC0, wide, high, list(parts)) + segment(0xC4, b"\0" + DC) + segment(0xC4, b"\x10" + AC)
    scan = segment(0xDA, bytes([len(parts)]) + b"".join(bytes([k + 1, 0]) for k in range(len(parts))) + bytes([0, 63, 0]))
    return head + (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + scan + data + b"\xff\xd9"


def progressive_image(seed: int, wide: int = 60, high: int = 44) -> bytes:
    """Two components: differences and their refinement, then for each a band of coefficients with end-of-band runs, and its refinement."""
    rnd, parts, all_ = random.Random(seed), [(2, 1), (1, 1)], _AC + _EOB
    raw = lambda n: "".join(rnd.choice("01") for _ in range(n))
    mcus = -(-wide // 16) * -(-high // 8)
    sos = lambda own, a, b, h, low: segment(0xDA, bytes([len(own)]) + b"".join(bytes([c, 0]) for c in own) + bytes([a, b, h << 4 | low]))
    out = b"\xff\xd8" + segment(0xDB, bytes([0] + [1] * 64)) + frame(0xC2, wide, high, parts) + segment(0xC4, b"\0" + DC) + segment(0xC4, b"\x10" + PROGRESSIVE)
    out += sos([1, 2], 0, 0, 0, 1) + stuffed("".join(f"{(n := rnd.randrange(8)):04b}" + raw(n) for _ in range(3 * mcus))) + sos([1, 2], 0, 0, 1, 0) + stuffed(raw(3 * mcus))
    for c, (h, _) in enumerate(parts):
        n = -(-(-(-wide * h // 2)) // 8) * -(-high // 8)
        bits, known, at = "", [set() for _ in range(n)], 0
        while at < n:
            k = 1
            while k < 64:
                r, s = divmod(rnd.choice(_AC[1:]), 16)
                if rnd.random() < 0.2 or k + r > 63:
                    e = rnd.randrange(min(7, (n - at).bit_length()))  # a run ends with the last block at the latest
                    run = (1 << e) + (more := rnd.randrange(min(1 << e, n - at - (1 << e) + 1)))
                    bits += f"{all_.index(e << 4):08b}" + (f"{more:0{e}b}" if e else "")
                    at += run - 1
                    break
                bits += f"{all_.index(r << 4 | s):08b}" + raw(s)
                k += r + 1
                if s:
                    known[at].add(k - 1)
            at += 1
        out += sos([c + 1], 1, 63, 0, 1) + stuffed(bits)
        bits, at = "", 0
        for own in known:
            zeros = [k for k in range(1, 64) if k not in own]
            k, fresh = 1, sorted(rnd.sample(zeros, min(len(zeros), rnd.randrange(4))))
            for z in fresh:
                r = sum(k <= x < z for x in zeros)
                while r > 15:
                    stop = [x for x in zeros if x >= k][15]
                    bits += f"{all_.index(0xF0):08b}" + raw(sum(k <= x <= stop for x in own))
                    r, k = r - 16, stop + 1
                bits += f"{all_.index(r << 4 | 1):08b}" + raw(1 + sum(k <= x < z for x in own))
                k = z + 1
            if k < 64:
                bits += f"{0:08b}" + raw(sum(x >= k for x in own))
        out += sos([c + 1], 1, 63, 1, 0) + stuffed(bits)
    return out + b"\xff\xd9"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_image(rows: list[bytes], wide: int, high: int, depth: int = 8, colour: int = 0, interlaced: int = 0, parts: int = 1, extra: bytes = b"", end: bool = True) -> bytes:
    data = zlib.compress(b"".join(rows), 1)
    cut = [data[k * len(data) // parts : (k + 1) * len(data) // parts] for k in range(parts)]
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, depth, colour, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + extra + b"".join(chunk(b"IDAT", c) for c in cut) + (chunk(b"IEND", b"") if end else b"")


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + kind + body


def movie(samples: list[bytes], per_chunk: int = 2, shift: int = 0, mvhd: bytes = bytes(100), wide: bool = False) -> bytes:
    """Media data first, then a movie of one track whose tables lead to it; ``shift`` moves all chunk places."""
    head = box(b"ftyp", b"isom" + bytes(4))
    begin = len(head) + (16 if wide else 8)
    data = b"".join(samples)
    media = struct.pack(">I4sQ", 1, b"mdat", 16 + len(data)) + data if wide else box(b"mdat", data)
    starts = [begin + shift + sum(map(len, samples[:k])) for k in range(0, len(samples), per_chunk)]
    whole, rest = divmod(len(samples), per_chunk)
    runs = [(1, per_chunk)] * bool(whole) + [(whole + 1, rest)] * bool(rest)
    full = lambda kind, body: box(kind, bytes(4) + body)
    stsc = full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", a, n, 1) for a, n in runs))
    stsz = full(b"stsz", struct.pack(">II", 0, len(samples)) + b"".join(struct.pack(">I", len(s)) for s in samples))
    place = full(b"co64", struct.pack(">I", len(starts)) + b"".join(struct.pack(">Q", s) for s in starts)) if wide else full(b"stco", struct.pack(">I", len(starts)) + b"".join(struct.pack(">I", s) for s in starts))
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1) + box(b"url ", b"\0\0\0\x01")))
    track = box(b"trak", box(b"mdia", box(b"minf", dinf + box(b"stbl", stsc + stsz + place))))
    return head + media + box(b"moov", box(b"mvhd", mvhd) + track)


def element(kind: int, body: bytes, open_: bool = False) -> bytes:
    raw = kind.to_bytes((kind.bit_length() + 7) // 8, "big")
    return raw + (b"\x01" + b"\xff" * 7 if open_ else (len(body) | 1 << 56).to_bytes(8, "big")) + body


def matroska(clusters: int = 3, date: int | None = None, open_: bool = False) -> bytes:
    info = element(0x1549A966, element(0x2AD7B1, b"\x0f\x42\x40") + (element(0x4461, struct.pack(">q", date)) if date is not None else b""))
    body = info + element(0x1654AE6B, element(0xAE, b"x")) + b"".join(element(0x1F43B675, element(0xE7, b"\1") + element(0xA3, bytes(200 + k)), open_) for k in range(clusters))
    return element(0x1A45DFA3, b"abcd") + element(0x18538067, body, open_)

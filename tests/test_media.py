"""Images that decode and images that don't; containers whose data are where their tables say."""

import io
import random
import struct

import pytest

from filelake.sources import content
from filelake.sources.containers import avi_date, matroska_date, matroska_problem, movie_problem, riff_problem
from filelake.sources.images import PNG_PASSES, exif_place, jpeg_problem, png_problem
from tests.media import box, chunk, element, jpeg_image, matroska, movie, png_image, progressive_image, segment


def see(check, data: bytes):
    return check(io.BytesIO(data), len(data)) if check is not png_problem else check(io.BytesIO(data))


KINDS = [{}, {"parts": ((2, 2), (1, 1), (1, 1)), "restart": 2}, {"parts": ((2, 1), (1, 1)), "wide": 51, "high": 33}, {"restart": 3, "wide": 300}]


@pytest.mark.parametrize("seed", range(6))
def test_sound_jpegs_pass(seed):
    for kind in KINDS:
        photo = jpeg_image(seed, **kind)
        assert see(jpeg_problem, photo) is None and see(jpeg_problem, photo + b"motion video \xff\xd9" * 99) is None
    assert see(jpeg_problem, progressive_image(seed)) is None and see(jpeg_problem, jpeg_image(seed, 1200, 900)) is None  # longer than one piece of the feed


def test_jpegs_without_their_parts_fail():
    photo = jpeg_image(1)
    cut = lambda kind: photo[: (at := photo.index(kind))] + photo[at + 2 + struct.unpack(">H", photo[at + 2 : at + 4])[0] :]
    assert see(jpeg_problem, b"\xff\xd8\xff\xda\0\2" + b"text" * 30 + b"\xff\xd9") == "JPEG scan without a frame"
    assert see(jpeg_problem, cut(b"\xff\xc0")) == "JPEG scan without a frame" and see(jpeg_problem, cut(b"\xff\xc4")) == "JPEG scan without its tables"
    assert see(jpeg_problem, photo[: photo.index(b"\xff\xda")] + b"\xff\xd9") == "truncated JPEG" and see(jpeg_problem, photo[:9]) == "truncated JPEG"
    assert see(jpeg_problem, photo[:-2]) == "missing EOI" and see(jpeg_problem, photo[:-30] + b"\xff\xd9") == "truncated JPEG data"
    assert see(jpeg_problem, photo[:-2] + bytes(9) + b"\xff\xd9") == "corrupt JPEG data: extraneous bytes before marker"
    three = jpeg_image(2, parts=((1, 1), (1, 1)), restart=1)
    assert see(jpeg_problem, three.replace(b"\xff\xd1", b"\xff\xd4", 1)) == "corrupt JPEG data: bad restart markers"
    one = photo[: (at := photo.index(b"\xff\xc0"))] + segment(0xC0, struct.pack(">BHHB", 8, 24, 40, 2) + bytes([1, 0x11, 0, 2, 0x11, 0])) + photo[at + 13 :]
    assert see(jpeg_problem, one) == "JPEG without all of its scans"


def test_shredded_jpegs_fail():
    rnd, caught = random.Random(1), 0
    for k in range(60):
        photo = bytearray(progressive_image(k, 120, 120) if k % 2 else jpeg_image(k, 200, 200, ((2, 2), (1, 1), (1, 1))))
        at = rnd.randrange(900, len(photo) - 40)
        photo[at : at + 16] = rnd.randbytes(16)
        caught += see(jpeg_problem, bytes(photo)) is not None
    assert caught >= 57  # the rest are codes that end at the same place


def png_rows(wide: int, high: int, bits: int = 8) -> list[bytes]:
    rnd = random.Random(wide)
    return [bytes([k % 5]) + rnd.randbytes((wide * bits + 7) // 8) for k in range(high)]


def test_pngs_are_inflated_and_counted():
    rows = png_rows(300, 200, 24)
    assert see(png_problem, png_image(rows, 300, 200, 8, 2, parts=3)) is None and see(png_problem, png_image(png_rows(13, 9, 1), 13, 9, 1)) is None
    passes = [r for x, y, dx, dy in PNG_PASSES for r in png_rows(-(-(21 - x) // dx), -(-(37 - y) // dy))]
    assert see(png_problem, png_image(passes, 21, 37, interlaced=1)) is None and see(png_problem, png_image(passes[:-1], 21, 37, interlaced=1)) == "truncated PNG data"
    assert see(png_problem, png_image(rows[:-1], 300, 200, 8, 2)) == "truncated PNG data" and see(png_problem, png_image([*rows, b"\0"], 300, 200, 8, 2)) == "extraneous bytes in PNG data"
    assert see(png_problem, png_image([b"\5" + rows[0][1:], *rows[1:]], 300, 200, 8, 2)) == "corrupt PNG data: bad filter"
    assert see(png_problem, b"\x89PNG\r\n\x1a\n" + chunk(b"IEND", b"")) == "bad PNG header" and see(png_problem, png_image(rows, 300, 200, 4, 2)) == "bad PNG header"
    whole = png_image(rows, 300, 200, 8, 2)
    at = whole.index(b"IDAT")
    n = struct.unpack(">I", whole[at - 4 : at])[0]
    hurt = bytearray(whole[at + 4 : at + 4 + n])
    hurt[n // 2] ^= 0x55  # with a checksum that fits: only inflating shows it
    assert see(png_problem, whole[: at - 4] + chunk(b"IDAT", bytes(hurt)) + chunk(b"IEND", b"")).startswith("corrupt PNG data")
    assert see(png_problem, png_image(rows, 300, 200, 8, 2, end=False)) == "truncated PNG"


def test_samples_lie_in_the_media_data():
    samples = [random.Random(k).randbytes(50 + k) for k in range(9)]
    for kind in ({}, {"wide": True}, {"per_chunk": 4}, {"per_chunk": 1}):
        assert see(movie_problem, movie(samples, **kind)) is None
        for shift in (1, -1, 70_000):
            assert see(movie_problem, movie(samples, shift=shift, **kind)) == "samples outside the media data"
    whole = movie(samples)
    at = whole.index(b"mdat") - 4
    short = whole[:at] + box(b"mdat", b"".join(samples)[:-200]) + whole[at + 8 + sum(map(len, samples)) :]
    assert see(movie_problem, short) == "samples outside the media data" and see(movie_problem, whole[:-9]) == "truncated container"
    assert see(movie_problem, whole.replace(b"stsz", b"free")) == "sample table not found" and see(movie_problem, whole[: whole.index(b"moov") - 4]) == "moov atom not found"
    assert see(movie_problem, whole.replace(b"mvhd", b"free")) == "movie header not found" and see(movie_problem, b"\0\0\0\x10ftypisom" + b"noise!" * 9) is not None
    at = whole.index(b"stsc") + 12
    assert see(movie_problem, whole[:at] + struct.pack(">I", 2) + whole[at + 4 :]) == "corrupt sample table"
    at = whole.index(b"stco") + 8
    assert see(movie_problem, whole[:at] + struct.pack(">I", 9999) + whole[at + 4 :]) == "truncated sample table"


def test_matroska_elements_and_date():
    for kind in ({}, {"open_": True}):
        whole = matroska(**kind, date=123_456_789_000)
        assert see(matroska_problem, whole) is None and str(see(matroska_date, whole)) == "2001-01-01 00:02:03.456789"
        assert see(matroska_problem, whole[:-5]) == "truncated container"
    assert see(matroska_date, matroska()) is None and see(matroska_date, b"\x1aE") is None
    assert see(matroska_problem, matroska(0)) == "no track or cluster found" and see(matroska_problem, matroska()[:12] + b"odd bytes") == "container could not be parsed"
    bad = element(0x1A45DFA3, b"") + element(0x18538067, element(0x1654AE6B, b"") + element(0x1F43B675, b"\xa3\x8f" + bytes(3)))
    assert see(matroska_problem, bad) == "truncated cluster"


def test_riff_chunks_and_date():
    riff = lambda body, kind=b"AVI ": b"RIFF" + struct.pack("<I", 4 + len(body)) + kind + body
    part = lambda kind, body: kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    idit = part(b"IDIT", b"Mon Mar 10 15:04:43 2003\n\0")
    whole = riff(part(b"LIST", b"hdrl" + part(b"avih", bytes(56)) + idit) + part(b"LIST", b"movi" + bytes(90)))
    assert see(riff_problem, whole) is None and str(see(avi_date, whole)) == "2003-03-10 15:04:43" and see(avi_date, riff(part(b"LIST", b"hdrl"))) is None
    assert see(riff_problem, whole[:-1]) == "truncated RIFF" and see(riff_problem, riff(b"movi\xff\0\0\0abc")) == "truncated RIFF chunk"


def tiff(date: bytes) -> bytes:
    return b"MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHIII", 1, 0x8769, 4, 1, 26, 0) + struct.pack(">HHHIII", 1, 0x9003, 2, 20, 44, 0) + date + b"\0"


def test_exif_counts_only_where_it_belongs(tmp_path):
    date = tiff(b"2012:03:04 05:06:07")
    webp = b"VP8 " + struct.pack("<I", 4) + b"data" + b"EXIF" + struct.pack("<I", len(date)) + date
    found = {
        "a.jpg": jpeg_image(1, extra=segment(0xE0, b"JFIF\0") + segment(0xE1, b"http://x") + segment(0xE1, b"Exif\0\0" + date)),
        "b.png": png_image(png_rows(8, 8), 8, 8, extra=chunk(b"eXIf", date)), "c.webp": b"RIFF" + struct.pack("<I", 4 + len(webp)) + b"WEBP" + webp, "d.tif": date,
        "e.heic": heic(date), "f.heic": heic(date, 1),
    }
    for name, data in found.items():
        (tmp_path / name).write_bytes(data)
        got = content.inspect(str(tmp_path / name))
        assert got[4] is None and str(got[5]) == "2012-03-04 05:06:07", name
    stray = {"g.jpg": jpeg_image(1, note=b"Exif\0\0" + date) + b"Exif\0\0" + date, "h.png": png_image(png_rows(8, 8), 8, 8, extra=chunk(b"tEXt", b"Exif\0\0" + date))}
    for name, data in stray.items():
        (tmp_path / name).write_bytes(data)
        assert content.inspect(str(tmp_path / name))[4:6] == (None, None), name
    assert exif_place(io.BytesIO(b""), "image/heic", 0) is None and exif_place(io.BytesIO(b""), "image/gif", 0) is None


def heic(date: bytes, version: int = 0) -> bytes:
    full = lambda kind, body, v=0: box(kind, bytes([v, 0, 0, 0]) + body)
    infe = full(b"infe", struct.pack(">HH4s", 7, 0, b"hvc1") + b"\0", 2) + full(b"infe", struct.pack(">HH4s", 8, 0, b"Exif") + b"\0", 2)
    iinf = full(b"iinf", struct.pack(">H", 2) + infe)
    place = lambda at: full(b"iloc", b"\x44\x00" + struct.pack(">H", 2) + b"".join(struct.pack(">H", i) + (b"\0\0" if version else b"") + struct.pack(">HHII", 0, 1, at, 9) for i in (7, 8)), version)
    head = box(b"ftyp", b"heic" + bytes(4))
    meta = full(b"meta", iinf + place(0))
    return head + full(b"meta", iinf + place(len(head) + len(meta) + 8)) + box(b"mdat", struct.pack(">I", 6) + b"Exif\0\0" + date)


def test_text_heads_that_end_within_a_character():
    from filelake.sources.content import sniff

    text = ("é日😀" * 9).encode()
    assert {sniff(text[:n]) for n in range(1, len(text) + 1)} == {"text/plain"}
    assert sniff(b"\xff" + text) == sniff(text + b"\xff\xff") == sniff(text + b"\0") == "application/octet-stream"

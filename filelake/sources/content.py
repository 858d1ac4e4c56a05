"""File content in one pass per file: SHA-256, SHA-256 of the first 64 KiB, MIME type, structural validity, embedded date.

Runs in Arrow batches over paths, streams files of any size in blocks, and keeps contents
out of the plan. Structure and dates are found by seeking, at any size, in bounded memory. Filter with the cheap gates first: Python runs for every row it is given.
Structural checks (``deep``) inflate PNG data and count its rows, walk JPEG scans code by code, and follow sample
tables and clusters of videos to their data; damage that forms valid codes of the right number is not detected.
"""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelake.functions.fixed import PARTIAL_BYTES
from filelake.operators.control import Gate
from filelake.operators.live import Tally
from filelake.session import file_tasks, ship
from filelake.sources.containers import avi_date, matroska_date, matroska_problem, movie_date, movie_problem, riff_problem
from filelake.sources.images import exif_place, jpeg_problem, png_problem

SCHEMA = "path string, sha256 string, partial_sha256 string, mime string, problem string, embedded_date timestamp_ntz, error string"
BLOCK = 1 << 20
#: Files up to this size are kept in memory while they are hashed, so that one read serves structure and date, too.
WHOLE = 32 << 20
NOT_REACHED = "NOT_REACHED"


def sniff(head: bytes) -> str:
    """MIME type by leading bytes; names are never looked at."""
    if not head:
        return "application/x-empty"
    if head.startswith(b"RIFF") and len(head) > 11:
        return {b"WEBP": "image/webp", b"AVI ": "video/x-msvideo", b"WAVE": "audio/x-wav"}.get(head[8:12], "application/octet-stream")
    if head[4:8] == b"ftyp":
        brand = head[8:12]
        return "image/heic" if brand in (b"heic", b"heix", b"mif1", b"msf1") else "video/quicktime" if brand == b"qt  " else "video/3gpp" if brand[:3] == b"3gp" else "video/mp4"
    for magic, mime in (
        (b"\xff\xd8\xff", "image/jpeg"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"), (b"II*\0", "image/tiff"), (b"MM\0*", "image/tiff"),
        (b"\x1aE\xdf\xa3", "video/x-matroska"), (b"MZ", "application/x-msdownload"), (b"\x7fELF", "application/x-elf"), (b"PK\x03\x04", "application/zip"), (b"PK\x05\x06", "application/zip"),
        (b"%PDF", "application/pdf"), (b"Rar!", "application/vnd.rar"), (b"7z\xbc\xaf", "application/x-7z-compressed"), (b"\x1f\x8b", "application/gzip"), (b"BZh", "application/x-bzip2"),
        (b"\xfd7zXZ", "application/x-xz"), (b"\xd0\xcf\x11\xe0", "application/x-ms-installer"), (b"{\\rtf", "application/rtf"), (b"ID3", "audio/mpeg"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"),
        (b"MSCF", "application/vnd.ms-cab-compressed"), (b"#!", "application/x-sh"),
    ):
        if head.startswith(magic):
            return mime
    if re.match(rb"(?is)\s*(<!doctype html|<html)", head):
        return "text/html"
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(head)  # the head may end within a character
    except UnicodeDecodeError:
        return "application/octet-stream"
    return "text/plain" if all(c >= " " or c in "\t\r\n\f" for c in text) else "application/octet-stream"


def sniffed(head: Column) -> Column:
    """MIME type of a column with the first bytes of each content, in Arrow batches."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def types(heads: pd.Series) -> pd.Series:
        return heads.map(lambda x: None if x is None else sniff(bytes(x)))

    return types(head)


def refine_zip(path: str) -> str:
    try:
        with zipfile.ZipFile(path) as z:
            return "application/vnd.android.package-archive" if {"AndroidManifest.xml", "classes.dex"} <= set(z.namelist()) else "application/zip"
    except (OSError, zipfile.BadZipFile):
        return "application/zip"


def _at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def gif_problem(f: BinaryIO, size: int) -> str | None:
    def blocks() -> bool:
        while n := f.read(1):
            if n == b"\0":
                return True
            f.seek(n[0], 1)
        return False

    head = _at(f, 0, 13)
    if len(head) < 13:
        return "truncated GIF"
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0
    f.seek(13 + table(head[10]))
    while kind := f.read(1):
        if kind == b";":
            return None
        if kind == b"!":
            f.seek(1, 1)
        elif kind == b"," and len(image := f.read(9)) == 9:
            f.seek(table(image[8]) + 1, 1)
        else:
            return "corrupt GIF block"
        if not blocks():
            return "truncated GIF"
    return "truncated GIF"


def bmp_problem(f: BinaryIO, size: int) -> str | None:
    head = _at(f, 0, 54)
    if len(head) < 26:
        return "truncated BMP"
    start, kind = struct.unpack("<I", head[10:14])[0], struct.unpack("<I", head[14:18])[0]
    if kind < 40 or len(head) < 54:
        return None if start < size else "truncated BMP"
    wide, high, _, bits, packed = struct.unpack("<iiHHI", head[18:34])
    need = start + (abs(wide) * bits + 31) // 32 * 4 * abs(high) if packed in (0, 3) else start + 1
    return None if need <= size else "truncated BMP"


def tiff_problem(f: BinaryIO, size: int) -> str | None:
    head = _at(f, 0, 8)
    e = "<" if head[:2] == b"II" else ">"
    at = struct.unpack(e + "I", head[4:8])[0] if len(head) == 8 else 0
    count = _at(f, at, 2) if 8 <= at < size else b""
    if len(count) < 2 or at + 2 + 12 * struct.unpack(e + "H", count)[0] > size:
        return "truncated TIFF"
    return None


def structure(f: BinaryIO, mime: str, size: int) -> str | None:
    """First problem of a media file's structure; None where it is sound or of a kind that is not checked."""
    if mime == "image/png":
        return png_problem(f)
    if mime.startswith("video/"):
        check = {"video/x-msvideo": riff_problem, "video/x-matroska": matroska_problem}.get(mime, movie_problem)
        return None if (why := check(f, size)) is None else f"Corrupt video: {why}"
    check = {"image/jpeg": jpeg_problem, "image/gif": gif_problem, "image/bmp": bmp_problem, "image/tiff": tiff_problem, "image/webp": riff_problem}.get(mime)
    return check(f, size) if check else None


def image_date(f: BinaryIO, mime: str, size: int) -> datetime | None:
    """DateTimeOriginal of the image's own Exif block, wherever its directories lie."""
    base = exif_place(f, mime, size)
    head = _at(f, base, 8) if base is not None else b""
    if len(head) < 8 or head[:4] not in (b"II*\0", b"MM\0*"):
        return None
    e = "<" if head[:2] == b"II" else ">"
    todo, seen = [struct.unpack(e + "I", head[4:8])[0]], set()
    while todo:
        ifd = todo.pop()
        if ifd in seen or len(count := _at(f, base + ifd, 2)) < 2:
            continue
        seen.add(ifd)
        entries = f.read(12 * struct.unpack(e + "H", count)[0])
        for k in range(0, len(entries) - 11, 12):
            tag, _, n, value = struct.unpack(e + "HHII", entries[k : k + 12])
            if tag == 0x8769:
                todo.append(value)
            elif tag == 0x9003:
                try:
                    return datetime.strptime(_at(f, base + value, min(n, 4096)).rstrip(b"\0 ").decode("ascii"), "%Y:%m:%d %H:%M:%S")
                except (ValueError, UnicodeDecodeError):
                    return None
    return None


def video_date(f: BinaryIO, mime: str, size: int) -> datetime | None:
    """Creation time that the container itself states."""
    find = {"video/x-msvideo": avi_date, "video/x-matroska": matroska_date}.get(mime, movie_date)
    return find(f, size)


class NotReached(Exception):
    """The job was stopped before the file's end."""


def inspect(path: str, deep: bool = True, gate: Gate | None = None) -> tuple:
    """One row of SCHEMA. A file of up to ``WHOLE`` bytes is read once; of a larger one the structure is met again by seeking."""
    full, part, head, size, kept = hashlib.sha256(), hashlib.sha256(), b"", 0, []
    try:
        with open(path, "rb") as f:
            while block := f.read(BLOCK):
                if gate is not None and not gate.go_on():
                    raise NotReached
                full.update(block)
                if size < PARTIAL_BYTES:
                    part.update(block[: PARTIAL_BYTES - size])
                head = head or block[:4096]
                size += len(block)
                if size <= WHOLE:
                    kept.append(block)
                else:
                    kept.clear()
            mime = sniff(head)
            g = io.BytesIO(b"".join(kept)) if size <= WHOLE and mime.startswith(("image/", "video/")) else f
            problem = structure(g, mime, size) if deep else None
            date = image_date(g, mime, size) if mime.startswith("image/") else video_date(g, mime, size) if mime.startswith("video/") else None
    except OSError as e:
        return (path, None, None, "application/x-unreadable", None, None, f"{type(e).__name__}: {e.strerror}")
    if mime == "application/zip":
        mime = refine_zip(path)
    return (path, full.hexdigest(), part.hexdigest(), mime, problem, date, None)


def with_content(files: DataFrame, deep: bool = True, gate: Gate | None = None, counts: str | None = None) -> DataFrame:
    """``files`` and the columns of SCHEMA (replacing those of that name); big files spread over tasks by path. ``deep``: check structures too.

    Before each file and block the task asks ``gate``; once that says no, the rest has the error NOT_REACHED and nothing else.
    ``counts``: the folder in which tasks tally what they have read so far.
    """
    gate, found = gate or Gate(None), [x.split()[0] for x in SCHEMA.split(", ")][1:]
    rest = [c for c in files.columns if c not in found]
    at = rest.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally.of_task(counts, "read")
        for batch in batches:
            rows = []
            for path in batch.column(at).to_pylist():
                try:
                    if not gate.go_on():
                        raise NotReached
                    rows.append(inspect(path, deep, gate)[1:])
                    sound = rows[-1][3] is None and rows[-1][5] is None and rows[-1][2].startswith(("image/", "video/"))
                    tally.add("READ" if sound else "FAILED")
                except NotReached:
                    rows.append((None, None, None, None, None, NOT_REACHED))
            kinds = [pa.string()] * 4 + [pa.timestamp("us"), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], [*rest, *found])
        tally.write()

    ship(files.sparkSession)
    dealt = files.select(*rest).repartition(file_tasks(files.sparkSession), "path")
    more = files.sparkSession.createDataFrame([], SCHEMA).drop("path").schema
    return dealt.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in [*dealt.schema, *more]]))


def read_content(files: DataFrame, deep: bool = True) -> DataFrame:
    """SCHEMA rows for the paths of ``files``."""
    return with_content(files.select("path"), deep)

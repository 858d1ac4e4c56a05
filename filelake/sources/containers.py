"""Whether a video container hangs together: boxes, sample tables and media data, or EBML elements and clusters."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import BinaryIO

import numpy as np


def _at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def boxes(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the contents of each ISO box between two places."""
    while at + 8 <= end and len(start := _at(f, at, 16)) >= 8:
        (n,), skip = struct.unpack(">I", start[:4]), 8
        if n == 1 and len(start) == 16:
            (n,), skip = struct.unpack(">Q", start[8:]), 16
        elif n == 0:  # as far as the end
            n = end - at
        if n < skip:
            return
        yield start[4:8], at + skip, min(at + n, end)
        at += n


def _numbers(f: BinaryIO, at: int, end: int, head: int, kind: str, per: int = 1) -> np.ndarray:
    """The entries of a table box: a count at its byte ``head - 4``, then rows of ``per`` numbers."""
    count = int.from_bytes(_at(f, at + head - 4, 4), "big")
    width = np.dtype(kind).itemsize * per
    if at + head + count * width > end:
        raise ValueError("truncated sample table")
    return np.frombuffer(_at(f, at + head, count * width), kind).astype(np.int64).reshape(count, per)


def _within(f: BinaryIO, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for want in path:
        found = next(((a, b) for kind, a, b in boxes(f, at, end) if kind == want), None)
        if found is None:
            return None
        at, end = found
    return at, end


def _track_problem(f: BinaryIO, at: int, end: int, media: np.ndarray) -> str | None:
    """Every chunk of a track, as long as its samples say, must lie inside one media data box."""
    dref = _within(f, at, end, b"mdia", b"minf", b"dinf", b"dref")
    if dref and any(_at(f, a, 4)[3:] != b"\x01" for _, a, _ in boxes(f, dref[0] + 8, dref[1])):
        return None  # its data lie in another file
    table = _within(f, at, end, b"mdia", b"minf", b"stbl")
    if table is None:
        return "sample table not found"
    own = {kind: (a, b) for kind, a, b in boxes(f, *table)}
    place = own.get(b"stco") or own.get(b"co64")
    if place is None or not {b"stsc", b"stsz"} & own.keys():
        return "sample table not found"
    starts = _numbers(f, *place, 8, ">u4" if b"stco" in own else ">u8")[:, 0]
    if not len(starts):
        return None  # fragments hold the samples
    if b"stsz" not in own or b"stsc" not in own:
        return None if b"stz2" in own else "sample table not found"
    fixed = int.from_bytes(_at(f, own[b"stsz"][0] + 4, 4), "big")
    count = int.from_bytes(_at(f, own[b"stsz"][0] + 8, 4), "big")
    sizes = np.append(0, np.cumsum(np.full(count, fixed) if fixed else _numbers(f, *own[b"stsz"], 12, ">u4")[:, 0]))
    runs = _numbers(f, *own[b"stsc"], 8, ">u4", 3)
    if not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or runs[-1, 0] > len(starts):
        return "corrupt sample table"
    each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(starts) + 1)))
    last = np.cumsum(each)
    if last[-1] != count:
        return "corrupt sample table"
    ends = starts + sizes[last] - sizes[last - each]
    box = np.searchsorted(media[:, 0], starts, side="right") - 1
    if (box < 0).any() or (ends > media[box, 1]).any():
        return "samples outside the media data"
    return None


def movie_problem(f: BinaryIO, size: int) -> str | None:
    """The top boxes of an ISO media file follow each other as far as the end; its tracks' samples lie in its media data."""
    at, kinds, media, movie = 0, set(), [], None
    while at < size:
        start = _at(f, at, 16)
        if len(start) < 8:
            break  # some bytes of padding
        (n,), kind, skip = struct.unpack(">I", start[:4]), start[4:8], 8
        if n == 1 and len(start) == 16:
            (n,), skip = struct.unpack(">Q", start[8:]), 16
        elif n == 0:
            n = size - at
        if n == 0 or start == b"\0" * len(start):
            break
        if n < skip or not re.fullmatch(rb"[ -~\xa9]{4}", kind):
            return "container could not be parsed"
        if at + n > size:
            return "truncated container"
        kinds.add(kind)
        if kind == b"mdat":
            media.append((at + skip, at + n))
        elif kind == b"moov":
            movie = (at + skip, at + n)
        at += n
    if movie is None:
        return "moov atom not found"
    inner = list(boxes(f, *movie))
    if not any(kind == b"mvhd" for kind, _, _ in inner):
        return "movie header not found"
    places = np.array(sorted(media), np.int64).reshape(len(media), 2)
    try:
        for kind, a, b in inner:
            if kind == b"trak" and (why := _track_problem(f, a, b, places)):
                return why
    except (ValueError, IndexError) as e:
        return str(e) if isinstance(e, ValueError) else "corrupt sample table"
    return None


def movie_date(f: BinaryIO, size: int) -> datetime | None:
    """Creation time of an ISO media file's mvhd box (seconds since 1904), wherever its moov box lies."""
    for kind, begin, end in boxes(f, 0, size):
        for inner, at, _ in boxes(f, begin, end) if kind == b"moov" else ():
            raw = _at(f, at, 12)
            if inner == b"mvhd" and len(raw) == 12:
                seconds = struct.unpack(">Q", raw[4:])[0] if raw[0] == 1 else struct.unpack(">I", raw[4:8])[0]
                return datetime(1904, 1, 1) + timedelta(seconds=seconds) if 0 < seconds < 1 << 36 else None
    return None


# Matroska

# Element numbers.
EBML, SEGMENT, CLUSTER, INFO, TRACKS, DATE = 0x1A45DFA3, 0x18538067, 0x1F43B675, 0x1549A966, 0x1654AE6B, 0x4461
_UNKNOWN = -1


def _element(f: BinaryIO, at: int) -> tuple[int, int, int]:
    """(number, begin, length) of the element at a place; length _UNKNOWN where it is left open. ValueError where there is none."""
    raw = _at(f, at, 12)
    wide = 9 - raw[0].bit_length() if raw and raw[0] else 9
    if wide > 4 or len(raw) <= wide or not raw[wide]:
        raise ValueError("container could not be parsed")
    long = 9 - raw[wide].bit_length()
    if len(raw) < wide + long:
        raise ValueError("truncated container")
    value = int.from_bytes(raw[wide : wide + long], "big") & (1 << 7 * long) - 1
    return int.from_bytes(raw[:wide], "big"), at + wide + long, _UNKNOWN if value == (1 << 7 * long) - 1 else value


def _top(f: BinaryIO, size: int) -> Iterator[tuple[int, int, int]]:
    """(number, begin, end) of the elements of the segment; ValueError where they do not follow each other to its end."""
    kind, begin, n = _element(f, 0)
    if kind != EBML or n < 0:
        raise ValueError("container could not be parsed")
    kind, at, n = _element(f, begin + n)
    if kind != SEGMENT:
        raise ValueError("container could not be parsed")
    end = size if n == _UNKNOWN else at + n
    if end > size:
        raise ValueError("truncated container")
    while at < end:
        kind, begin, n = _element(f, at)
        if n == _UNKNOWN and kind == CLUSTER:  # a live recording: its blocks follow until the next cluster
            yield kind, begin, begin
            at = begin
            continue
        if n == _UNKNOWN or begin + n > end:
            raise ValueError("truncated container")
        yield kind, begin, begin + n
        at = begin + n


def matroska_problem(f: BinaryIO, size: int) -> str | None:
    """All elements of the segment, and those inside each cluster, follow each other to their end, and there is a track and a cluster."""
    met = set()
    try:
        for kind, begin, end in _top(f, size):
            met.add(kind)
            at = begin
            while kind == CLUSTER and at < end:
                _, inner, n = _element(f, at)
                if n == _UNKNOWN or inner + n > end:
                    return "truncated cluster"
                at = inner + n
    except ValueError as e:
        return str(e)
    return None if {TRACKS, CLUSTER} <= met else "no track or cluster found"


def matroska_date(f: BinaryIO, size: int) -> datetime | None:
    """DateUTC: nanoseconds since 2001."""
    try:
        for kind, at, end in _top(f, size):
            while kind == INFO and at < end:
                inner, begin, n = _element(f, at)
                if inner == DATE and n == 8:
                    return datetime(2001, 1, 1) + timedelta(microseconds=struct.unpack(">q", _at(f, begin, 8))[0] // 1000)
                at = begin + n
    except (ValueError, OverflowError, struct.error):
        pass
    return None


# RIFF

def riff_problem(f: BinaryIO, size: int) -> str | None:
    """WebP and AVI: the size that the file states must be there, and its chunks follow each other to that end."""
    head = _at(f, 0, 12)
    if len(head) < 12 or struct.unpack("<I", head[4:8])[0] + 8 > size:
        return "truncated RIFF"
    at, end = 12, struct.unpack("<I", head[4:8])[0] + 8
    while at + 8 <= end:
        n = struct.unpack("<I", _at(f, at + 4, 4))[0]
        if at + 8 + n > end:
            return "truncated RIFF chunk"
        at += 8 + n + n % 2
    return None


def avi_date(f: BinaryIO, size: int) -> datetime | None:
    """The IDIT chunk of the header list."""
    at = 12
    while len(start := _at(f, at, 12)) == 12:
        n = struct.unpack("<I", start[4:8])[0]
        if start[:4] == b"LIST" and start[8:] == b"hdrl":
            at, size = at + 12, at + 8 + n
            continue
        if start[:4] == b"IDIT":
            try:
                return datetime.strptime(_at(f, at + 8, min(n, 64)).rstrip(b"\0\r\n ").decode("ascii"), "%a %b %d %H:%M:%S %Y")
            except (ValueError, UnicodeDecodeError):
                return None
        at += 8 + n + n % 2
        if at >= size:
            break
    return None

"""``filetree``: a Python data source that lists a directory tree, hidden and empty files included.

The driver opens folders breadth first until there are ``PARTS`` of them; each folder it did not
open is one partition with all that lies below, each folder it opened one for its own files
(several, by a hash of the names, beyond ``FLAT`` entries). So neither one large subfolder nor a
flat root of millions of files is one task, and the plan stays small. Unreadable directories are
skipped, as are names that are no UTF-8 (no string could open them); a root that does not exist gives no rows. Symbolic links are listed and only followed
on request (``followSymlinks``: each real directory once, in one task). The listing ends early
once the file named by the option ``cancel`` exists; it waits while the file named by ``control`` says
PAUSED and ends once that says STOPPED.

As a stream (``readStream``) it gives the tree in bounded batches: the walk has one order, by names from the
root down, and an offset is the path it has come to, so a restarted query goes on behind that path
and no file comes twice or is left out. A batch admits ``filesPerTask`` entries (64) for each of
``tasksPerBatch`` tasks (16); the next one is asked for when it is done, and none while the control says
PAUSED or STOPPED. What is added before that path later on is for the next scan. ``processAllAvailable``
waits for the end of the tree.
"""

from __future__ import annotations

import ctypes
import os
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache
from itertools import islice
from urllib.parse import quote_from_bytes, unquote_to_bytes

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from filelake.operators.control import Control, Gate

SCHEMA = "path string, parent string, relative string, kind string, size long, mtime timestamp, created timestamp, is_link boolean, depth int"
PARTS = 128
FLAT = 20_000


@lru_cache(maxsize=1)
def _statx():  # noqa: ANN202
    call = getattr(ctypes.CDLL(None, use_errno=True), "statx", None)
    if call is not None:
        call.argtypes = [ctypes.c_int, ctypes.c_char_p, ctypes.c_int, ctypes.c_uint, ctypes.c_void_p]
    return call


def birth_time(path: str, st: os.stat_result, follow: bool) -> int | None:
    """Nanoseconds at which the file was made, None where the system keeps no such time. Never the inode's change time."""
    if (own := getattr(st, "st_birthtime", None)) is not None:
        return int(own * 1e9)
    call, room = _statx(), ctypes.create_string_buffer(256)
    at_fdcwd, no_follow, birth = -100, 0x100, 0x800
    if call is None or call(at_fdcwd, os.fsencode(path), 0 if follow else no_follow, birth, room):
        return None
    mask, seconds, nanos = struct.unpack_from("<I", room, 0)[0], *struct.unpack_from("<qI", room, 80)
    return seconds * 1_000_000_000 + nanos if mask & birth and seconds else None


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options.get("path", ""), str(self.options.get("followSymlinks", "false")).lower() == "true", self.options.get("cancel"), self.options.get("control"))


    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        number = lambda name, least: int(self.options.get(name, least))
        return _StreamReader(self.options.get("path", ""), self.options.get("control"), number("filesPerTask", 64), number("tasksPerBatch", 16))


class _Reader(DataSourceReader):
    def __init__(self, root: str, follow: bool, cancel: str | None = None, control: str | None = None) -> None:
        self.root, self.follow, self.cancel, self.control = root.rstrip("/") or "/", follow, cancel, control

    def _is_dir(self, path: str) -> bool:
        return os.path.isdir(path) and (self.follow or not os.path.islink(path))

    def partitions(self) -> list[InputPartition]:
        """(folder, whole tree or not, share, shares)."""
        if not os.path.isdir(self.root):
            return [InputPartition(None)]
        if self.follow:
            return [InputPartition((self.root, True, 0, 1))]
        todo, flat, gate = deque([self.root]), [], Gate(self.control)
        while todo and len(todo) + len(flat) < PARTS and gate.go_on():
            folder, n = todo.popleft(), 0
            try:
                with os.scandir(folder) as entries:
                    for e in entries:
                        n += 1
                        if e.is_dir(follow_symlinks=False):
                            todo.append(e.path)
            except OSError:
                n = 0
            shares = 1 + n // FLAT
            flat += [InputPartition((folder, False, k, shares)) for k in range(shares)]
        return flat + [InputPartition((folder, True, 0, 1)) for folder in todo]

    def _row(self, path: str) -> tuple | None:
        try:
            path.encode("utf-8")
            st = os.stat(path) if self.follow else os.lstat(path)
        except (OSError, UnicodeEncodeError):
            return None
        when = lambda ns: None if ns is None else datetime.fromtimestamp(ns // 1000 / 1e6, timezone.utc)
        rel = os.path.relpath(path, self.root)
        return (
            path, os.path.dirname(path), rel, "dir" if self._is_dir(path) else "file", st.st_size, when(st.st_mtime_ns),
            when(birth_time(path, st, self.follow)), os.path.islink(path), rel.count("/") + 1,
        )

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        folder, deep, share, shares = partition.value
        stack, seen, n, gate = [folder], set(), 0, Gate(self.control)
        while stack and gate.go_on():
            path = stack.pop()
            n += 1
            if self.cancel and n % 256 == 1 and os.path.exists(self.cancel):
                return
            is_dir = self._is_dir(path)
            if path != self.root and (not is_dir or share == 0) and (row := self._row(path)):
                yield row
            if not is_dir or not (deep or path == folder):
                continue
            real = os.path.realpath(path)
            if real in seen:
                continue
            seen.add(real)
            try:
                below = [os.path.join(path, x) for x in sorted(os.listdir(path), reverse=True)]
            except OSError:
                continue
            if not deep:
                below = [x for x in below if zlib.crc32(os.fsencode(x)) % shares == share and not self._is_dir(x)]
            stack += below


def walk_after(root: str, cursor: str) -> Iterator[str]:
    """Relative paths of all entries behind ``cursor`` ("": all) in the order of the walk: a folder, what is in it, then its next sibling."""
    def names(folder: str, least: str | None) -> list[str]:
        try:
            found = sorted(os.listdir(os.path.join(root, folder)), reverse=True)
        except OSError:
            return []
        return found if least is None else [x for x in found if x > least]

    stack, folder = [], ""
    for part in cursor.split("/") if cursor else []:  # what is left of each folder on the way
        stack.append((folder, names(folder, part)))
        folder = f"{folder}/{part}" if folder else part
    at = os.path.join(root, folder)
    if os.path.isdir(at) and not os.path.islink(at):
        stack.append((folder, names(folder, None)))
    while stack:
        folder, left = stack[-1]
        if not left:
            stack.pop()
            continue
        name = left.pop()
        path = f"{folder}/{name}" if folder else name
        yield path
        at = os.path.join(root, path)
        if os.path.isdir(at) and not os.path.islink(at):
            stack.append((path, names(path, None)))


class _StreamReader(DataSourceStreamReader):
    """Runs in the driver's Python: it walks names and deals them out; tasks look at the files."""

    def __init__(self, root: str, control: str | None, each: int, tasks: int) -> None:
        self.rows, self.control, self.each, self.tasks = _Reader(root, False), control, each, tasks
        self.at: dict | None = None
        self.next: tuple[dict, dict, list[str]] | None = None  # (start, end, paths) of the batch that is offered
        self.walk: tuple[dict, Iterator[str]] | None = None  # a walk that stands at an offset

    def initialOffset(self) -> dict:  # noqa: N802
        return {"path": "", "entries": 0}

    def _path(self, offset: dict) -> str:
        return os.fsdecode(unquote_to_bytes(offset["path"]))

    def _from(self, offset: dict) -> Iterator[str]:
        if self.walk is None or self.walk[0] != offset:
            self.walk = (offset, walk_after(self.rows.root, self._path(offset)))
        return self.walk[1]

    def latestOffset(self) -> dict:  # noqa: N802
        start = self.at or self.initialOffset()
        if self.next is not None and self.next[0] == start and self.next[2]:
            return self.next[1]
        if self.control and Control(self.control).state != "RUNNING":
            return start
        paths = list(islice(self._from(start), self.each * self.tasks))
        end = {"path": quote_from_bytes(os.fsencode(paths[-1])), "entries": start["entries"] + len(paths)} if paths else start
        self.walk = (end, self.walk[1]) if paths else None
        self.next = (start, end, paths)
        return end

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        if start == end:  # a restarted query tells where it stands
            return []
        if self.next is not None and self.next[:2] == (start, end):
            paths = self.next[2]
        else:  # a batch of the log is repeated
            last, paths = self._path(end).split("/"), []
            for path in walk_after(self.rows.root, self._path(start)):
                if path.split("/") > last:
                    break
                paths.append(path)
        return [InputPartition(tuple(paths[k : k + self.each])) for k in range(0, len(paths), self.each)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            if row := self.rows._row(os.path.join(self.rows.root, path)):
                yield row

    def commit(self, end: dict) -> None:
        pass

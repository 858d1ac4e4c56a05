"""``jsonreport``: a sink that writes rows as parts of a JSON array, in the order of the data frame's partitions.

Each task writes the entries of its partition under a name of its own; only the parts of attempts
that succeeded are named in the list that the commit leaves, and an aborted write leaves nothing.
``stitch`` puts lists together into one document by copying bytes, so no row passes the driver.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from filelake.session import ship

LIST = "_list.json"


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class JsonReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonreport"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        name, n = f"part-{uuid.uuid4().hex}", 0
        with open(f"{self.folder}/{name}", "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(("," if n else "") + "\n" + entry(row))
                n += 1
        return Part(TaskContext.get().partitionId(), name, n)

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        parts = sorted((m.partition, m.name) for m in messages if m is not None and m.rows)
        with open(f"{self.folder}/{LIST}", "w", encoding="utf-8") as f:
            json.dump([name for _, name in parts], f)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def entry(row: Row) -> str:
    """One object; nulls are left out."""
    return json.dumps({c: v for c, v in row.asDict().items() if v is not None}, ensure_ascii=False, default=str)


def write_list(rows: DataFrame, folder: str) -> None:
    """The rows as parts below ``folder``."""
    ship(rows.sparkSession).dataSource.register(JsonReport)
    rows.write.format("jsonreport").mode("append").save(folder)


def copy_list(folder: str, out: BinaryIO) -> None:
    """The array of a written list."""
    with open(f"{folder}/{LIST}", encoding="utf-8") as f:
        names = json.load(f)
    out.write(b"[")
    for k, name in enumerate(names):
        out.write(b"," if k else b"")
        with open(f"{folder}/{name}", "rb") as part:
            shutil.copyfileobj(part, out, 1 << 20)
    out.write(b"\n]")


def write_document(path: str, head: dict, lists: dict[str, DataFrame]) -> None:
    """One JSON object: ``head``, then each list in its order; it takes its name only when whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    work = f"{os.path.abspath(path)}.parts-{uuid.uuid4().hex}"
    try:
        for k, rows in enumerate(lists.values()):
            write_list(rows, f"{work}/{k}")
        with open(f"{work}.tmp", "wb") as out:
            out.write(json.dumps(head, ensure_ascii=False, default=str)[:-1].encode("utf-8"))
            for k, name in enumerate(lists):
                out.write(f', "{name}": '.encode())
                copy_list(f"{work}/{k}", out)
            out.write(b"}\n")
        os.replace(f"{work}.tmp", path)
    finally:
        shutil.rmtree(work, ignore_errors=True)
        if os.path.exists(f"{work}.tmp"):
            os.remove(f"{work}.tmp")

"""CSV members of zip archives as a data source: one partition a member, streamed by the executors.

``spark.dataSource.register(ZipMembers)``, then ``spark.read.format("zip_members").option("path", "/data/*.zip")
.option("member", "plays.csv").option("columns", '["a", "b"]').load()``. Only the archives' directories are read to plan. A member is
unpacked as it is read, a block of rows at a time, whatever its size; an archive of many members is read by many tasks.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 10_000


def _store(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (stores.LocalFileSystem(), path)


def wanted(name: str, member: str) -> bool:
    """A file whose name ends with ``member``, and no resource fork of another system's archiver."""
    return name.endswith(member) and not name.startswith("__MACOSX") and not name.rpartition("/")[2].startswith("._")


class ZipMembers(DataSource):
    """Options: path (the last part may be a pattern), member (the end of its name), columns (a JSON list of header names), encoding (utf-8)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.member = options["path"], options.get("member", ".csv")
        self.columns, self.encoding = json.loads(options["columns"]), options.get("encoding", "utf-8-sig")

    def partitions(self) -> list[InputPartition]:
        folder, _, pattern = self.path.rpartition("/")
        store, at = _store(folder or ".")
        files = sorted(f.path for f in store.get_file_info(stores.FileSelector(at)) if f.is_file and fnmatch.fnmatch(f.base_name, pattern))
        found = []
        for file in files:
            with store.open_input_file(file) as stream, zipfile.ZipFile(stream) as archive:
                found += [InputPartition((file, m.filename)) for m in archive.infolist() if not m.is_dir() and wanted(m.filename, self.member)]
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        file, member = partition.value
        store, _ = _store(self.path.rpartition("/")[0] or ".")
        with store.open_input_file(file) as stream, zipfile.ZipFile(stream) as archive, archive.open(member) as raw:
            lines = csv.reader(io.TextIOWrapper(raw, encoding=self.encoding, newline=""))
            header = next(lines, [])
            places = [header.index(c) if c in header else None for c in self.columns]
            held: list[list[str]] = []
            for row in lines:
                held.append(row)
                if len(held) == ROWS:
                    yield self._batch(held, places)
                    held = []
            if held:
                yield self._batch(held, places)

    def _batch(self, rows: list[list[str]], places: list[int | None]) -> pa.RecordBatch:
        """Columns by name; fields that a row or the header lacks, and empty ones, are null."""
        column = lambda p: [None if p is None or p >= len(r) or r[p] == "" else r[p] for r in rows]
        return pa.record_batch([pa.array(column(p), pa.string()) for p in places], self.columns)

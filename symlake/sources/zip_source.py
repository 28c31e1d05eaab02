"""Archives as a data source: entries are rows, read by ranges.

An archive larger than ``PART`` bytes is planned from its central directory, and its entries are dealt over partitions of about that size;
smaller ones are read whole, several to a partition, so planning opens large archives only. Filters on the entry's name are pushed down:
what they exclude is neither read nor unpacked. A task reads the ranges of its own entries.
"""

from __future__ import annotations

import os
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

NAME = "archive_entries"
COLUMNS = "archive string, entry string, depth int, content binary"
PART = 32 << 20
#: Bytes of unpacked entries in an Arrow batch.
BATCH = 8 << 20
_FIELDS = [("archive", pa.string()), ("entry", pa.string()), ("depth", pa.int32()), ("content", pa.binary())]
#: What opening a file that is no archive raises.
BROKEN = (zipfile.BadZipFile, pa.ArrowInvalid)
#: Schemes that Python can open (fixed values); others are left to Spark's own readers.
SCHEMES = ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")


def readable(path: str) -> bool:
    scheme = path.partition(":")[0] if ":" in path.partition("/")[0] else ""
    return scheme in SCHEMES


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if ":" in path.partition("/")[0]:
        return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _open(path: str) -> BinaryIO:
    system, place = _system(path)
    return open(place, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)


def _archives(path: str) -> list[tuple[str, int]]:
    """(path, size) of an archive, or of all below a directory."""
    system, place = _system(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    prefix = path.partition("://")[0] + "://" if "://" in path else "file://"
    return sorted((prefix + i.path, i.size) for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".jar", ".war", ".ear")))


def safe_entry(name: str) -> bool:
    """Whether an entry stays below the directory that it is unpacked to."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return not (clean.startswith(("/", "../")) or clean == ".." or ":" in clean.split("/")[0])


#: How filters on the entry's name decide.
TESTS: dict[type, Callable[[Filter, str], bool]] = {
    EqualTo: lambda f, name: name == f.value,
    In: lambda f, name: name in f.value,
    IsNotNull: lambda f, name: True,
    StringStartsWith: lambda f, name: name.startswith(f.value),
    StringEndsWith: lambda f, name: name.endswith(f.value),
    StringContains: lambda f, name: f.value in name,
}


class Part(InputPartition):
    """Archives with the names to read of each; None stands for all that the filters leave."""

    def __init__(self, archives: list[tuple[str, list[str] | None]]) -> None:
        self.archives = archives


class EntryReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths, self.filters = paths, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 a name of the interface
        for f in filters:
            if type(f) in TESTS and f.attribute == ("entry",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, info: zipfile.ZipInfo) -> bool:
        return not info.is_dir() and safe_entry(info.filename) and all(TESTS[type(f)](f, info.filename) for f in self.filters)

    def _infos(self, z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return sorted(filter(self._wanted, z.infolist()), key=lambda i: i.filename)

    def partitions(self) -> list[Part]:
        out, small, size = [], [], 0
        for path, own in (a for p in self.paths for a in _archives(p)):
            if own <= PART:
                if small and size + own > PART:
                    out.append(Part(small))
                    small, size = [], 0
                small.append((path, None))
                size += own
                continue
            try:
                with _open(path) as f, zipfile.ZipFile(f) as z:
                    infos = self._infos(z)
            except BROKEN:
                continue
            names, held = [], 0
            for info in infos:
                if names and held + info.compress_size > PART:
                    out.append(Part([(path, names)]))
                    names, held = [], 0
                names.append(info.filename)
                held += info.compress_size
            if names:
                out.append(Part([(path, names)]))
        return out + ([Part(small)] if small else [])

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str, int, bytes]] = []
        size = 0
        for path, names in partition.archives:
            try:
                with _open(path) as f, zipfile.ZipFile(f) as z:
                    for name in names if names is not None else [i.filename for i in self._infos(z)]:
                        try:
                            content = z.read(name)
                        except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, EOFError):
                            continue  # a broken entry is passed over
                        rows.append((path, name, 0, content))
                        size += len(content)
                        if size >= BATCH:
                            yield _batch(rows)
                            rows, size = [], 0
            except BROKEN:
                continue
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


class EntrySource(DataSource):
    """Options: paths, archives or directories, one a line."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: object) -> EntryReader:
        return EntryReader(self.options["paths"].split("\n"))


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(archive, entry, depth, content) of the entries of archives, or of those below directories; broken archives give none.

    Turns on the session's filter push-down for Python sources, without which Spark refuses sources that take filters.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EntrySource)
    return spark.read.format(NAME).option("paths", "\n".join([paths] if isinstance(paths, str) else paths)).load()

"""Zip archives as a data source: an archive's directory is dealt into ranges of entries, and each task seeks to its own.

spark.dataSource.register(ZipSource) once, then spark.read.format("zip_entries").load(path); read_archives does both. Paths are what pyarrow's file systems
open: a local or mounted folder, file://, s3://, gs:// and, where its client library is there, hdfs://. To plan, an archive's directory is read once, a record at a time;
a task reads its own part of it.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, ord long, name string, bytes long, content binary"
#: Uncompressed bytes of a range; an entry is never split.
RANGE_BYTES = 64 << 20


class Entries(InputPartition):
    """Entries begin to end of an archive, whose part of its directory lies at bytes at to stop; shift is what precedes the archive in its file."""

    def __init__(self, path: str, begin: int, end: int, at: int = 0, stop: int = 0, shift: int = 0) -> None:
        self.path, self.begin, self.end, self.at, self.stop, self.shift = path, begin, end, at, stop, shift


def _open(path: str) -> tuple[Any, str]:
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


class _Seekable(io.RawIOBase):
    """A file of pyarrow's whose seeks before its begin fail as zipfile expects them to."""

    def __init__(self, f: Any) -> None:
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.f.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        try:
            return self.f.seek(offset, whence)
        except ValueError as e:
            raise OSError(str(e)) from e

    def readinto(self, out: Any) -> int:
        got = self.f.read(len(out))
        out[: len(got)] = got
        return len(got)


_RECORD = struct.Struct("<4s4B4HL2L5H2L")  # of an entry in the directory, before its name


def _directory(f: Any) -> tuple[int, int, int]:
    """Where an archive's directory begins and ends in its file, and how many bytes precede the archive there."""
    end = zipfile._EndRecData(f)
    if not end:
        raise zipfile.BadZipFile("File is not a zip file")
    size, offset, shift = end[5], end[6], end[9] - end[5] - end[6] - (76 if end[0] == b"PK\x06\x06" else 0)  # 76: the records of 64-bit archives
    return offset + shift, offset + shift + size, shift


def _record(f: Any) -> tuple[int, int]:
    """The content's size and the record's own length of the entry whose record f is at; f is then at the next."""
    head = _RECORD.unpack(f.read(_RECORD.size))
    if head[0] != b"PK\x01\x02":
        raise zipfile.BadZipFile("Bad magic number for central directory")
    size, name, extra, comment = head[11], *head[12:15]
    rest, at = f.read(name + extra + comment)[name : name + extra], 0
    while size == 0xFFFFFFFF and at + 12 <= len(rest):
        kind, length = struct.unpack_from("<HH", rest, at)
        if kind == 1:
            size = struct.unpack_from("<Q", rest, at + 4)[0]
        at += 4 + length
    return size, _RECORD.size + name + extra + comment


def _end(size: int, entries: int) -> bytes:
    """The end record of an archive that is a directory of so many bytes alone."""
    return struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, entries & 0xFFFF, entries & 0xFFFF, size, 0, 0)


#: Ranges beyond so many share tasks, each a run of neighbours; and the entries of such a task.
TASKS, TASK_ENTRIES = 64, 50_000


def _dealt(found: list[Entries]) -> list[Entries]:
    """Ranges, or runs of neighbouring ones of one archive where there are more than TASKS: starting a task costs more than reading a small range."""
    most, out, held = -(-len(found) // TASKS), [], 0
    for x in found:
        last = out[-1] if out else None
        if last and held < most and last.path == x.path and x.end - last.begin <= TASK_ENTRIES:
            out[-1], held = Entries(x.path, last.begin, x.end, last.at, x.stop, x.shift), held + 1
        else:
            out.append(x)
            held = 1
    return out


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def _archives(self) -> list[str]:
        from pyarrow.fs import FileSelector, FileType

        fs, at = _open(self.path)
        scheme = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        if fs.get_file_info(at).type == FileType.File:
            return [self.path]
        found = fs.get_file_info(FileSelector(at, recursive=True))
        return sorted(scheme + i.path for i in found if i.type == FileType.File and i.path.lower().endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self._archives():
            fs, at = _open(path)
            with fs.open_input_file(at) as f:
                held_file = io.BufferedReader(_Seekable(f), 1 << 20)
                place, stop, shift = _directory(held_file)
                held_file.seek(place)
                begin, first, held, k = 0, place, 0, 0
                while place < stop:  # a record at a time: only the ranges are kept
                    size, length = _record(held_file)
                    if k > begin and held + size > self.range_bytes:
                        out.append(Entries(path, begin, k, first, place, shift))
                        begin, first, held = k, place, 0
                    held, place, k = held + size, place + length, k + 1
            if k > begin:
                out.append(Entries(path, begin, k, first, stop, shift))
        return _dealt(out) or [Entries("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[Any, ...]]:
        if partition.begin >= partition.end:
            return
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as f:
            f.seek(partition.at)
            part = f.read(partition.stop - partition.at)
            with zipfile.ZipFile(io.BytesIO(part + _end(len(part), partition.end - partition.begin))) as own:
                infos = own.infolist()
            with zipfile.ZipFile(io.BytesIO(_end(0, 0))) as z:
                z.fp = io.BufferedReader(_Seekable(f))  # contents are read from the archive itself
                for k, info in enumerate(infos, partition.begin):
                    info.header_offset, info._end_offset = info.header_offset + partition.shift, None
                    if not info.is_dir():
                        yield partition.path.rsplit("/", 1)[-1], k, info.filename, info.file_size, z.read(info)


class ZipSource(DataSource):
    """The entries of zip files: archive, ord (place in its directory), name, bytes, content."""

    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return ZipReader(dict(self.options))


def read_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ZipSource)
    return spark.read.format("zip_entries").option("rangeBytes", str(range_bytes)).load(path)


def labels_and_images(entries: DataFrame) -> DataFrame:
    """(archive, kind, stem, content) of entries: labels and images; the first of a stem and kind in an archive counts."""
    base = F.element_at(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), -1)
    rows = entries.withColumn("_base", base).withColumn("stem", F.regexp_extract("_base", r"^(.+)\.[^.]*$", 1)).withColumn("_ext", F.lower(F.regexp_extract("_base", r"\.([^.]*)$", 1)))
    kind = F.when(F.col("_ext") == "txt", "label").when(F.col("_ext").isin("jpg", "jpeg", "png"), "image")
    rows = rows.withColumn("kind", kind).where("kind is not null and stem <> ''").where(~F.col("_base").isin("classes.txt", "notes.json"))
    first = Window.partitionBy("archive", "kind", "stem").orderBy("ord")
    return rows.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("archive", "kind", "stem", "content")


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """labels_and_images of the zip files under path, of any size: a task reads a range of one archive's entries."""
    return labels_and_images(read_entries(spark, path, range_bytes))

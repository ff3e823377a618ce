"""Data sources for files that Spark has no reader or writer for: members of ZIP archives, WAV headers, and one file for each row.

They are Python data sources (``spark.read.format(...)``) and open files by ranges, so neither a whole archive
nor a whole WAV file is in memory.  Paths are local ones that all executors see (a mount, ``file:``), or of a store that
pyarrow opens by its URI.
"""

from __future__ import annotations

import glob
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

#: Bytes of an archive, and of files, that one task reads, about.
SPLIT_BYTES, FILES_A_TASK = 64 << 20, 256
#: Bytes of a WAV file that are read at a time while its header is walked.
HEAD_BYTES = 256


def _local(path: str) -> str | None:
    """The path in the file system of this machine, null for another store."""
    if "://" not in path and not path.startswith("file:"):
        return path
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def opened(path: str):
    """A seekable file of bytes."""
    at = _local(path)
    if at is not None:
        return open(at, "rb")
    import pyarrow.fs as fs

    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def listed(folder: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of the files in ``folder`` and below with an ``ending``, in order; those in folders of unfinished writes are left out."""
    at = _local(folder)
    if at is not None:
        paths = sorted(p for p in glob.glob(f"{glob.escape(at)}/**/*{ending}", recursive=True) if not any(part.startswith("_") for part in os.path.relpath(p, at).split("/")))
        return [(p, os.path.getsize(p)) for p in paths]
    import pyarrow.fs as fs

    store, inside = fs.FileSystem.from_uri(folder)
    scheme = folder.split("://", 1)[0] + "://"
    return sorted((scheme + x.path.lstrip("/"), x.size) for x in store.get_file_info(fs.FileSelector(inside, recursive=True)) if x.is_file and x.path.endswith(ending))


# --- members of archives ----------------------------------------------------------------


@dataclass
class Stretch(InputPartition):
    """Members of an archive whose headers begin at bytes ``low`` to ``high`` - 1."""

    path: str
    low: int
    high: int


class _MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.ending, self.split = options["path"], options.get("ending", ""), int(options.get("split", SPLIT_BYTES))

    def partitions(self) -> list[Stretch]:
        return [Stretch(path, low, low + self.split) for path, size in listed(self.folder, ".zip") for low in range(0, max(1, size), self.split)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as file, zipfile.ZipFile(file) as bundle:  # reads the directory at the end, then members one by one
            for entry in sorted(bundle.infolist(), key=lambda e: e.header_offset):
                if part.low <= entry.header_offset < part.high and not entry.is_dir() and entry.filename.endswith(self.ending):
                    yield pa.RecordBatch.from_pydict({"archive": [part.path], "name": [entry.filename], "size": [entry.file_size], "bytes": [bundle.read(entry)]}, pa.schema([("archive", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("bytes", pa.binary())]))


class ArchiveMembers(DataSource):
    """``zipmembers``: (archive, name, size, bytes) of the members of ``path/**/*.zip`` whose names have an ``ending``.

    An archive is divided by byte ranges of ``split`` bytes; a task reads the directory at the archive's end and the members that begin in its
    range.  Archives and members beyond 4 GB (ZIP64) are read; only a member as such must fit in a row.
    """

    @classmethod
    def name(cls) -> str:
        return "zipmembers"

    def schema(self) -> str:
        return "archive string, name string, size bigint, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(dict(self.options))


# --- headers of WAV files ---------------------------------------------------------------


def wav_head(file: io.IOBase, size: int) -> dict:
    """Format, rate and frames of a WAV file of ``size`` bytes; chunks are skipped by seeking."""
    read = 0

    def at(offset: int, n: int) -> bytes:
        nonlocal read
        file.seek(offset)
        data = file.read(n)
        read += len(data)
        return data

    head = at(0, HEAD_BYTES)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    start, offset, form = 0, 12, None
    while offset + 8 <= size:
        if offset + 48 > start + len(head):
            start, head = offset, at(offset, HEAD_BYTES)
        own = head[offset - start :]
        kind, length = own[:4], int.from_bytes(own[4:8], "little")
        if kind == b"fmt ":
            form = own[8:24]
        elif kind == b"data":
            if form is None or len(form) < 16:
                break
            code, channels, rate, bits = (int.from_bytes(form[a:b], "little") for a, b in ((0, 2), (2, 4), (4, 8), (14, 16)))
            if not channels or not rate or bits < 8:
                break
            frames = min(length, size - offset - 8) // (channels * bits // 8)
            return {"format": code, "channels": channels, "sr": rate, "bits": bits, "frames": frames, "seconds": frames / rate, "bytes_read": read}
        offset += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


_COMPARE = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}
_HEAD = pa.schema([("path", pa.string()), ("size", pa.int64()), ("format", pa.int32()), ("channels", pa.int32()), ("sr", pa.int32()), ("bits", pa.int32()), ("frames", pa.int64()), ("seconds", pa.float64()), ("bytes_read", pa.int64())])


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.tests = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in _HEAD.names[1:]:
                self.tests.append((type(f), f.attribute[0], f.value))
            elif not isinstance(f, IsNotNull):  # no column is null
                yield f

    def partitions(self) -> list[Files]:
        files = listed(self.folder, ".wav")
        sizes = [t for t in self.tests if t[1] == "size"]  # what the listing tells already
        files = [x for x in files if all(_COMPARE[kind](x[1], value) for kind, _, value in sizes)]
        return [Files(files[i : i + FILES_A_TASK]) for i in range(0, len(files), FILES_A_TASK)] or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, size in part.files:
            with opened(path) as file:
                row = {"path": path, "size": size} | wav_head(file, size)
            if all(_COMPARE[kind](row[name], value) for kind, name, value in self.tests):
                rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, _HEAD)


class WavHeads(DataSource):
    """``wavheads``: what the headers of ``path/**/*.wav`` say, and how many bytes were read to know it.

    Comparisons with a constant are pushed to the scan (``spark.sql.python.filterPushdown.enabled``): files that fail them give no
    row, those that fail one of ``size`` aren't even opened.
    """

    @classmethod
    def name(cls) -> str:
        return "wavheads"

    def schema(self) -> str:
        return "path string, size bigint, format int, channels int, sr int, bits int, frames bigint, seconds double, bytes_read bigint"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(dict(self.options))


# --- a file for each row ----------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class _FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        folder = _local(options["path"])
        if folder is None:
            raise ValueError("files of rows are written to a mounted folder")
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.pending = f"{self.folder}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        own, count = f"{self.pending}/part-{uuid.uuid4().hex}", 0  # an attempt of its own: what a lost one leaves is never moved
        os.makedirs(own)
        for batch in iterator:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                at = os.path.normpath(f"{own}/{path}")
                if path is None or data is None or not at.startswith(f"{own}/"):
                    raise ValueError(f"no bytes, or no path inside the folder: {path}")
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "xb") as file:
                    file.write(data)
                count += 1
        return Written(own, count)

    def commit(self, messages: list[Written | None]) -> None:
        old = [e.path for e in os.scandir(self.folder) if e.name.startswith("part-")] if self.overwrite else []
        for message in messages:
            if message and message.files:
                os.rename(message.folder, f"{self.folder}/{os.path.basename(message.folder)}")
        for path in old:
            shutil.rmtree(path)
        shutil.rmtree(self.pending, ignore_errors=True)
        with open(f"{self.folder}/_SUCCESS", "w"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class RowFiles(DataSource):
    """``rowfiles``: writes ``bytes`` of each row to the file ``path`` (relative) below the folder given to ``save``.

    Tasks write to a folder of unfinished work, which readers skip; a folder for each task is renamed into place when the job commits, and all
    are removed when it fails.  One path twice in a task is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "rowfiles"

    def schema(self) -> str:
        return "path string, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if schema.fieldNames() != ["path", "bytes"]:
            raise ValueError("rows need the columns path and bytes")
        return _FileWriter(dict(self.options), overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """``spark``, knowing the sources of this module and pushing filters to them."""
    for source in (ArchiveMembers, WavHeads, RowFiles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """``rows`` (path, bytes) as files below ``folder``."""
    registered(rows.sparkSession)
    rows.select("path", "bytes").write.format("rowfiles").mode(mode).save(folder)


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``.

    Where that is unset, a local one does if the executors are threads of the driver; it is an error otherwise.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.gettempdir()
    return f"{found.rstrip('/')}/sonoquery-files-{uuid.uuid4().hex}"

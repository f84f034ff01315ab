"""Subtitle files as a data source: ``spark.read.format("cues")`` and ``df.write.format("cues")``.

Reading lists .srt and .vtt files under a path, deals them into partitions of about
``bytesPerPartition`` and parses each file where it is read; rows are (path, cue_idx,
start_s, end_s, text).

Writing takes (name, document) and makes one file a row, ``<name>.<suffix>``.  A task writes
under a folder of its own; the driver moves the files to their places once all tasks are
done, and deletes the job's folder if one fails, so no half file is ever seen.  A name
that comes twice fails the job before anything is moved.

Stores are those that pyarrow opens by URI; a plain path is a folder that all executors share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from skriva.sources.transcripts import CUE

PARTITION_BYTES = 32 << 20
SUFFIXES = (".srt", ".vtt")
SCHEMA = "path string, cue_idx int, start_s double, end_s double, text string"
_ARROW = pa.schema([("path", pa.string()), ("cue_idx", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("text", pa.string())])
_PENDING = "_pending"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def cues_of(raw: str) -> Iterator[tuple[int, float, float, str]]:
    """(cue_idx, start_s, end_s, text) of one text."""
    for k, found in enumerate(re.finditer(CUE, raw.replace("\r\n", "\n"))):
        h0, m0, s0, ms0, h1, m1, s1, ms1, said = found.groups("0")
        yield k, int(h0) * 3600 + int(m0) * 60 + int(s0) + int(ms0) / 1000.0, int(h1) * 3600 + int(m1) * 60 + int(s1) + int(ms1) / 1000.0, said.rstrip("\n")


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


@dataclass
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # where each is, and its name


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int):
        self.path, self.limit = path, limit

    def partitions(self) -> Sequence[InputPartition]:
        store, top = _store(self.path)
        found = store.get_file_info(top)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES) and f"/{_PENDING}" not in f.path)
        groups: list[list[str]] = [[]]
        held = 0
        for path, size in files:
            if groups[-1] and held + size > self.limit:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Files(tuple(g)) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                rows = [(path, *c) for c in cues_of(f.read().decode("utf-8-sig", errors="replace"))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_ARROW.types)], schema=_ARROW)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path, suffix, overwrite
        self.job = f"{_PENDING}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, top = _store(self.path)
        own = f"{top}/{self.job}/{uuid.uuid4().hex}"  # an attempt's own
        store.create_dir(own, recursive=True)
        files = []
        for k, (name, document) in enumerate(iterator):
            to = f"{'__null__' if name is None else quote(str(name), safe=' ')}.{self.suffix}"
            with store.open_output_stream(f"{own}/{k}") as f:
                f.write((document or "").encode())
            files.append((f"{own}/{k}", to))
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [to for _, to in files]
        if len(set(names)) < len(names):
            store.delete_dir(f"{top}/{self.job}")
            raise ValueError("a name comes twice: one row a file is wanted")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top)):
                if f.type == fs.FileType.File and f.path.endswith(f".{self.suffix}"):
                    store.delete_file(f.path)
        for at, to in files:
            store.move(at, f"{top}/{to}")
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        store, top = _store(self.path)
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")


class Cues(DataSource):
    """Options: path, bytesPerPartition (reading), suffix (writing: srt or vtt)."""

    @classmethod
    def name(cls) -> str:
        return "cues"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("format cues needs a path")
        return self.options["path"].rstrip("/")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._path(), int(self.options.get("bytesPerPartition", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        suffix = self.options.get("suffix", "srt")
        if f".{suffix}" not in SUFFIXES or len(schema.fields) != 2:
            raise ValueError("format cues writes (name, document) as srt or vtt")
        return _Writer(self._path(), suffix, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Cues)

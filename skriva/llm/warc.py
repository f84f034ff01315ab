"""WARC archives as seekable Zstandard bundles.

Writing.  Payload digests (SHA-1) decide which record carries a payload: of equal
payloads of at least ``min_revisit`` bytes the one with the smallest id is a response,
the others are revisits that name it.  Each task sorts its records by id, groups them
into Zstandard frames of about FRAME bytes that decode on their own, and closes a bundle
at about BUNDLE bytes with a skippable frame: the seek table (compressed and plain size
of every frame) and its footer.  A bundle is written under a temporary name and renamed,
and its name and content follow from the partition alone, so a task that runs again
replaces it by the same bytes.  The index maps every record to (bundle, frame, offset
inside the frame, length).

Reading.  Bundles are read as binary files by Spark, so any store it reads will do; the
footer gives the frames, each is decoded by itself and its records are parsed.  With an
index, ``lookup`` decodes only the frames that hold the wanted records.

The folder must be one that all executors share and that pyarrow can write (local or
mounted paths, hdfs, s3, gcs).

Cases: a null html is an empty payload; a null url leaves out the target; a row without
id takes no part in deduplication, is always a response and comes back with a null id.
Rows that repeat an id with the same payload are all responses if that id is the
smallest.  An empty table writes no bundle and reads back no rows.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skriva.llm.support import cut, shared_dir, small_side

FRAME, BUNDLE = 256 << 10, 32 << 20
#: Fixed values of the seekable format: skippable frame, seek table.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "id string, bundle string, frame int, at bigint, size bigint"
RECORD = "id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, sound boolean"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rid: str | None, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head.append(f"WARC-Record-ID: <urn:record:{rid}>" if rid is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest(payload)}')}>")
    head.append(f"WARC-Date: {DATE}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:record:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0, stop: int | None = None) -> Iterator[dict]:
    """The records of a decoded frame from ``at`` on."""
    stop = len(data) if stop is None else stop
    while at < stop:
        body = data.index(b"\r\n\r\n", at) + 4
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in data[at:body].decode().split("\r\n")[1:] if x)}
        end = body + int(head["content-length"])
        text = data.index(b"\r\n\r\n", body, end) + 4
        size = int(re.search(rb"\r\nContent-Length: (\d+)", data[body - 2 : text])[1])
        name = head["warc-record-id"]
        kind, sha = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
        payload = data[text:end] if kind == "response" else None
        yield {
            "id": name[len("<urn:record:") : -1] if name.startswith("<urn:record:") else None, "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": sha, "record_type": kind,
            "refers_to": head["warc-refers-to"][len("<urn:record:") : -1] if kind == "revisit" else None, "payload": payload, "sound": payload is None or len(payload) == size and digest(payload) == sha,
        }
        at = end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries)) + entries


def frames(bundle: bytes) -> list[tuple[int, int, int]]:
    """(begin, compressed size, plain size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    step = 12 if flags & 0x80 else 8
    at, out = len(bundle) - 9 - n * step, []
    begin = 0
    for k in range(n):
        c, d = struct.unpack_from("<II", bundle, at + k * step)
        out.append((begin, c, d))
        begin += c
    return out


def frame(bundle: bytes, where: tuple[int, int, int]) -> bytes:
    begin, size, plain = where
    return zstandard.ZstdDecompressor().decompress(bundle[begin : begin + size], max_output_size=plain)


class _Bundles:
    """Writes the bundles of one task."""

    def __init__(self, folder: str, part: int) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.part, self.count, self.out = part, 0, None
        self.zstd = zstandard.ZstdCompressor(level=3)

    def _open(self) -> None:
        self.name = f"part-{self.part:05d}-{self.count:05d}.warc.zst"
        self.hidden = f"{self.root}/_{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.hidden)
        self.sizes, self.total, self.buffer, self.rows, self.done = [], 0, bytearray(), [], []
        self.count += 1

    def add(self, rid: str | None, raw: bytes) -> list[tuple]:
        if self.out is None:
            self._open()
        self.rows.append((rid, self.name, len(self.sizes), len(self.buffer), len(raw)))
        self.buffer += raw
        if len(self.buffer) >= FRAME:
            self._frame()
        return self.close() if self.total >= BUNDLE else []

    def _frame(self) -> None:
        packed = self.zstd.compress(bytes(self.buffer))
        self.out.write(packed)
        self.sizes.append((len(packed), len(self.buffer)))
        self.total += len(self.buffer)
        self.buffer.clear()

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        if self.buffer:
            self._frame()
        self.out.write(seek_table(self.sizes))
        self.out.close()
        self.fs.move(self.hidden, f"{self.root}/{self.name}")
        self.out = None
        return self.rows


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Write the archives under ``folder`` and return their index (INDEX), already made."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    sha = F.sha1("payload")
    # only payloads that occur under several ids matter, and of these only the smallest id
    least = rows.where(F.octet_length("payload") >= min_revisit).select("id", sha.alias("sha")).groupBy("sha").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    least = cut(least.where("least < most").select(F.col("sha").alias("copy_of"), "least"))
    decided = rows.withColumn("sha", sha).join(small_side(least, 64), F.col("sha") == F.col("copy_of"), "left")
    decided = decided.select(F.col("id"), F.col("id").cast("string").alias("rid"), "url", "payload", F.when(F.col("id") > F.col("least"), F.col("least").cast("string")).alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Bundles(folder, TaskContext.get().partitionId())
        for batch in batches:
            rows = []
            for rid, url, payload, refers in zip(*(batch.column(k) for k in range(1, 5)), strict=True):
                rows += out.add(rid := rid.as_py(), record(rid, url.as_py(), payload.as_py(), refers.as_py()))
            yield _index(rows)
        yield _index(out.close())

    return cut(decided.sortWithinPartitions("id", "url", "payload").mapInArrow(run, INDEX))


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["id", "bundle", "frame", "at", "size"])


def _records(found: list[dict]) -> pa.RecordBatch:
    kinds = {"id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "sound": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in kinds.items()], list(kinds))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("path", "content")


def read_bundles(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of every bundle (RECORD); ``sound``: the payload agrees with its digest and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                bundle = content.as_py()
                for where in frames(bundle):
                    found = list(parse(frame(bundle, where)))
                    yield _records(found if payloads else [r | {"payload": None} for r in found])

    return _files(spark, folder).mapInArrow(run, RECORD)


def fetch(file, places: list[dict]) -> Iterator[dict]:
    """The records at ``places`` of an open bundle: its footer and the frames that hold them are read, nothing else."""

    def part(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    total = file.size()
    n, flags, _ = struct.unpack("<IBI", part(total - 9, 9))
    table = 9 + n * (12 if flags & 0x80 else 8)
    where, open_frame, data = frames(part(total - table, table)), -1, b""
    for p in sorted(places, key=lambda p: (p["frame"], p["at"])):
        if p["frame"] != open_frame:
            open_frame, (begin, size, plain) = p["frame"], where[p["frame"]]
            data = frame(part(begin, size), (0, size, plain))
        yield from parse(data, p["at"], p["at"] + p["size"])


def lookup(spark: SparkSession, folder: str, index: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The records of ``ids`` (RECORD), read by their ranges: of other bundles and frames not a byte."""
    wanted = index.join(ids.select(F.col(id_col).cast("string").alias("id")).distinct(), "id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "at", "size")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with where.open_input_file(f"{root}/{bundle}") as file:
                    for record in fetch(file, places):
                        yield _records([record])

    return wanted.select("bundle", "places").mapInArrow(run, RECORD)


def archive_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the shared one.  It stays until its owner deletes it, as results are read from it."""
    return f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"

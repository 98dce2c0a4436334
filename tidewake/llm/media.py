"""Media columns: members of archives, read by byte ranges.

``write_archives`` stores each row's payload as one 8-bit grey-scale PNG in ZIP archives of bounded
size (members aren't compressed again). ``ArchiveMembers`` is a Spark data source over a folder of such
archives: it plans byte ranges of the archives by their sizes alone; a task reads its archive's
directory, takes the members that start in its range and streams them in Arrow batches of bounded
size. A member that can't be read or fails its checksum is tried again on its own, from its offset.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewake.llm.shared import column, materialize, shared_dir

WIDTH = 576
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
RETRIES = 3
_PNG = b"\x89PNG\r\n\x1a\n"
_STAMP = (1980, 1, 1, 0, 0, 0)


def pad(raw: bytes) -> bytes:
    """Bytes 255, which UTF-8 never has, up to a positive multiple of the row width."""
    return raw + b"\xff" * (-len(raw) % WIDTH if raw else WIDTH)


def encode_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey-scale PNG whose lines have no filter."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, body, width = 8, b"", 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        part = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width = struct.unpack(">I", part[:4])[0]
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the means of eight column bands."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    levels = np.arange(256)
    mean = float(p @ levels)
    dev = float(np.sqrt(max(0.0, p @ (levels - mean) ** 2)))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    bands = x.reshape(-1, 8, WIDTH // 8).mean((0, 2), dtype=np.float64)
    return f"{mean:.4f},{dev:.4f},{entropy:.4f}," + ",".join(f"{b:.2f}" for b in bands)


def write_archives(docs: DataFrame, uri: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every row's text (null: empty) to archives below ``uri``; returns one row for each archive.

    An archive gets its name only when it is whole, and a task that runs again makes the same ones, so
    lost executors and repeated attempts leave nothing twice. Empty input: no archive.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(uri)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        archives, z, out, n = [], None, None, 0

        def close():
            z.close()
            size = out.tell()
            out.close()
            fs.move(f"{root}/_{part}-{len(archives)}-{attempt}", name := f"{root}/part-{part:06d}-{len(archives):05d}.zip")
            archives.append((name, n, size))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if z is None:
                    out, n = fs.open_output_stream(f"{root}/_{part}-{len(archives)}-{attempt}"), 0
                    z = zipfile.ZipFile(out, "w")
                z.writestr(zipfile.ZipInfo(f"{n:08d}_{'' if doc_id.as_py() is None else doc_id.as_py()}.png", _STAMP), encode_png(pad((text.as_py() or "").encode())))
                n += 1
                if out.tell() >= archive_bytes:
                    close()
                    z = None
        if z is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": [a[0] for a in archives], "members": [a[1] for a in archives], "bytes": [a[2] for a in archives]}, pa.schema([("archive", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root)
    return materialize(docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(run, "archive string, members long, bytes long"), "manifest")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    stop: int


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(uri)``: archive, member_offset, member, media.

    Options: range_bytes, batch_bytes, retries. An archive without members or a folder without archives gives no rows.
    """

    @classmethod
    def name(cls):
        return "archive_members"

    def schema(self):
        return "archive string, member_offset long, member string, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self):
        fs, root = pafs.FileSystem.from_uri(self.uri)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".zip"))
        return [ByteRange(path, at, min(at + self.range_bytes, size)) for path, size in found for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, part):
        if not part.archive:
            return
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        open_ = lambda: fs.open_input_file(part.archive)

        def entries(f):
            return [i for i in zipfile.ZipFile(f).infolist() if part.start <= i.header_offset < part.stop]

        rows, held = [], 0
        f, directory = self._tried(open_, None, entries)
        for info in directory:
            f, media = self._tried(open_, f, lambda f, info=info: read_member(f, info))  # this member alone, from its offset
            rows.append((part.archive, info.header_offset, info.filename, media))
            held += len(media)
            if held >= self.batch_bytes:
                yield _batch(rows)
                rows, held = [], 0
        f.close()
        if rows:
            yield _batch(rows)

    def _tried(self, open_, f, action):
        """(file, what ``action`` makes of it); after an error the file is opened anew and the action repeated."""
        for tries in range(self.retries + 1):
            try:
                f = f or open_()
                return f, action(f)
            except (OSError, ValueError, zipfile.BadZipFile):
                if tries == self.retries:
                    raise
                time.sleep(0.1 * 2**tries)
                f = None


def read_member(f, info: zipfile.ZipInfo) -> bytes:
    f.seek(info.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(info.header_offset + 30 + name + extra)
    media = f.read(info.compress_size)
    if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
        raise ValueError("a member's checksum differs")
    return media


def _batch(rows):
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "member_offset", "member", "media"])


def read_archives(spark: SparkSession, uri: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**options).load(uri)


def media_digest(media: DataFrame) -> DataFrame:
    """What the stored members hold: one row for each, with the id from its name (none: null)."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for member, m in zip(batch.column(0), batch.column(1), strict=True):
                stored = m.as_py()
                payload = decode_png(stored)
                doc_id = member.as_py()[:-4].partition("_")[2]
                rows.append((int(doc_id) if doc_id else None, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in fields.split(", ")])

    return media.select("member", "media").mapInArrow(run, fields)


def stored_documents(docs: DataFrame) -> DataFrame:
    """Every text through archives in the shared folder and back.

    One row per row of ``docs``, repeated ones and null ids included; null and empty texts are 576 bytes of padding, very long ones
    are stored whole, equal texts have equal values. An empty table gives no rows. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    uri = shared_dir(spark, "media")
    write_archives(docs, uri)
    return media_digest(read_archives(spark, uri))

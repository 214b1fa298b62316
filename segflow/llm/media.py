"""Media columns: an archive data source, and texts stored as images in it."""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from segflow.llm.shared import new_folder

MEMBER_SCHEMA = "archive string, offset long, member string, payload binary"
MANIFEST = "_archives.json"
#: An archive of fewer bytes has no member (and Arrow's files refuse zipfile's search for its end).
LEAST_BYTES = 98
#: Bytes of an archive that one reading task plans for, and of payloads in one Arrow batch.
SPLIT_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
RETRIES = 3


@dataclass
class ByteRange(InputPartition):
    """The members of an archive whose headers start in [start, end)."""

    archive: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    archive: str
    members: int


class ArchiveSource(DataSource):
    """``format("archive")``: a folder of zip archives with stored (not deflated) members.

    Options: ``path``; ``split_bytes``, ``batch_bytes`` and ``retries`` for
    reading. Reading plans byte ranges of the archives that committed writes
    have listed, or of all archives in a folder without lists.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def _open_folder(path: str) -> tuple[fs.FileSystem, str]:
    system, folder = fs.FileSystem.from_uri(path)
    return system, folder.rstrip("/")


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split, self.batch = int(options.get("split_bytes", SPLIT_BYTES)), int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        system, folder = _open_folder(self.path)
        files = {f.base_name: f for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file}
        listed: list[str] | None = None
        for name in sorted(files):
            if name.endswith(MANIFEST):
                with system.open_input_stream(f"{folder}/{name}") as stream:
                    listed = (listed or []) + json.loads(stream.read())
        names = sorted(n for n in files if n.endswith(".zip")) if listed is None else sorted(listed)
        ranges = [ByteRange(n, at, min(at + self.split, files[n].size)) for n in names if files[n].size >= LEAST_BYTES for at in range(0, files[n].size, self.split)]
        return ranges or [ByteRange("", 0, 0)]

    def member(self, system: fs.FileSystem, place: str, stream, info: zipfile.ZipInfo) -> tuple[bytes, object]:
        """A member's payload, read at its offset and checked; a failure opens the archive again for this member alone."""
        for attempt in range(self.retries + 1):
            try:
                stream.seek(info.header_offset)
                head = stream.read(30)
                names, extra = struct.unpack("<HH", head[26:30])
                stream.seek(info.header_offset + 30 + names + extra)
                payload = stream.read(info.compress_size)
                if head[:4] != b"PK\x03\x04" or zlib.crc32(payload) != info.CRC:
                    raise OSError(f"{place}: the member at {info.header_offset} is damaged")
                return payload, stream
            except (OSError, struct.error):
                if attempt == self.retries:
                    raise
                stream = system.open_input_file(place)
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, folder = _open_folder(self.path)
        place = f"{folder}/{partition.archive}"
        stream = system.open_input_file(place)
        with zipfile.ZipFile(stream) as archive:
            infos = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        stream = system.open_input_file(place)
        rows, held = [], 0
        for info in sorted(infos, key=lambda i: i.header_offset):
            payload, stream = self.member(system, place, stream, info)
            rows.append((partition.archive, info.header_offset, info.filename, payload))
            held += len(payload)
            if held >= self.batch:
                yield self.rows(rows)
                rows, held = [], 0
        if rows:
            yield self.rows(rows)

    @staticmethod
    def rows(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.binary()))], ["archive", "offset", "member", "payload"])


class ArchiveWriter(DataSourceArrowWriter):
    """One archive for each task; only those of tasks that succeeded are listed, so a repeated task leaves no double rows."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written("", 0)
        system, folder = _open_folder(self.path)
        system.create_dir(folder, recursive=True)
        name, members = f"{uuid.uuid4().hex}.zip", 0
        with system.open_output_stream(f"{folder}/{name}") as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as archive:
            for batch in chain([first], iterator):
                for member, payload in zip(batch.column("member"), batch.column("payload")):
                    archive.writestr(zipfile.ZipInfo(member.as_py()), payload.as_py())
                    members += 1
        return Written(name, members)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _open_folder(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.base_name.endswith(MANIFEST):
                    system.delete_file(f.path)
        with system.open_output_stream(f"{folder}/{uuid.uuid4().hex}{MANIFEST}") as stream:
            stream.write(json.dumps([m.archive for m in messages if m and m.members]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open_folder(self.path)
        for m in messages:
            if m and m.members:
                system.delete_file(f"{folder}/{m.archive}")


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """(archive, offset, member, payload) of a folder of archives."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").options(**options).load(path)


def write_archives(members: DataFrame, path: str) -> None:
    """Store (member, payload) rows in a folder of archives."""
    members.sparkSession.dataSource.register(ArchiveSource)
    members.select("member", "payload").write.format("archive").mode("append").save(path)


WIDTH = 192
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(text: bytes) -> bytes:
    """The bytes, padded with blanks to rows of 192, as samples of an 8-bit grey PNG; a text chunk keeps their number."""
    rows = max(1, -(-len(text) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), np.uint8)  # a row begins with its filter, 0
    samples[:, 1:] = np.frombuffer(text.ljust(rows * WIDTH, b" "), np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[np.ndarray, int]:
    """The samples and the number of bytes before padding; every chunk is checked."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, size, shape = 8, [], -1, (0, 0)
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        data = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            width, rows, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey PNG")
            shape = (rows, width + 1)
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            size = int(data[6:])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape)
    if samples[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return samples[:, 1:].ravel(), size


def describe(samples: np.ndarray) -> str:
    """Mean, deviation and a 64-bit average hash of the samples' 64 stretches."""
    edges = np.arange(64) * len(samples) // 64
    means = np.add.reduceat(samples.astype(np.int64), edges) / np.diff(np.append(edges, len(samples)))
    bits = np.packbits(means > samples.mean()).tobytes().hex()
    return f"mean={samples.mean():.4f} std={samples.std():.4f} hash={bits}"


def texts_to_members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(member, payload): each text's image, named after its id (``i`` before it; nothing for a null one)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                images = [to_image(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(images, pa.binary())], ["member", "payload"])

    named = docs.select(F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("")), F.lit(".png")).alias("member"), text_col)
    return named.mapInArrow(encode, "member string, payload binary")


def media_features(members: DataFrame) -> DataFrame:
    """What the stored images hold: (member, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image in batch.column(1).to_pylist():
                samples, size = from_image(image)
                payload = samples.tobytes()
                rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), describe(samples)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]], names)

    names = ["member", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return members.select("member", "payload").mapInArrow(decode, "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def store_and_describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Store every whole text as an image in archives at ``path`` (by default a new shared folder), read them back and describe them.

    Null and empty texts are 192 blanks with no bytes of their own; a null id
    comes back as null; repeated rows are repeated members; an empty table
    gives none; other columns are ignored. Equal texts have equal images.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "media")
    write_archives(texts_to_members(docs, id_col, text_col), path)
    found = media_features(read_archives(spark, path))
    name = F.expr("substring(member, 2, length(member) - 5)")
    return found.select(F.when(F.col("member") != ".png", name).cast(docs.schema[id_col].dataType).alias(id_col), *found.columns[1:])

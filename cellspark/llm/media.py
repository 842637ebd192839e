"""Media columns: lossless images in archives, written and read by Spark data sources of our own.

Every payload becomes an 8-bit grey image (PNG) of fixed width, stored as a member of a ZIP archive. A folder of archives
is read by byte ranges: a partition is a range of one archive and has the members whose headers begin in it. Members are
read one by one at their offsets, each retried by itself, and go to Spark in Arrow batches.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import pieces, released, shared_dir, texts

#: Pixels of a row.
WIDTH = 192
#: Fixed value: the first bytes of every PNG file.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Hadoop's names of file systems, and those that Arrow knows.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs"}
MEMBERS = "doc_id long, n_bytes long, media binary"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = path.removeprefix("file:").replace("//", "", 1) if path.startswith("file://") else path.removeprefix("file:")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    scheme, rest = path.split("://", 1)
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey image of len(payload) / WIDTH rows, one sample per byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1)  # filter 0 before each row
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an 8-bit grey image without row filters; ValueError for anything else or a damaged file."""
    if media[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, size = 8, [], None
    while at < len(media):
        (length,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + length)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + length
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


@dataclass
class Archive(WriterCommitMessage):
    name: str
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    """Each task writes one archive under a name of its own; the commit lists those of the tasks that count."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archive:
        files, path = file_system(self.path)
        name, n = f"part-{uuid.uuid4().hex}.zip", 0
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for batch in iterator:
                ids, sizes, media = (batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))
                for doc_id, size, body in zip(ids, sizes, media, strict=True):
                    archive.writestr(f"{n}_{'' if doc_id is None else doc_id}_{size}.png", body)
                    n += 1
        return Archive(name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path = file_system(self.path)
        with files.open_output_stream(f"{path}/_archives") as out:
            out.write("".join(f"{m.name}\n" for m in messages if m and m.members).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path = file_system(self.path)
        for message in messages:
            if message:
                files.delete_file(f"{path}/{message.name}")


@dataclass
class Range(InputPartition):
    archive: str
    start: int
    stop: int


class Handles:
    """One open file at a time, opened again after a failure."""

    def __init__(self, files: pafs.FileSystem, path: str) -> None:
        self.files, self.path, self.handle = files, path, None

    def current(self) -> pa.NativeFile:
        if self.handle is None:
            self.handle = self.files.open_input_file(self.path)
        return self.handle

    def close(self) -> None:
        if self.handle is not None:
            self.handle.close()
        self.handle = None


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]) -> None:
        self.path = path
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 4))
        self.keep_failed = options.get("keepfailed", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        """Ranges of about range_bytes; only the archives' names and sizes are looked at."""
        files, path = file_system(self.path)
        with files.open_input_stream(f"{path}/_archives") as listing:
            names = listing.read().decode().split()
        sizes = [info.size for info in files.get_file_info([f"{path}/{n}" for n in names])]
        found = [Range(n, s, min(s + self.range_bytes, size)) for n, size in zip(names, sizes, strict=True) for s in range(0, size, self.range_bytes)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, path = file_system(self.path)
        path = f"{path}/{partition.archive}"
        with files.open_input_file(path) as handle:
            with zipfile.ZipFile(handle) as archive:  # reads the directory at its end
                members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
        rows, held = [], 0
        handles = Handles(files, path)
        try:
            for member in members:
                doc_id, size = member.filename.removesuffix(".png").split("_")[1:]
                rows.append((int(doc_id) if doc_id else None, int(size), self.member(handles, member)))
                held += member.file_size
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
        finally:
            handles.close()
        if rows:
            yield self.batch(rows)

    def member(self, handles: Handles, member: zipfile.ZipInfo) -> bytes | None:
        """One member's bytes at its offset, by the handle of the range, by a new one at each further try. A short read, a
        wrong header and a wrong checksum are failures alike."""
        for left in range(self.tries - 1, -1, -1):
            try:
                handle = handles.current()
                head = handle.read_at(30, member.header_offset)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError(f"damaged header of {member.filename} of {handles.path} at {member.header_offset}")
                skip = sum(struct.unpack_from("<HH", head, 26))
                body = handle.read_at(member.file_size, member.header_offset + 30 + skip)
                if len(body) != member.file_size or zlib.crc32(body) != member.CRC:
                    raise OSError(f"damaged member {member.filename} of {handles.path} at {member.header_offset}")
                return body
            except OSError:
                handles.close()
                if not left and not self.keep_failed:
                    raise
                time.sleep(0.05 * (self.tries - left) if left else 0)
        return None

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, media = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


class MediaArchives(DataSource):
    """spark.read.format("media_archives").load(folder): doc_id, n_bytes, media.

    Options: rangeBytes and batchBytes bound a partition and a batch, tries the reads of a member; with keepFailed, a
    member that cannot be read becomes a row with null media instead of an error.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def store_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each whole text (null: empty), as UTF-8 with bytes 32 up to a positive multiple of WIDTH, as an image."""

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            raw = [t.encode() for t in part.column("text").to_pylist()]
            media = [to_png(r + b" " * (-len(r) % WIDTH if r else WIDTH)) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    df.sparkSession.dataSource.register(MediaArchives)
    texts(df, id_col, text_col).mapInArrow(released(images), MEMBERS).write.format("media_archives").mode("append").save(path)


def load_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def feature(payload: bytes) -> str:
    """A picture's mean, spread and 16-step histogram, and a difference hash of 8 x 8 cell means, as text."""
    samples = np.frombuffer(payload, np.uint8)
    histogram = np.bincount(samples >> 4, minlength=16)
    cells = np.array([c.mean() for c in np.array_split(samples.reshape(-1, WIDTH).mean(0), 9)])
    lines = [c.mean() if len(c) else 0.0 for c in np.array_split(samples.reshape(-1, WIDTH).mean(1), 9)]
    bits = "".join("1" if d > 0 else "0" for d in (*np.diff(cells), *np.diff(lines)))
    return f"{samples.mean():.6f};{samples.std():.6f};{','.join(map(str, histogram))};{int(bits, 2):04x}"


def media_features(media: DataFrame) -> DataFrame:
    """Per member read: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 16), media_bytes,
    media_sha256, feature. A member without media (keepFailed) has null in all but the first two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, stored in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                if stored is None:
                    rows.append((doc_id, n, *[None] * 6))
                    continue
                payload = from_png(stored)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)))
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return media.mapInArrow(released(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all texts of df as archives in the shared folder, read them back and describe them; one row per row of df.

    Null texts count as empty, which is one row of spaces; null ids and repeated rows are kept; other columns are not
    carried; an empty table gives no rows.
    """
    path = shared_dir(df.sparkSession, "media")
    store_texts(df, path, id_col, text_col)
    return media_features(load_media(df.sparkSession, path))

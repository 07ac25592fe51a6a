"""Media columns: payloads stored losslessly as images in archives, read back through a Spark data source.

A payload is padded with spaces to rows of 192 bytes and stored as an 8-bit grey PNG of that width (so the
media form is itself compressed); its unpadded size is a text chunk of the image.  Each writing task packs its
images into ZIP archives without further compression, under names of its own attempt; the manifest of the
committed ones lies beside them.

``MediaArchive`` plans partitions as byte ranges of the archives, from the manifest's sizes alone: ranges of ``rangeBytes``, or of so many more
that there are no more than ``MOST_PARTITIONS`` partitions.  The manifest has a row for each archive, about one for each writing task.  A partition reads the
directories at its archives' ends, takes the members whose header starts in its ranges, and streams them in Arrow
batches of bounded bytes.  Each member is read by its own offset and checked against its checksum; a failed read
opens the archive anew and repeats that member only.

Cases.  Null text: an empty payload (one padded row).  A null doc_id stays null.  Repeated rows are members each.
Empty table: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sievewright.llm._util import materialize, shared_dir

ROW = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "_manifest.json"
MOST_PARTITIONS = 20_000


def open_files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def pad(payload: bytes) -> bytes:
    """Spaces up to a positive multiple of ROW."""
    rows = max(1, -(-len(payload) // ROW))
    return payload.ljust(rows * ROW, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, n_bytes: int) -> bytes:
    """Grey 8-bit PNG, ROW wide, every row unfiltered; samples are whole rows."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, ROW)
    raw = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"payload-bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(samples, unpadded size) of an image that ``encode_png`` made; checks every chunk."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, n_bytes, shape = 8, [], 0, None
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt":
            n_bytes = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    if shape is None or shape[0] != ROW or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("another kind of image")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(shape[1], ROW + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes(), n_bytes


def image_feature(samples: bytes) -> str:
    """Mean and deviation of the samples, their entropy, and a difference hash of 8 x 8 cell means."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(x))
    deviation = float(np.sqrt(max(0.0, (counts * level * level).sum() / len(x) - mean * mean)))
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    cells = np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[edges]) / np.maximum(np.diff(edges), 1)
    bits = np.packbits(cells[1:] > cells[:-1])
    return f"mean={mean:.4f};dev={deviation:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};dhash={bits.tobytes().hex()}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 128 << 20) -> list[dict]:
    """Writes the images of ``docs`` (doc_id, text) into ZIP archives; returns and stores the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_files(folder)
        fs.create_dir(root, recursive=True)
        task, done, box = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if box is None:
                    name = f"media-{task:05d}-{len(done):04d}-{uuid.uuid4().hex}.zip"
                    out, n, size = fs.open_output_stream(f"{root}/{name}"), 0, 0
                    box = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                payload = text.as_py() or b""
                media = encode_png(pad(payload), len(payload))
                box.writestr(zipfile.ZipInfo(f"{n:07d}_{'null' if doc is None else doc}.png"), media)
                n, size = n + 1, size + len(media) + 128
                if size >= archive_bytes:
                    box.close()
                    done.append((name, out.tell(), n))
                    out.close()
                    box = None
        if box is not None:
            box.close()
            done.append((name, out.tell(), n))
            out.close()
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "bytes", "members"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "archive string, bytes long, members long")
    # One row an archive, of a writing task's size.
    manifest = [x.asDict() for x in materialize(rows, f"{folder}-manifest").orderBy("archive").collect()]
    fs, root = open_files(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/{MANIFEST}") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Ranges(InputPartition):
    """Byte ranges (archive, low, high)."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        super().__init__(None)
        self.ranges = ranges


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.batch_bytes = int(options.get("batchbytes", options.get("batchBytes", 4 << 20)))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self):
        fs, root = open_files(self.folder)
        with fs.open_input_file(f"{root}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        size = max(self.range_bytes, -(-sum(x["bytes"] for x in manifest) // MOST_PARTITIONS))
        out, room = [[]], size
        for x in manifest:
            low = 0
            while low < x["bytes"]:
                if room <= 0:
                    out.append([])
                    room = size
                high = min(low + room, x["bytes"])
                out[-1].append((x["archive"], low, high))
                room -= high - low
                low = high
        return [Ranges(r) for r in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for archive, low, high in partition.ranges:
            yield from self.read_range(archive, low, high)

    def read_range(self, archive: str, low: int, high: int) -> Iterator[pa.RecordBatch]:
        fs, root = open_files(self.folder)
        path = f"{root}/{archive}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as box:
            members = [x for x in box.infolist() if low <= x.header_offset < high]
        rows, held = [], 0
        f = fs.open_input_file(path)
        try:
            for x in members:
                for attempt in range(self.attempts):
                    try:
                        media = read_member(f, x)
                        break
                    except (OSError, ValueError):
                        if attempt + 1 == self.attempts:
                            raise
                        time.sleep(0.2 * 2**attempt)
                        f.close()
                        f = fs.open_input_file(path)
                rows.append((archive, x.header_offset, x.filename, media))
                held += len(media)
                if held >= self.batch_bytes:
                    yield _members(rows)
                    rows, held = [], 0
            if rows:
                yield _members(rows)
        finally:
            f.close()


def read_member(f, member: zipfile.ZipInfo) -> bytes:
    """A stored member's bytes, by its header's offset; ValueError if they don't have its checksum."""
    f.seek(member.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member header")
    name, extra = struct.unpack("<HH", head[26:30])
    f.seek(member.header_offset + 30 + name + extra)
    data = f.read(member.file_size)
    if len(data) != member.file_size or zlib.crc32(data) != member.CRC:
        raise ValueError("damaged member")
    return data


def _members(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["archive", "offset", "name", "media"])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(folder)``; options rangeBytes, batchBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the archives in ``folder`` and computes digests and features from the stored bytes."""
    spark.dataSource.register(MediaArchive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media"), strict=True):
                media = media.as_buffer().to_pybytes()
                samples, n_bytes = decode_png(media)
                doc = name.partition("_")[2].removesuffix(".png")
                rows.append((None if doc == "null" else int(doc), n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return spark.read.format("media_archive").load(folder).select("name", "media").mapInArrow(run, FEATURES)


def store_and_read(docs: DataFrame, archive_bytes: int = 128 << 20) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}/media"
    write_archives(docs, folder, archive_bytes)
    return media_features(docs.sparkSession, folder)

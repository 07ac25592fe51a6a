"""WARC archives: writing, and reading by verified record boundaries.

Each record is a gzip member of its own whose extra field ``sl`` holds the member's size and the record's size, as the
WARC standard's annex on compression describes; ``compress=False`` writes and reads plain records.

Writing.  Of the records with one payload of at least ``revisit_bytes`` bytes, that with the
smallest page id is a response and the others are revisits of it; smaller payloads
are always responses.  Each task writes archives of about ``archive_bytes`` under a
name of its own attempt; only the archives that the written manifest names are read.

Reading.  Archives are split into byte ranges.  A task emits, for every record magic in its range (the gzip member's head, or
``WARC/1.1`` in a plain archive) that a header with a length follows, the offset and the successor's offset.  For each archive,
pointer jumping from offset 0 marks what is reachable, in rounds that double the jump; magic inside
payloads isn't reachable.  The records left are read by offset, range by range.

Cases.  Null html: an empty payload.  Null page id: its record has no id, and is a response unless
the payload repeats.  Null url: no target line.  Rows equal in page id and payload are records of one type.
An empty table writes nothing and gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._util import materialize, shared_dir, valid_text

MAGIC = b"WARC/1.1\r\n"
HEADER_BYTES, READ_BYTES = 1 << 16, 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_files(uri: str):
    """(file system, path) of a URI, for Python workers."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, revisit_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, record_type, refers_to; the html is shuffled once, by its unique page id."""
    rows = pages.select(F.col("page_id").cast("long"), valid_text("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_ones = rows.where(F.octet_length("html") >= revisit_bytes).select("page_id", "digest")
    # Only repeated payloads need their page ids compared.
    repeated = long_ones.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = long_ones.join(repeated, "digest").where("not (page_id <=> first)").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to")).distinct()
    return rows.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select(
        "page_id", "url", "html", "digest", F.when(F.col("r_digest").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to"
    )


def record_name(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id)}", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Payload-Length: {len(payload)}"]
    block = HTTP + (payload if kind == "response" else b"")
    lines.append(f"Content-Length: {len(block)}")
    return MAGIC + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: gzip: deflate, with an extra field; then time, flags, system, and the field's length, name and size.
GZIP = b"\x1f\x8b\x08\x04"
_MEMBER = struct.Struct("<4sIBBH2sHII")


def member_of(record: bytes) -> bytes:
    """The record as a gzip member that states both sizes."""
    squeezer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeezer.compress(record) + squeezer.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(GZIP, 0, 4, 255, 12, b"sl", 8, size, len(record)) + body + struct.pack("<II", zlib.crc32(record), len(record))


def open_member(data: bytes) -> bytes:
    """The record of a member, whole or not at all."""
    record = zlib.decompress(data, 31)
    if len(record) != _MEMBER.unpack_from(data)[-1]:
        raise ValueError("the member doesn't have its stated size")
    return record


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20, compress: bool = True) -> DataFrame:
    """Writes the archives; the manifest (archive, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_files(folder)
        fs.create_dir(root, recursive=True)
        task, out, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task:05d}-{len(done):04d}-{uuid.uuid4().hex}.warc{'.gz' if compress else ''}"
                    out, size, n = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = member_of(record_bytes(*row)) if compress else record_bytes(*row)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((name, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, n))
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["archive", "bytes", "records"])

    return records.select("page_id", "url", "html", "digest", "record_type", "refers_to").mapInArrow(run, "archive string, bytes long, records long")


_LENGTH = re.compile(rb"^content-length:[ \t]*(\d+)[ \t]*\r?$", re.I | re.M)


def member_candidates(data: bytes, base: int, upto: int) -> list[tuple[int, int]]:
    """(offset, successor) of each gzip magic in ``data`` before ``upto`` whose extra field states a size; data starts at ``base``."""
    out, at = [], data.find(GZIP)
    while 0 <= at < upto and at + _MEMBER.size <= len(data):
        _, _, _, _, extra, name, length, size, _ = _MEMBER.unpack_from(data, at)
        if (extra, name, length) == (12, b"sl", 8) and size > _MEMBER.size:
            out.append((base + at, base + at + size))
        at = data.find(GZIP, at + 1)
    return out


def candidates(data: bytes, base: int, upto: int) -> list[tuple[int, int]]:
    """(offset, successor) of each magic line in ``data`` before ``upto``, where a header follows; data starts at ``base``."""
    out, at = [], data.find(MAGIC)
    while 0 <= at < upto:
        end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
        if end >= 0 and (m := _LENGTH.search(data, at, end + 2)):
            out.append((base + at, base + end + 4 + int(m[1]) + 4))
        at = data.find(MAGIC, at + 1)
    return out


def reachable(offsets: np.ndarray, successors: np.ndarray, size: int) -> np.ndarray:
    """Mask of the candidates on the chain from offset 0, by pointer jumping.

    Raises ValueError if the chain doesn't end at the archive's size.
    """
    order = np.argsort(offsets)
    off, nxt = offsets[order], successors[order]
    n = len(off)
    # Slot n is the end; a successor that is no candidate leads to slot n + 1.
    at = np.searchsorted(off, nxt)
    jump = np.append(np.where((at < n) & (np.append(off, -1)[at] == nxt), at, np.where(nxt == size, n, n + 1)), [n, n + 1])
    seen = np.zeros(n + 2, dtype=bool)
    seen[0 if n and off[0] == 0 else n + (size > 0)] = True
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if np.array_equal(more, seen) and np.array_equal(jump[jump], jump):
            break
        seen, jump = more, jump[jump]
    if seen[n + 1] or (size and not seen[n]):
        raise ValueError("the record chain is broken")
    out = np.zeros(n, dtype=bool)
    out[order] = seen[:n]
    return out


def range_tasks(manifest: DataFrame, range_bytes: int) -> int:
    """One task for each range, but no more than 20000."""
    total = manifest.agg(F.sum("bytes")).first()[0] or 0
    return int(min(20_000, max(1, -(-total // range_bytes))))


def boundaries(manifest: DataFrame, folder: str, range_bytes: int = 8 << 20) -> DataFrame:
    """(archive, at, next): the records of the archives, verified from each archive's start."""
    ranges = manifest.select("archive", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("low"))
    # A range is a row of a few bytes but MBs of work: partitions go by the archives' size, not by the rows'.
    dealt = ranges.repartition(range_tasks(manifest, range_bytes), "archive", "low")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_files(folder)
        for batch in batches:
            for name, size, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    f.seek(low)
                    data = f.read(range_bytes + HEADER_BYTES)
                if low == 0 and not data.startswith((GZIP, MAGIC)):
                    raise ValueError(f"{name} doesn't begin with a record")
                found = (member_candidates if name.endswith(".gz") else candidates)(data, low, range_bytes)
                cols = list(zip(*found, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([size] * len(found), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["archive", "bytes", "at", "next"])

    def verify(t: pa.Table) -> pa.Table:
        # One archive's candidates: bounded by the archive's size.
        keep = reachable(t["at"].to_numpy(), t["next"].to_numpy(), t["bytes"][0].as_py())
        return t.select(["archive", "at", "next"]).filter(pa.array(keep))

    found = dealt.mapInArrow(scan, "archive string, bytes long, at long, next long")
    return found.groupBy("archive").applyInArrow(verify, "archive string, at long, next long")


RECORD = "page_id long, url string, record_type string, payload binary, digest string, payload_bytes long, refers_to long"


def read_records(found: DataFrame, folder: str, tasks: int, range_bytes: int = 8 << 20) -> DataFrame:
    """The records at ``found`` (archive, at, next), read range by range; the payload of a response is checked against its digest."""
    dealt = found.repartition(tasks, F.col("archive"), F.expr(f"at div {range_bytes}")).sortWithinPartitions("archive", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_files(folder)
        name, f, low, buffer = None, None, 0, b""
        for batch in batches:
            rows, held = [], 0
            for archive, at, nxt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != name:
                    if f:
                        f.close()
                    name, f, low, buffer = archive, fs.open_input_file(f"{root}/{archive}"), 0, b""
                if not low <= at <= nxt <= low + len(buffer):
                    # Neighbours come with the record: one read for many small ones.
                    f.seek(at)
                    low, buffer = at, f.read(max(nxt - at, READ_BYTES))
                data = buffer[at - low : nxt - low]
                rows.append(parse_record(open_member(data) if archive.endswith(".gz") else data))
                held += nxt - at
                if held > 4 << 20:
                    yield _records(rows)
                    rows, held = [], 0
            yield _records(rows)
        if f:
            f.close()

    return dealt.select("archive", "at", "next").mapInArrow(run, RECORD)


def parse_record(data: bytes) -> tuple:
    head, _, block = data.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    payload = block[: int(field["content-length"])].partition(b"\r\n\r\n")[2]
    kind, digest = field["warc-type"], field["warc-payload-digest"].removeprefix("sha256:")
    size = int(field["warc-payload-length"]) if kind == "revisit" else len(payload)
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{field['warc-record-id']}: the payload doesn't have its digest")
    return _page(field["warc-record-id"]), field.get("warc-target-uri"), kind, payload, digest, size, _page(field.get("warc-refers-to"))


def _page(name: str | None) -> int | None:
    return None if name is None or name == record_name(None) else int(name[len("<urn:page:") : -1])


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])


def round_trip(pages: DataFrame, revisit_bytes: int = 100, archive_bytes: int = 32 << 20, range_bytes: int = 8 << 20, compress: bool = True) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads their records back."""
    home = shared_dir(pages.sparkSession)
    folder = f"{home}/archives"
    manifest = materialize(write_archives(plan_records(pages, revisit_bytes), folder, archive_bytes, compress), f"{home}/manifest")
    return read_records(boundaries(manifest, folder, range_bytes), folder, range_tasks(manifest, range_bytes), range_bytes)

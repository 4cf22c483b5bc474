"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some whole records, and a last skippable frame with the seek table
of the public seekable format (sizes of each frame packed and unpacked, then count, descriptor and magic number). The index
maps a record's identifier to its frame and its offset within the unpacked frame, so one record costs one frame to read.

Payloads of at least ``least`` bytes that are equal are stored once: the row with the largest page_id is the response, the
others are revisit records that name it. Digests are joined, not payloads compared, and only digests that occur twice.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import FileWriter, materialize, new_dir, open_input, ship

LEAST, FRAME_BYTES, LEVEL = 1000, 1 << 20, 3
TASK_FRAMES = 32  # frames a task reads back, each of about FRAME_BYTES unpacked
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: object) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def make_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One WARC/1.1 record; a revisit has the payload's size and digest in its header and no payload."""
    target = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{x:02X}" for x in c.encode("utf-8", "surrogatepass")) for c in url or "about:blank")
    revisit = refers_to is not None
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """(offset, headers, block) of each record of an unpacked frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("ascii").split("\r\n")
        if first != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        size = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"cut record at {at}")
        yield at, headers, block
        at = end + 8 + size


class BundleWriter:
    """Puts records into frames; close() appends the seek table."""

    def __init__(self, uri: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.out, self.frame_bytes, self.frames, self.records, self.size = FileWriter(uri), frame_bytes, [], [], 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress

    def add(self, record: bytes) -> tuple[int, int]:
        """(frame, offset within it) at which the record will be."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self._flush()
        place = len(self.frames), self.size
        self.records.append(record)
        self.size += len(record)
        return place

    def _flush(self) -> None:
        packed = self.pack(b"".join(self.records))
        self.frames.append((len(packed), self.size))
        self.out.write(packed)
        self.records, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class BundleReader:
    """Random access to the frames of a bundle."""

    def __init__(self, uri: str):
        import zstandard

        self.file = open_input(uri)
        self.unpack = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE:
            raise ValueError(f"{uri}: no seek table")
        raw, at = self._at(size - 9 - 8 * n, 8 * n), 0
        self.frames = []
        for packed, full in struct.iter_unpack("<II", raw):
            self.frames.append((at, packed, full))
            at += packed

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        start, packed, full = self.frames[k]
        return self.unpack(self._at(start, packed), max_output_size=full)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        _, headers, block = next(parse_records(self.frame(frame)[offset:]))
        return headers, block

    def close(self) -> None:
        self.file.close()


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of each row of ``pages`` (page_id, url, html)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    slim = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("d_digest"))
    twice = slim.groupBy("d_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = materialize(twice, "warc_twice")
    joined = rows.join(twice, (F.col("digest") == F.col("d_digest")) & (F.octet_length("payload") >= least), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first_id")), F.col("first_id")).alias("refers_to"))


def write_bundles(pages: DataFrame, out: str | None = None, least: int = LEAST, frame_bytes: int = FRAME_BYTES) -> tuple[str, DataFrame]:
    """Write a bundle for each partition under ``out``; returns the folder and the index (record_id, file, frame, offset).

    A task that is run again writes a bundle of its own; only bundles that the index names count.

    Defined results: null html is an empty payload; a null url is about:blank; url characters that a header can't hold are
    percent-encoded; a null page_id is record urn:page:null, and never the response that others refer to unless all are null;
    rows with one page_id and payload are all responses if it is the largest; an empty table gives an empty index, and no file; other columns are
    not read. A page of any size is one record, and a frame of its own if it is larger than ``frame_bytes``.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = out or new_dir(spark, "warc")

    def put(batches):
        from pyspark import TaskContext

        # a file of the attempt's own: a task that runs twice may see its rows in another order, and the index that is kept must fit its file
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        bundle, places = None, []
        for b in batches:
            for row in zip(*(c for c in b.columns)):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                bundle = bundle or BundleWriter(name, frame_bytes)
                places.append((record_id(page_id), *bundle.add(make_record(page_id, url, payload, digest, refers_to))))
        if bundle:
            bundle.close()
            ids, frames, offsets = zip(*places)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([name] * len(ids)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], names=["record_id", "file", "frame", "offset"])

    index = plan_records(pages, least).mapInArrow(put, "record_id string, file string, frame int, offset long")
    return folder, materialize(index, "warc_index")


def read_bundles(spark: SparkSession, index: DataFrame, task_frames: int = TASK_FRAMES) -> DataFrame:
    """(record_id, record_type, payload_bytes, payload_digest, refers_to) from the bundles' own bytes; stored payloads are hashed again.

    One task reads a frame at a time, about ``task_frames`` of them, neighbours of a file together, whose seek table is read once. An index
    row that its frame doesn't bear out fails.
    """
    ship(spark)
    frames = index.groupBy("file", "frame").agg(F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets"))
    # index rows are tiny and frames are not: tasks are counted by frames, and a given number is not merged again
    tasks = max(1, -(-index.select("file", "frame").distinct().count() // task_frames))
    frames = frames.repartition(tasks, "file", F.floor(F.col("frame") / task_frames)).sortWithinPartitions("file", "frame")

    def scan(batches):
        bundle, opened = None, None
        for b in batches:
            rows: list[tuple] = []
            for name, frame, n, offsets in zip(*(c.to_pylist() for c in b.columns)):
                if name != opened:
                    if bundle:
                        bundle.close()
                    bundle, opened = BundleReader(name), name
                found = total = 0
                for at, h, block in parse_records(bundle.frame(frame)):
                    found, total = found + 1, total + at
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        payload = block[len(_HTTP) :]
                        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                            raise ValueError(f"{name}: {h['WARC-Record-ID']} is damaged")
                    rows.append((h["WARC-Record-ID"][1:-1], h["WARC-Type"], size, digest, h["WARC-Refers-To"][1:-1] if "WARC-Refers-To" in h else None))
                if (found, total) != (n, offsets):
                    raise ValueError(f"{name}: frame {frame} is not as indexed")
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4], pa.string())], names=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])
        if bundle:
            bundle.close()

    return frames.mapInArrow(scan, "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string")


def lookup(spark: SparkSession, index: DataFrame, ids: list[object]) -> list[tuple[dict[str, str], bytes]]:
    """Headers and blocks of a few records by identifier, each at the cost of one frame."""
    out = []
    for r in index.where(F.col("record_id").isin([record_id(i) for i in ids])).orderBy("record_id", "file", "frame", "offset").collect():
        bundle = BundleReader(r["file"])
        out.append(bundle.record(r["frame"], r["offset"]))
        bundle.close()
    return out


def page_number(column: str) -> Column:
    return F.regexp_extract(column, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS first_id FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
    CASE WHEN page_id < first_id AND n >= 1000 THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < first_id AND n >= 1000 THEN first_id END AS refers_to
FROM d LEFT JOIN m ON d.h = m.h
"""

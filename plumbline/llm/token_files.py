"""Token-id files of patched frame-of-reference blocks.

A file holds the ids of some documents, one after the other, in blocks of BLOCK ids. A block stores its smallest id, the
offsets from it packed at a width that a percentile of them needs, and an exception list (positions and high parts) of the
offsets that the width can't hold. Layout, little-endian:

    "PFOR" u8 version, u32 block length
    blocks: u32 minimum, u8 width, u8 exceptions, then ceil(length * width / 8) packed bytes,
            exceptions x u8 position, exceptions x u32 offset >> width
    index:  blocks x u64 start of the block in the file; documents x u64 end of the document in ids,
            documents x i64 doc_id, documents x u8 whether the doc_id is null
    footer: u64 blocks, u64 documents, u64 start of the index, "PFOR"

Files are written in ascending doc_id order over the shards of one range partitioning, one file a shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import FileWriter, materialize, new_dir, open_input, ship
from plumbline.llm.tokenize import encoder, vocabulary_path

BLOCK, PERCENTILE = 128, 90
_MAGIC, _HEAD = b"PFOR", struct.Struct("<4sBI")


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> list[bytes]:
    """Ids (uint32) as block bytes; the last block may be short."""
    n = len(ids)
    if not n:
        return []
    full, out = n // block, [b""] * -(-n // block)
    groups = [(np.arange(full), ids[: full * block].reshape(full, block))] if full else []
    if n % block:
        groups.append((np.array([full]), ids[full * block :][None]))
    for at, rows in groups:
        low = rows.min(1)
        off = rows - low[:, None]
        rank = max(0, -(-rows.shape[1] * int(percentile) // 100) - 1)
        bound = np.partition(off, rank, axis=1)[:, rank].astype(np.uint64)
        width = np.zeros(len(rows), dtype=np.int64)
        for b in range(32):
            width += (bound >> np.uint64(b)) > 0
        for w in np.unique(width).tolist():
            pick = np.nonzero(width == w)[0]
            x = off[pick]
            high = x >> np.uint32(w) if w < 32 else np.zeros_like(x)
            if w:
                raw = x.astype("<u4").view(np.uint8).reshape(len(pick), -1, 4)
                bits = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :w]
                packed = np.packbits(bits.reshape(len(pick), -1), axis=1, bitorder="little")
            else:
                packed = np.zeros((len(pick), 0), dtype=np.uint8)
            width_bytes = packed.shape[1]
            flat = packed.tobytes()
            row, col = np.nonzero(high)
            ends = np.searchsorted(row, np.arange(len(pick) + 1))
            values = high[row, col].astype("<u4")
            cols = col.astype(np.uint8)
            for k, p in enumerate(pick.tolist()):
                a, b = ends[k], ends[k + 1]
                out[at[p]] = struct.pack("<IBB", int(low[p]), w, b - a) + flat[k * width_bytes : (k + 1) * width_bytes] + cols[a:b].tobytes() + values[a:b].tobytes()
    return out


def unpack_block(data: bytes, at: int, length: int) -> np.ndarray:
    return unpack_blocks(data, np.array([at]), np.array([length]))


def unpack_blocks(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of blocks at ``starts`` of ``data``, in order; blocks of one width and length are unpacked together."""
    raw = np.frombuffer(data, dtype=np.uint8)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if len(starts) else np.zeros(0, "<u4")
    width, extra = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint32)
    begin = ends - lengths
    for key in np.unique(width * 65536 + lengths):
        w, n = int(key) // 65536, int(key) % 65536
        for pick in np.array_split(p := np.nonzero((width == w) & (lengths == n))[0], max(1, len(p) // 8192)):
            size = (n * w + 7) // 8
            if not w:
                x = np.zeros((len(pick), n), dtype=np.uint32)
            else:  # an id's bits lie within the eight bytes from its first one
                bit = np.arange(n) * w
                rows = np.zeros((len(pick), size + 8), dtype=np.uint8)
                rows[:, :size] = raw[(starts[pick] + 6)[:, None] + np.arange(size)]
                words = np.lib.stride_tricks.as_strided(rows, (len(pick), size + 1, 8), (rows.strides[0], 1, 1))[:, bit >> 3].copy().view("<u8")[:, :, 0]
                x = ((words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << w) - 1)).astype(np.uint32)
            for k in np.nonzero(extra[pick])[0].tolist():
                e, q = int(extra[pick[k]]), int(starts[pick[k]]) + 6 + size
                x[k, raw[q : q + e]] |= np.frombuffer(data, dtype="<u4", count=e, offset=q + e) << np.uint32(w)
            x += low[pick, None]
            out[begin[pick][:, None] + np.arange(n)] = x
    return out


class TokenFileWriter:
    """Streams documents' ids to one file."""

    def __init__(self, uri: str, block: int = BLOCK, percentile: float = PERCENTILE):
        self.out, self.block, self.percentile = FileWriter(uri), block, percentile
        self.rest, self.waiting, self.ids, self.starts, self.ends, self.names = [], 0, 0, [], [], []
        self.out.write(_HEAD.pack(_MAGIC, 1, block))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.add_many([doc_id], np.frombuffer(ids, dtype="<u4"), np.array([len(ids) // 4]))

    def add_many(self, doc_ids: list[int | None], ids: np.ndarray, n: np.ndarray) -> None:
        """Ids (uint32) of documents one after the other, ``n`` a document."""
        self.rest.append(ids.astype("<u4").tobytes())
        self.waiting += len(ids)
        self.ends += (self.ids + np.cumsum(n)).tolist()
        self.ids += len(ids)
        self.names += doc_ids
        if self.waiting >= 4096 * self.block:
            self._flush(self.waiting - self.waiting % self.block)

    def _flush(self, n: int) -> None:
        data = b"".join(self.rest)
        for b in pack_blocks(np.frombuffer(data, dtype="<u4", count=n), self.block, self.percentile):
            self.starts.append(self.out.at)
            self.out.write(b)
        self.rest, self.waiting = [data[4 * n :]], self.waiting - n

    def close(self) -> None:
        self._flush(self.waiting)
        index = self.out.at
        self.out.write(np.array(self.starts, dtype="<u8").tobytes() + np.array(self.ends, dtype="<u8").tobytes())
        self.out.write(np.array([n or 0 for n in self.names], dtype="<i8").tobytes() + bytes(n is None for n in self.names))
        self.out.write(struct.pack("<QQQ4s", len(self.starts), len(self.ends), index, _MAGIC))
        self.out.close()


class TokenFileReader:
    """Documents of a file, any of them or all in turn."""

    def __init__(self, uri: str):
        self.file = open_input(uri)
        size = self.file.size()
        blocks, docs, index, magic = struct.unpack("<QQQ4s", self._at(size - 28, 28))
        head = _HEAD.unpack(self._at(0, _HEAD.size))
        if magic != _MAGIC or head[0] != _MAGIC:
            raise ValueError(f"{uri}: not a token file")
        self.block, self.index = head[2], index
        raw = self._at(index, 8 * blocks + 17 * docs)
        self.starts = np.frombuffer(raw, dtype="<u8", count=blocks).astype(np.int64)
        self.ends = np.frombuffer(raw, dtype="<u8", count=docs, offset=8 * blocks).astype(np.int64)
        names, null = np.frombuffer(raw, dtype="<i8", count=docs, offset=8 * (blocks + docs)), raw[8 * blocks + 16 * docs :]
        self.names = [None if x else n for n, x in zip(names.tolist(), null)]
        self.total = int(self.ends[-1]) if docs else 0

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a .. b-1 of the file: only the blocks that hold them are read."""
        if a >= b:
            return np.zeros(0, dtype=np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        at = int(self.starts[first])
        end = int(self.starts[last + 1]) if last + 1 < len(self.starts) else self.index
        ks = np.arange(first, last + 1)
        lengths = np.minimum(self.block, self.total - ks * self.block)
        got = unpack_blocks(self._at(at, end - at), self.starts[ks] - at, lengths)
        return got[a - first * self.block : b - first * self.block]

    def documents(self, step: int = 1 << 19):
        """The ids of each document in turn, read some blocks at a time."""
        have, base = np.zeros(0, dtype=np.uint32), 0
        start = 0
        for end in self.ends.tolist():
            while base + len(have) < end:
                more = self.ids(base + len(have), min(self.total, base + len(have) + step))
                have, base = np.concatenate((have[start - base :], more)), start
            yield have[start - base : end - base]
            start = end

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, out: str | None = None, vocabulary: str | None = None, files: int | None = None) -> tuple[str, DataFrame]:
    """Encode ``docs`` (doc_id, text) in doc_id order into token files; returns the folder and the manifest.

    The manifest has a row a file (file, shard, n_docs, n_tokens).
    Ids that are equal stand in order of their texts, so repeated rows are one after the other. A null or empty text is its end alone; a null
    doc_id stands first; an empty table writes no file; a text of any length is encoded whole, in one task; other columns are not looked at.
    The sort is a range partitioning: no task sees more than its share, and a shard that is written twice is the same both times.
    """
    spark: SparkSession = docs.sparkSession
    ship(spark)
    folder, path = out or new_dir(spark, "tokens"), vocabulary or vocabulary_path()
    n = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def put(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{folder}/tokens-{shard:06d}.pfor"
        to = None
        for b in batches:
            names, done = b.column(0).to_pylist(), 0
            for ids, n in encoder(path).encode_texts(b.column(1)):
                to = to or TokenFileWriter(name)
                to.add_many(names[done : done + len(n)], ids, n)
                done += len(n)
        if to:
            to.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "shard": shard, "n_docs": len(to.ends), "n_tokens": to.ids}], schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    shards = materialize(rows.mapInArrow(put, "file string, shard int, n_docs long, n_tokens long"), "token_manifest")
    return folder, shards


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files' own bytes.

    start counts the ids of all documents before it in all files; the running sum is over the manifest, one row a file.
    """
    spark = manifest.sparkSession
    ship(spark)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    files = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")

    def scan(batches):
        for b in batches:
            for name, n_docs, start in zip(*(c.to_pylist() for c in b.columns)):
                f = TokenFileReader(name)
                if len(f.names) != n_docs:
                    raise ValueError(f"{name}: {len(f.names)} documents, {n_docs} were written")
                ends = f.ends
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
                crcs = [zlib.crc32(np.ascontiguousarray(x, dtype="<u4")) for x in f.documents()]
                f.close()
                yield pa.RecordBatch.from_arrays([pa.array(f.names, pa.int64()), pa.array(starts + start), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Removal of long strings that repeat anywhere in the corpus, by suffix arrays over shards.

1. **Pieces.** Every start of a string of ``length`` bytes is named by the least hash of the grams in it; neighbouring starts of one name form a piece
   (some 180 starts at 400 bytes). Equal strings have equal names, so only pieces whose name stands twice in the corpus can hold a repeat; of
   those, equal pieces need to be told apart no further: all their starts repeat. (A piece that repeats within itself is seen by its grams.)
2. **Shards.** The other pieces, once each, go to shards by their names, a few MB a shard, and each shard's text gets a suffix array
   (Larsson-Sadakane) with common prefixes (Kasai): neighbours in order that share ``length`` bytes mark two repeated starts.
3. **Merging.** A name that very many different pieces have is dealt to many shards. Each of these also writes its own strings in a sorted
   order, one of each kind, cut by hash ranges; a merge task takes a range of all shards and finds by binary search which stand in several.

Texts move twice, to be cut and to be cleaned; all else are numbers. Equal texts are one text with a count until the end. Hashes of texts,
pieces and merged strings have 128 bits, those in a shard are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, schema_with, ship, utf8
from plumbline.llm.suffix import common_prefixes, suffix_array

LENGTH, GRAM = 400, 32
PIECE = 4096  # most starts in a piece
BLOCK = 1 << 20  # starts that are named at a time
SHARD = 2 << 20  # bytes in a shard, about
SPREAD = 2048  # pieces of one name in a shard, about
_TABLE = np.random.default_rng(400).integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15
_RUN = np.dtype([("f", "<u8"), ("g", "<u8"), ("c", "<i8"), ("at", "<i4"), ("alone", "u1")])


def names_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(name of each ``length``-byte string of ``data``: the least hash of its ``gram``-byte strings; names whose gram stands twice in data).

    gram is a power of two. A piece can hold the same string twice only if its name is among the latter.
    """
    x, m = _TABLE[data], 1
    while m < gram:
        x = x[:-m] * np.uint64(pow(_ODD, m, 1 << 64)) + x[m:]
        m *= 2
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    m, window, each = 1, length - gram + 1, x
    while 2 * m <= window:
        x = np.minimum(x[:-m], x[m:])
        m *= 2
    x = np.minimum(x[: len(x) - (window - m)], x[window - m :])
    low = np.sort(each[each <= x.max()])
    return x, low[1:][low[1:] == low[:-1]]


def pieces_of(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, name, hash of the bytes, whether its own strings may repeat in it) of a text's pieces."""
    lo, many, name, twice = [], [], [], []
    for at in range(0, len(raw) - length + 1, BLOCK):
        x, again = names_of(np.frombuffer(raw, dtype=np.uint8)[at : at + BLOCK + length - 1], length, gram)
        new = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
        size = np.diff(np.append(new, len(x)))
        parts = -(-size // PIECE)
        row = np.repeat(np.arange(len(new)), parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo.append(at + new[row] + k * PIECE)
        many.append(np.minimum(PIECE, size[row] - k * PIECE))
        name.append(x[new][row].view(np.int64))
        twice.append(np.isin(x[new][row], again))
    if not lo:
        return *(np.zeros(0, dtype=np.int64) for _ in range(4)), np.zeros(0, dtype=bool)
    lo, many, name, twice = (np.concatenate(v) for v in (lo, many, name, twice))
    view = memoryview(raw)
    seen = np.array([xxhash.xxh3_64_intdigest(view[a : a + m + length - 1]) for a, m in zip(lo.tolist(), many.tolist())], dtype=np.uint64)
    return lo, many, name, seen.view(np.int64), twice


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: (starts that repeat as flags, one start of each kind of string in order, whether it stands alone, part of each byte)."""
    units = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    size = np.array([len(p) for p in pieces], dtype=np.int64)
    part = np.repeat(np.arange(len(pieces)), size)
    end, n = np.cumsum(size)[part], len(units)
    word = np.ndarray((n,), dtype=">u8", buffer=units.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    left = np.minimum(end - np.arange(n), 7)
    keys = ((word >> np.uint64(8)) >> (8 * (7 - left)).astype(np.uint64)) << (8 * (7 - left)).astype(np.uint64)
    sa, _ = suffix_array((keys << np.uint64(3) | left.astype(np.uint64)).astype(np.int64), 7, end, part)
    shared, other = common_prefixes(sa, units, end, part)
    flags = np.zeros(n, dtype=bool)
    twice = np.flatnonzero(shared >= length)
    flags[twice] = flags[other[twice]] = True
    whole = sa[end[sa] - sa >= length]
    heads = np.append(np.flatnonzero(shared[whole] < length), len(whole))
    return flags, whole[heads[:-1]], np.diff(heads) == 1, part


def _lists(row: np.ndarray, rows: int, *columns: tuple[str, np.ndarray]) -> pa.Array:
    """Structs of ``columns`` in lists; ``row`` (ascending) says in which."""
    offsets = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v) for _, v in columns], [k for k, _ in columns]))


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_FOUND = "h long, c long, spans array<struct<a:int,b:int>>, bucket int, run binary"


def _solve(held: list[tuple[int, int, int, int, bytes]], length: int):
    """The shard's pieces (h, salt, c, shards of this name, bytes) as a batch of finds, and of runs for the merge."""
    flags, heads, alone, part = repeated_starts([x[4] for x in held], length)
    first = np.cumsum([0] + [len(x[4]) for x in held])
    a, b = _spans(flags)
    own = part[a]
    rows, which = np.unique(own, return_inverse=True)
    h, c, ways = (np.array([x[i] for x in held], dtype=np.int64) for i in (0, 2, 3))
    spans = _lists(which, len(rows), ("a", (a - first[own]).astype(np.int32)), ("b", (b - first[own]).astype(np.int32)))
    out_h, out_c, bucket, run = h[rows].tolist(), c[rows].tolist(), [None] * len(rows), [None] * len(rows)
    wide = ways[part[heads]] > 1
    heads, alone = heads[wide], alone[wide]
    if len(heads):
        text = memoryview(b"".join(x[4] for x in held))
        rec = np.zeros(len(heads), dtype=_RUN)
        both = [xxhash.xxh3_128_intdigest(text[p : p + length]) for p in heads.tolist()]
        rec["f"], rec["g"] = [x >> 64 for x in both], [x & 0xFFFFFFFFFFFFFFFF for x in both]
        of = part[heads]
        rec["c"], rec["at"], rec["alone"] = c[of], heads - first[of], alone
        group = h[of]
        for name in np.unique(group).tolist():
            mine = np.sort(rec[group == name], order=("f", "g"))
            bits = int(ways[of[group == name][0]] - 1).bit_length()
            cuts = [int(np.searchsorted(mine["f"], np.uint64(k << (64 - bits)))) for k in range(1 << bits)] + [len(mine)]
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if y > x:
                    out_h.append(name)
                    out_c.append(None)
                    bucket.append(k)
                    run.append(mine[x:y].tobytes())
    extra = len(out_h) - len(rows)
    if extra:
        spans = pa.concat_arrays([spans, pa.array([[]] * extra, spans.type)])
    return pa.RecordBatch.from_arrays([pa.array(out_h, pa.int64()), pa.array(out_c, pa.int64()), spans, pa.array(bucket, pa.int32()), pa.array(run, pa.binary())], names=["h", "c", "spans", "bucket", "run"])


def merge_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(c, at) of the strings that stand alone in their shard and in another shard, too: binary search among all shards' strings."""
    pool = np.sort(np.concatenate([r["f"] for r in runs]))
    near = [r[np.searchsorted(pool, r["f"], "right") - np.searchsorted(pool, r["f"], "left") > 1] for r in runs]
    near = np.sort(np.concatenate(near), order=("f", "g"))
    same = (near["f"][1:] == near["f"][:-1]) & (near["g"][1:] == near["g"][:-1])
    hit = np.zeros(len(near), dtype=bool)
    hit[1:] |= same
    hit[:-1] |= same
    hit &= near["alone"] == 1
    return near["c"][hit], near["at"][hit]


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD, shard: int = SHARD) -> DataFrame:
    """(k, l, starts): the stretches [a, b) of starts of repeated strings in each text, by two hashes of the text; texts without one are left out."""
    ship(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("k"), F.xxhash64(F.lit("plumbline"), "text").alias("l"))

    def name(batches):
        for b in batches:
            got = [pieces_of(t or b"", length, gram) for t in utf8(b.column(1))]
            row = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
            lo, many, h, c, twice = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, dtype=np.int64) for i in range(5))
            pieces = _lists(row, len(got), ("lo", lo.astype(np.int32)), ("many", many.astype(np.int32)), ("h", h), ("c", c), ("twice", twice.astype(bool)))
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), size, pieces], names=["doc_id", "k", "l", "size", "pieces"])

    schema = schema_with(keyed.select("doc_id", "k", "l"), "size int, pieces array<struct<lo:int,many:int,h:bigint,c:bigint,twice:boolean>>")
    each = keyed.mapInArrow(name, schema)
    texts = materialize(each.groupBy("k", "l").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("doc_id", "size", "pieces")).alias("x")).select("k", "l", "copies", "x.*"), "substr_texts")
    pieces = texts.select("k", "l", "doc_id", F.explode("pieces").alias("p")).select("k", "l", "doc_id", "p.*")
    kinds = pieces.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.first(F.struct("k", "l", "doc_id", "lo", "many")).alias("at"))
    names = kinds.groupBy(F.col("h").alias("name")).agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("d"), F.max("twice").alias("inside")).where("all > 1 or inside")
    shared = materialize(kinds.join(names, F.col("h") == F.col("name")).select("h", "c", "n", "at", "d", "inside"), "substr_shared")

    ways = F.ceil(F.col("d") / spread).cast("int")
    wanted = shared.where("d > 1 or inside").groupBy(F.col("at.k").alias("wk"), F.col("at.l").alias("wl"), F.col("at.doc_id").alias("w_id"))
    wanted = wanted.agg(F.collect_list(F.struct("at.lo", "at.many", "h", "c", ways.alias("ways"))).alias("pieces"))
    one = keyed.join(wanted, (F.col("k") == F.col("wk")) & (F.col("l") == F.col("wl")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("text", "pieces")

    def cut(batches):
        for b in batches:
            kinds = b.column(1).flatten()
            lo, many, h, c, w = (kinds.field(i).to_numpy() for i in range(5))
            texts, row = utf8(b.column(0)), np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            data = [texts[r][x : x + m + length - 1] for r, x, m in zip(row.tolist(), lo.tolist(), many.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.mod(c, w).astype(np.int32)), pa.array(c), pa.array(w), pa.array(data, pa.binary())], names=["h", "salt", "c", "ways", "data"])

    dealt = one.mapInArrow(cut, "h long, salt int, c long, ways int, data binary").repartition("h", "salt").sortWithinPartitions("h", "salt", "c")

    def solve(batches):
        held, size = [], 0
        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and (x[0], x[2]) == (held[-1][0], held[-1][2]):
                    continue  # rows of equal id and text
                if size >= shard and x[:2] != held[-1][:2]:
                    yield _solve(held, length)
                    held, size = [], 0
                held.append(x)
                size += len(x[4])
        if held:
            yield _solve(held, length)

    found = materialize(dealt.mapInArrow(solve, _FOUND), "substr_found")

    def merge(batches):
        key, runs = None, []

        def out():
            c, at = merge_runs(runs)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(c), pa.int64()), pa.array(c), pa.array(at), pa.array(at + 1)], names=["h", "c", "a", "b"])

        for b in batches:
            for h, k, run in zip(*(b.column(i).to_pylist() for i in range(3))):
                if key != (h, k):
                    if runs:
                        yield out()
                    key, runs = (h, k), []
                runs.append(np.frombuffer(run, dtype=_RUN))
        if runs:
            yield out()

    met = found.where("run is not null").select("h", "bucket", "run").repartition("h", "bucket").sortWithinPartitions("h", "bucket").mapInArrow(merge, "h long, c long, a int, b int")
    inside = found.where("run is null").select("h", "c", F.explode("spans").alias("s")).select("h", "c", "s.*")
    full = shared.where("n > 1").select("h", "c", F.lit(0).alias("a"), F.col("at.many").alias("b"))
    marks = inside.unionByName(full).unionByName(met).withColumnsRenamed({"h": "mh", "c": "mc"})
    placed = pieces.join(marks, (F.col("h") == F.col("mh")) & (F.col("c") == F.col("mc"))).select("k", "l", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    copies = texts.where((F.col("copies") > 1) & (F.col("size") >= length)).select("k", "l", F.lit(0).alias("a"), (F.col("size") - length + 1).alias("b"))
    return placed.unionByName(copies).groupBy("k", "l").agg(F.collect_list(F.struct("a", "b")).alias("starts"))


def covered(starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Stretches of bytes that strings from these starts cover, apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b + length - 1)
        else:
            out.append((a, b + length - 1))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of each row of ``docs`` (doc_id, text): spans [a, b) of bytes that go, and the bytes that stay.

    Defined results: a null text is empty, and shorter texts than ``length`` stay; rows of equal text repeat each other, whatever their
    ids (null ones too); an empty table gives an empty one; other columns are not read. A text of any length is named in blocks of
    BLOCK starts and cut to pieces; it is one row of the first and last pass. Kept bytes need not be UTF-8, as strings of bytes go.
    """
    # a table of its own, so that a text that very many rows have can be split over tasks in the join
    found = materialize(repeats(docs, length, **options), "substr_starts").withColumnsRenamed({"k": "fk", "l": "fl"})
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("k"), F.xxhash64(F.lit("plumbline"), "text").alias("l"))
    rows = keyed.join(found, (F.col("k") == F.col("fk")) & (F.col("l") == F.col("fl")), "left").select("doc_id", "text", "starts")

    def clean(batches):
        for b in batches:
            n, gone, spans, kept = [], [], [], []
            for raw, starts in zip(utf8(b.column(1)), b.column(2)):
                raw = raw or b""
                cover = covered([(s["a"], s["b"]) for s in starts.as_py()], length) if starts.is_valid else []
                n.append(len(raw))
                gone.append(sum(y - x for x, y in cover))
                spans.append([{"a": x, "b": y} for x, y in cover])
                at = [0, *[x for s in cover for x in s], len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(at[::2], at[1::2])) if cover else raw)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    schema = schema_with(rows.select("doc_id"), "n_bytes long, n_removed long, spans array<struct<a:int,b:int>>, kept binary")
    return rows.mapInArrow(clean, schema)

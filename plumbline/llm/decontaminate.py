"""Benchmark decontamination: a broadcast hash set of the benchmark's windows, scanned over every word of every document.

The benchmark goes to the executors in blocks of about ``block_bytes`` of text (measured before anything is collected), one scan a
block, each written before the next begins; so a worker holds one block's windows at a time, and the benchmark's own size decides only how
many scans there are. A window is a hash and a place in its items' words, some 25 bytes, and a word of the benchmark some 150: at the
default block a few hundred MB at the very most. Candidate positions come from a rolling polynomial hash over word numbers; each is
then verified word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, ship, utf8

WINDOW, BLOCK_BYTES = 10, 8 << 20
_KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z; runs of anything but ASCII other than letters and digits."""
    return (text or b"").translate(_KEEP).split()


class WindowSet:
    """Windows of benchmark items: for each window length, sorted hashes with the windows' places in the items' words."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.names: list[str] = []
        each = []
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text and text.encode())]
            if ids:
                each.append(np.array(ids, dtype=np.uint32))
                self.names.append("" if item_id is None else str(item_id))
        self.ids = np.concatenate(each) if each else np.zeros(0, dtype=np.uint32)
        length = np.array([len(x) for x in each], dtype=np.int64)
        self.ends = np.cumsum(length)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(np.minimum(length, window)).tolist():
            own = np.nonzero(np.minimum(length, window) == n)[0]
            many = length[own] - n + 1
            places = np.repeat((self.ends - length)[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            h = self._hash(self.ids, n)[places]
            order = np.argsort(h, kind="stable")
            self.by_length[n] = h[order], places[order]

    @staticmethod
    def _hash(ids: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(ids) - n + 1), dtype=np.uint64)
        for j in range(n):
            out = out * _BASE + ids[j : j + len(out)].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return out ^ (out >> np.uint64(29))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of windows that occur in ``words``, in no order, and the items they are from."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint32, count=len(words))
        if not ids.any():
            return [], set()
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        spans, items = [], set()
        for n, (known, places) in self.by_length.items():
            if len(ids) < n:
                continue
            start = np.nonzero(unknown[n:] == unknown[:-n])[0]
            if not len(start):
                continue
            h = self._hash(ids, n)[start]
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = known[at] == h
            if not hit.any():
                continue
            # Equal windows of the text, by hash, are looked up once; each candidate is compared word by word.
            values, first, which = np.unique(h[hit], return_index=True, return_inverse=True)
            lo, hi = np.searchsorted(known, values), np.searchsorted(known, values, side="right")
            start, same = start[hit], np.zeros(len(values), dtype=bool)
            for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                own = ids[start[first[k]] : start[first[k]] + n]
                equal = places[a:b][(self.ids[places[a:b][:, None] + np.arange(n)] == own).all(1)]
                same[k] = len(equal) > 0
                items.update(np.searchsorted(self.ends, equal, side="right").tolist())
            spans += [(i, i + n) for i in start[same[which]].tolist()]
        return spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS, _ITEMS, _COUNT, _WHOLE = "__pl_spans", "__pl_items", "__pl_n_words", "__pl_whole"
_SPAN_KIND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def scan_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, cut: float | None = None) -> DataFrame:
    """``docs`` with the columns of finds added, one narrow pass a benchmark block; in the last pass, with ``cut``, hit words leave the text."""
    spark = docs.sparkSession
    ship(spark)
    size = benchmark.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    part = F.pmod(F.xxhash64(F.col("item_id").cast("string"), F.col("text")), F.lit(blocks))
    added = {_SPANS: F.lit(None).cast("array<struct<a:int,b:int>>"), _ITEMS: F.lit(None).cast("array<string>"), _COUNT: F.lit(0).cast("long"), _WHOLE: F.lit(False)}
    out = docs.withColumns(added)
    schema = out.schema
    for f in schema.fields:
        f.nullable = True
    for k in range(blocks):
        rows = benchmark.where(part == k).select("item_id", "text").collect()
        known = spark.sparkContext.broadcast(WindowSet([(r["item_id"], r["text"]) for r in rows], window))

        def scan(batches, known=known, last=k == blocks - 1):
            windows = known.value
            for b in batches:
                names = b.schema.names
                cols = {n: b.column(i) for i, n in enumerate(names)}
                text = next(n for n in names if n.lower() == "text")
                texts, spans, items, counts, whole = utf8(cols[text]), [], [], [], []
                for t, s, i in zip(texts, cols[_SPANS], cols[_ITEMS]):
                    words = words_of(t)
                    got, owners = windows.find(words)
                    if s.is_valid:
                        got = got + [(x["a"], x["b"]) for x in s.as_py()]
                    spans.append(merge(got))
                    items.append(sorted({windows.names[o] for o in owners} | set(i.as_py() or [])))
                    counts.append(len(words))
                    whole.append(cut is not None and bool(got) and sum(y - x for x, y in spans[-1]) >= cut * len(words))
                if cut is not None and last and any(spans):
                    texts = [remove_spans(t, s) for t, s in zip(texts, spans)]
                    cols[text] = pa.array(texts, pa.binary()).cast(cols[text].type)
                cols[_SPANS] = pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], _SPAN_KIND)
                cols[_ITEMS] = pa.array(items, pa.list_(pa.string()))
                cols[_COUNT], cols[_WHOLE] = pa.array(counts, pa.int64()), pa.array(whole, pa.bool_())
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

        out = out.mapInArrow(scan, schema)
        if k + 1 < blocks:
            out = materialize(out, "leaks_block")
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit spans (word numbers) and item ids (as strings) of each row of ``docs`` (doc_id, text).

    ``benchmark``: (item_id, text). Defined results: null or wordless texts have no words, windows or hits; a null item id
    counts as the empty string; items that share a window are all named; items with equal ids are one. Rows are taken one by one, so repeated
    rows have equal results; empty tables of documents or items give no rows, or no hits; other columns are not read. A text of any length is scanned whole.
    """
    found = scan_blocks(docs.select("doc_id", "text"), benchmark, window, block_bytes)
    return found.select("doc_id", F.col(_SPANS).alias("spans"), F.col(_ITEMS).alias("items"), F.col(_COUNT).alias("n_words"))


def report(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_spans(raw: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    """The text (UTF-8) without the words of ``spans`` and what stands between them."""
    if raw is None or not spans:
        return raw
    mapped, at, bounds = raw.translate(_KEEP), 0, []
    for w in mapped.split():
        at = mapped.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]])


def clean(docs: DataFrame, benchmark: DataFrame, drop_share: float = 0.5, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without benchmark passages: hit words go; documents of which ``drop_share`` or more of the words are hit go whole.

    A narrow pass: rows are not matched by id, so null and repeated ids make no difference. n_chars, where there is one, follows the text.
    """
    out = scan_blocks(docs, benchmark, window, block_bytes, cut=drop_share).where(~F.col(_WHOLE))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(_SPANS) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(_SPANS, _ITEMS, _COUNT, _WHOLE)


ORACLE = """
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lens AS (SELECT DISTINCT n FROM win),
docwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lens WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, win.item_id FROM docwin d JOIN win USING (n, s)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS joined FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

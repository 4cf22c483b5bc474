"""Ranked lexical search: all documents against a set of queries, by windowed bucket scoring.

One narrow pass counts, in each document, the terms that any query has, and writes them as postings by document; corpus counts come from that
table. Postings are then dealt by ranges of doc_id, in order, and each task walks them in windows of ``WINDOW`` documents: a window's postings
are put in order of term, every posting's worth is computed once for all queries, and a query adds its terms' worths into an array of buckets, one a
document, that fits the cache. A bitset of the documents that a term is in, or-ed over a query's terms, tells which buckets to read; what they hold
goes to the query's heap of the best. A last step keeps the best of all tasks' heaps, in two rounds, so none meets more than a few thousand rows.

Queries go to the executors in blocks of about ``BLOCK_BYTES`` of distinct terms, measured before anything is collected; each block is a pass.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, schema_with, ship, utf8

BEST, WINDOW, BLOCK_BYTES = 50, 1 << 14, 8 << 20
POSTINGS = 4 << 20  # a window closes early at so many
SALTS = 64
_TERM = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII other than letters and digits, A-Z lowered."""
    return (text or b"").translate(_TERM).split()


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item, as UTF-8. Rows of equal item_id are one item."""

    def split(batches):
        for b in batches:
            got = [sorted(set(terms_of(t))) for t in utf8(b.column(1))]
            row = np.repeat(np.arange(len(got)), [len(x) for x in got])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array([t for x in got for t in x], pa.binary())], names=["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(split, schema_with(items.select("item_id"), "term binary")).distinct()


def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term at all: n counts all its terms, the lists only those that ``number`` has."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches):
        get = known.value.get
        for b in batches:
            keep, n, cuts, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(utf8(b.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                keep.append(i)
                n.append(len(words))
                for w, k in Counter(words).items():
                    t = get(w)
                    if t is not None:
                        terms.append(t)
                        tfs.append(k)
                cuts.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v, pa.int32())) for v in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(count, schema_with(docs.select("doc_id"), "n long, terms array<int>, tfs array<int>"))


class Buckets:
    """Scores windows of documents for all queries, and keeps each query's best."""

    def __init__(self, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, best: int = BEST, window: int = WINDOW):
        self.queries, self.weight, self.n_docs, self.n_terms, self.best = queries, weight, n_docs, n_terms, best
        self.score = np.zeros(window, dtype=np.int64)
        self.heaps: list[list[tuple[int, int, object]]] = [[] for _ in queries]
        self.place = 0  # of the first document of the window, in this task's order

    def add(self, ids: list, n: np.ndarray, many: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents in order of doc_id: ids, lengths, numbers of postings, and the postings themselves."""
        slot = np.repeat(np.arange(len(ids)), many)
        use = self.weight[term] > 0
        slot, term, tf = slot[use], term[use], tf[use].astype(np.int64)
        m = 100 - 50 + (50 * n.astype(np.int64) * self.n_docs) // self.n_terms
        worth = self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[slot]))
        order = np.argsort(term, kind="stable")
        slot, worth, term = slot[order], worth[order], term[order]
        have = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, dtype=np.int64)
        bounds = dict(zip(term[have].tolist(), zip(have.tolist(), np.append(have[1:], len(term)).tolist())))
        bits, mark = {}, np.zeros(len(ids), dtype=np.uint8)
        for t, (a, b) in bounds.items():
            mark[slot[a:b]] = 1
            bits[t] = np.packbits(mark)
            mark[slot[a:b]] = 0
        for query, heap in zip(self.queries, self.heaps):
            taken = np.zeros(-(-len(ids) // 8), dtype=np.uint8)
            for t in query:
                if t in bounds:
                    a, b = bounds[t]
                    self.score[slot[a:b]] += worth[a:b]
                    taken |= bits[t]
            at = np.flatnonzero(np.unpackbits(taken, count=len(ids)))
            got = self.score[at]
            self.score[at] = 0
            # later documents lose ties, so only a higher score enters a full heap
            few = got > (heap[0][0] if len(heap) == self.best else 0)
            at, got = at[few], got[few]
            if len(at) > self.best:
                keep = np.lexsort((at, -got))[: self.best]
                at, got = at[keep], got[keep]
            for s, i in zip(got.tolist(), at.tolist()):
                entry = (s, -(self.place + i), ids[i])
                if len(heap) < self.best:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
        self.place += len(ids)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def _best(rows: DataFrame, best: int, *by: str) -> DataFrame:
    """The best rows of each item; ties go to the lower doc_id, null last, and among rows of one document to any."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents (doc_id, text) of each of ``items`` (item_id, text) with a score above 0.

    Defined results: null and termless texts have no terms; they are no documents of the corpus's counts, and no queries. Rows of equal item_id are one
    item with all their terms; a null item_id is one, too. Rows of equal doc_id are documents of their own, and can all be ranked; a
    null doc_id comes last among ties. Empty tables give an empty result. Other columns are not read. A text of any length is counted whole.
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = materialize(query_terms(items), "search_terms")
    size = wanted.agg(F.sum(F.octet_length("term") + 16).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    parts = [_search_block(docs, wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), best, window, most_postings) for k in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search_block(docs: DataFrame, wanted: DataFrame, best: int, window: int, most_postings: int) -> DataFrame:
    spark = docs.sparkSession
    rows = wanted.orderBy("item_id", "term").toArrow()
    names = rows.column("item_id").to_pylist()
    number: dict[bytes, int] = {}
    ids = [number.setdefault(t, len(number)) for t in rows.column("term").to_pylist()]
    cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    queries = [np.array(ids[a:b]) for a, b in zip(cuts, [*cuts[1:], len(names)])]
    item_names = [names[a] for a in cuts]
    lists = materialize(postings(docs, number), "search_postings")
    total = lists.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(len(number), dtype=np.int64)
    for r in lists.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # a row a query term
        df[r["t"]] = r["df"]
    known = spark.sparkContext.broadcast(([q.tolist() for q in queries], weights(df, total["n"]), total["n"], total["l"] or 1, item_names))
    salt = F.xxhash64("n", "terms")
    dealt = lists.repartitionByRange(F.col("doc_id").asc_nulls_last(), salt).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), salt)
    kind_item, kind_doc = wanted.schema["item_id"].dataType, docs.schema["doc_id"].dataType

    def score(batches):
        queries, weight, n_docs, n_terms, named = known.value
        buckets = Buckets(queries, weight, n_docs, n_terms, best, window)
        held, docs_held, size = [], 0, 0
        doc_type = None

        def close():
            buckets.add([x for h in held for x in h[0]], *(np.concatenate([h[i] for h in held]) for i in range(1, 5)))
            held.clear()

        for b in batches:
            doc_type = b.schema.field("doc_id").type
            n, lists = b.column(1).to_numpy(), b.column(2)
            cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            terms, tfs, ids = lists.flatten().to_numpy(), b.column(3).flatten().to_numpy(), b.column(0).to_pylist()
            a = 0
            while a < len(ids):
                c = min(len(ids), a + window - docs_held, max(a + 1, int(np.searchsorted(cut, cut[a] + most_postings - size, side="right")) - 1))
                held.append((ids[a:c], n[a:c], np.diff(cut[a : c + 1]), terms[cut[a] : cut[c]], tfs[cut[a] : cut[c]]))
                docs_held, size = docs_held + c - a, size + int(cut[c] - cut[a])
                if docs_held >= window or size >= most_postings:
                    close()
                    docs_held = size = 0
                a = c
        if held:
            close()
        out = [(named[q], d, s) for q, heap in enumerate(buckets.heaps) for s, _, d in heap]
        if out:
            item, doc, got = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(item, item_type), pa.array(doc, doc_type), pa.array(got, pa.int64())], names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(kind_item)
    schema = wanted.select("item_id").schema.add("doc_id", kind_doc).add("score", "long")
    heaps = dealt.mapInArrow(score, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    found = _best(_best(heaps, best, "item_id", "salt").drop("rank"), best, "item_id")
    return found.select("item_id", "rank", "doc_id", "score")


ORACLE = """
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total WHERE t IN (SELECT t FROM q) GROUP BY t, nd),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * nd) // l) AS m FROM len, total),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""

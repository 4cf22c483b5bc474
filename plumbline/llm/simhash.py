"""SimHash near-duplicates, linked exactly with vantage-point trees over the fingerprints.

Steps: fingerprints of all documents (a scan); equal fingerprints become one node; nodes are
dealt to shards by vantage-point routing trees, whose size is bounded by the sample they are built from; each shard is searched
by a vantage-point self-join, which emits only a spanning forest of its links; components over the forest edges, each named by its smallest doc_id; join back.

Routing. The 64 bits are cut into ``blocks``; fingerprints within ``radius`` bits agree wholly in at least
``blocks - radius`` blocks. There is a tree for each choice of so many blocks. Its upper levels split by Hamming distance to a
vantage point *within those blocks*: there, a link's two ends have distance 0, so the triangle bound lets no link cross
a split and a fingerprint goes to one shard a tree. Where one block value holds too many (a group of near copies), the
tree goes on with distance over all 64 bits; then a link may cross a split, and fingerprints within ``radius`` of the boundary
visit the shard beyond it too. A pair is found where one of them is at home. With five blocks (the default) a shard holds
about 1 / 8192 of the nodes at the finest; for far over 1e9 distinct fingerprints pass blocks=6 (15 trees, 21 bits) or 7.

Memory: a shard is held as 16 bytes a node; distinct fingerprints near one point are few, as exact copies are one node.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize, ship, utf8
from plumbline.llm.components import components

SHINGLE, SEED, RADIUS, BLOCKS = 4, 42, 4, 5
SAMPLE, SHARD_ROWS = 1 << 15, 4096
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text (UTF-8) as an unsigned integer; 0 for null and for texts without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z are lowered, only ASCII space splits
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    length = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    m = n - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, m, 65536):  # a very long text is hashed in pieces, so that memory stays small
        to = min(m, k + 65536)
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[k:to].tolist(), ends[k + shingle - 1 : to + shingle - 1].tolist())), dtype=np.uint64, count=to - k)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int((1 << _BITS[2 * counts > m]).sum(dtype=np.uint64)) if (2 * counts > m).any() else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint's 64 bits as a signed long."""
    ship(docs.sparkSession)

    def scan(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t) for t in utf8(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(scan, docs.select("doc_id").schema.add("fp", "long"))


class RoutingTree:
    """A vantage-point tree over a bounded sample. Nodes: (vantage, mask, cut, slack, near child, far child); leaves number shards."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: int, first: int):
        self.nodes, self.mask, self.radius, self.leaf, self.next = [], np.uint64(mask), radius, max(leaf, 4), first
        self.root = self._build(np.unique(sample), True)

    def _build(self, points: np.ndarray, in_block: bool) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if len(points) > self.leaf:
            full = np.uint64(0xFFFFFFFFFFFFFFFF)
            for mask, slack in ((self.mask, 0), (full, self.radius)) if in_block else ((full, self.radius),):
                v = points[len(points) // 2]
                d = np.bitwise_count((points ^ v) & mask).astype(np.int64)
                cut = int(np.median(d))
                cut -= int(cut == d.max())
                near, far = d <= cut + slack, d > cut - slack
                if d.min() < d.max() and max(near.sum(), far.sum()) <= 0.85 * len(points):  # else it would only be copied
                    self.nodes[at] = (v, mask, cut, slack, self._build(points[near], slack == 0), self._build(points[far], slack == 0))
                    return at
        self.nodes[at] = self.next
        self.next += 1
        return at

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, at home) for each shard that each fingerprint goes to."""
        rows, shards, homes = [], [], []
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), dtype=bool))]
        while todo:
            at, idx, home = todo.pop()
            if not len(idx):
                continue
            node = self.nodes[at]
            if not isinstance(node, tuple):
                rows.append(idx)
                shards.append(np.full(len(idx), node, dtype=np.int32))
                homes.append(home)
                continue
            v, mask, cut, slack, near, far = node
            d = np.bitwise_count((fps[idx] ^ v) & mask).astype(np.int64)
            a, b = d <= cut + slack, d > cut - slack
            todo.append((near, idx[a], home[a] & (d[a] <= cut)))
            todo.append((far, idx[b], home[b] & (d[b] > cut)))
        return np.concatenate(rows or [[]]), np.concatenate(shards or [[]]), np.concatenate(homes or [[]])


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of which two fingerprints within ``radius`` bits agree wholly in at least one."""
    if blocks <= radius:
        return [0]  # no block need agree: distance over all bits only
    edges = [64 * k // blocks for k in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, blocks - radius)]


class Links:
    """Union-find over rows 0 .. n-1; roots are the smallest rows."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        while True:
            y = p[x]
            z = p[y]
            if np.array_equal(y, z):
                return y
            p[x] = z
            x = y

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b = ra[open_], rb[open_]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, hi, lo)


def _near(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, links: Links) -> None:
    step = max(1, (1 << 20) // max(1, len(b)))
    for k in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(fps[a[k : k + step], None] ^ fps[None, b]) <= radius)
        links.union(a[k + i], b[j])


def join_within(fps: np.ndarray, a: np.ndarray, b: np.ndarray | None, radius: int, links: Links, leaf: int = 1 << 20) -> None:
    """Link rows of ``a`` with each other, or with rows of ``b``, by vantage-point recursion.

    Two points of a link differ by at most ``radius`` in their distance to any vantage point; so only points near the cut can
    link across it. Points within half the radius of the vantage point link to it, and so need no look at each other.
    """
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not len(x) or (y is not None and not len(y)):
            continue
        if len(x) * len(x if y is None else y) <= leaf:
            _near(fps, x, x if y is None else y, radius, links)
            continue
        v = fps[x[len(x) // 2]]
        dx = np.bitwise_count(fps[x] ^ v).astype(np.int64)
        cut = int(np.median(dx))
        cut -= int(cut == dx.max())
        if y is None:
            ball = x[dx <= radius // 2]
            links.union(ball, np.full(len(ball), x[len(x) // 2]))
            near, far = dx <= cut, dx > cut
            edge_n, edge_f = near & (dx > cut - radius), far & (dx <= cut + radius)
            if dx.min() == dx.max() or (edge_n.all() and edge_f.all()) or (edge_n | edge_f).sum() > 0.9 * len(x):
                _near(fps, x, x, radius, links)  # all lie near the cut: nothing to prune
                continue
            todo += [(x[near], None), (x[far], None), (x[edge_n], x[edge_f])]
        else:
            dy = np.bitwise_count(fps[y] ^ v).astype(np.int64)
            if dx.min() == dx.max():  # one row, which no cut parts
                _near(fps, x, y[np.abs(dy - dx[0]) <= radius], radius, links)
                continue
            yn, yf = y[dy <= cut + radius], y[dy > cut - radius]
            if len(yn) + len(yf) > 1.8 * len(y):
                _near(fps, x, y, radius, links)
                continue
            todo += [(x[dx <= cut], yn), (x[dx > cut], yf)]


def shard_links(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (node, smallest node of its part) of the links that a shard sees."""
    order = np.argsort(nodes, kind="stable")
    fps, nodes, home = fps[order], nodes[order], home[order]
    links = Links(len(fps))
    at_home, visits = np.nonzero(home)[0], np.nonzero(~home)[0]
    join_within(fps, at_home, None, radius, links)
    join_within(fps, at_home, visits, radius, links)
    root = links.find(np.arange(len(fps)))
    moved = root != np.arange(len(fps))
    return nodes[moved], nodes[root[moved]]


def link_edges(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b) with a > b: edges that connect just what links of at most ``radius`` bits connect. ``nodes``: (fp, node), fp distinct.

    The trees are built on the driver from about ``sample`` fingerprints, those with the smallest hashes, and never more than twice that.
    """
    spark: SparkSession = nodes.sparkSession
    ship(spark)
    n = nodes.count()
    # A share of the hashes that holds about ``sample`` fingerprints; ranking all would send each partition's first ones to the driver.
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 31)) < F.lit((1 << 31) if n <= sample else max(1, round((1 << 31) * sample / n)))
    got = nodes.select("fp").where(share).limit(2 * sample).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    leaf, trees, first = max(8, len(got) * shard_rows // max(1, n)), [], 0
    for mask in block_masks(blocks, radius):
        trees.append(RoutingTree(got, mask, radius, leaf, first))
        first = trees[-1].next
    plan = spark.sparkContext.broadcast(trees)

    def route(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in plan.value:
                rows, shards, homes = tree.route(fps)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(homes.astype(bool))], names=["shard", "fp", "node", "home"])

    def search(batches):
        def links(parts):
            fps, ids, home = (np.concatenate(x) for x in zip(*parts))
            a, b = shard_links(fps.view(np.uint64), ids, home, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        now, parts = None, []
        for batch in batches:  # sorted by shard: a shard is a run of rows
            shard, fp, node, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.concatenate(([0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)]))
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if now is not None and shard[s] != now:
                    yield links(parts)
                    parts = []
                now = shard[s]
                parts.append((fp[s:e], node[s:e], home[s:e]))
        if parts:
            yield links(parts)

    routed = nodes.select("fp", "node").mapInArrow(route, "shard int, fp long, node long, home boolean")
    routed = routed.repartition("shard").sortWithinPartitions("shard")
    return routed.mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies) for each row of ``docs`` (doc_id, text).

    Defined results: null and wordless texts have fingerprint zero and link to each other like any other; repeated rows and
    equal texts share a component; rows with a null doc_id link like any other, and name no component (component_id is null where a
    component has no other rows); other columns are not looked at; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs), "simhash_fps")
    groups = materialize(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node"), F.count(F.lit(1)).alias("copies")), "simhash_nodes")
    edges = materialize(link_edges(groups.select("fp", F.col("fp").alias("node")), radius, blocks, sample, shard_rows), "simhash_edges")
    # Fingerprints are the vertices, so that one that only rows without an id hold links others, too; then each component gets its smallest id.
    labels = components(edges)
    roots = labels.select(F.col("component").alias("vertex"), "component").distinct()
    labels = labels.unionByName(roots).distinct()  # a component's own vertex may stand there or not
    linked = materialize(labels.join(groups, labels["vertex"] == groups["fp"]).select("fp", "node", F.col("component").alias("of")), "simhash_linked")
    names = linked.groupBy("of").agg(F.min("node").alias("least")).withColumnRenamed("of", "n_of")
    least = linked.join(names, linked["of"] == names["n_of"]).select(F.col("fp").alias("l_fp"), "least")
    named = groups.join(least, groups["fp"] == least["l_fp"], "left").select("fp", "copies", F.when(F.col("l_fp").isNull(), F.col("node")).otherwise(F.col("least")).alias("component_id"))
    named = materialize(named, "simhash_named")
    discard(edges, linked)
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the row with its smallest doc_id; of several rows with that id any one.

    Rows without an id stay.
    """
    found = materialize(near_duplicates(docs, **options).select("doc_id", "component_id"), "simhash_found")
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__pl_drop_id")).distinct()
    # The list grows with the corpus, so it is never broadcast: the join is a merge at every size.
    rest = docs.join(drop.hint("merge"), docs["doc_id"] == drop["__pl_drop_id"], "left_anti")
    twice = materialize(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__pl_twice_id")), "simhash_twice")
    if not twice.limit(1).count():
        return rest
    same = rest["doc_id"] == twice["__pl_twice_id"]
    return rest.join(twice, same, "left_anti").unionByName(rest.join(twice, same, "left_semi").dropDuplicates(["doc_id"]))

"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of hashed rows: of the word and of its first 4 and 5 letters (toxic stems take many endings).
Filters of widths 1, 2 and 3 run over the word sequence; each filter's maximum over the whole text goes through a rectifier
to a logistic unit. As a filter is linear before the maximum, its products with a word's embedding are kept per word, so the scan
gathers and adds. Hash buckets are many (2**26) and only those met in training have rows; the others are zero.

It learns from all labelled training rows. Up to ``share`` of them are one worker's task. Of more, the buckets are counted over all rows; a first worker
learns from its share, then every worker goes on from there with its own share of all rows, and the weights are averaged: of a bucket's row by how
many texts have it. A fifth of the rows is held back and sets a threshold for each language, at the best F1; past one share it is counted in steps of
1/10,000 of score. Language is looked at in that threshold only, never in a score.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, ship, utf8
from plumbline.llm.decontaminate import words_of
from plumbline.llm.lm import head_threshold

DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
SHARE = 3600  # training rows a worker
MAX_CHARS = 1 << 31  # no text is too long to learn from
BUCKETS = 200_000  # rows of a model: of more buckets, those in the most texts
MORE_EPOCHS = 2  # over a worker's share, after the first worker's
TOGETHER = 2  # workers a task, whose weights are summed before they are sent
CELLS = 10_000
_UNIT = 1 << 20
LEAST_EPOCHS, MOST_EPOCHS, STEPS, BATCH = 5, 40, 600, 32
PAD = max(WIDTHS)  # places without a word after each text, so that no filter reaches into the next
CUT = 0.7
LEAST_TEXTS = 3  # a bucket is learned if at least so many training texts have it
WORD_DROP = 0.4  # share of a batch's words that are hidden, so that no word is left out because another one explains the text
SLOW = 1e-3  # start of the squared gradients of embeddings: the larger, the less a few texts move a row
_BUCKETS = (1 << 26) - 1
_CACHE_WORDS = 250_000


def features(word: bytes) -> tuple[int, ...]:
    """Buckets of a lower-case word; bytes stand in for letters, so a stem may end within one."""
    h = xxhash.xxh3_64_intdigest
    return tuple({h(word, 1) & _BUCKETS, h(word[:4], 2) & _BUCKETS, h(word[:5], 3) & _BUCKETS})


class ToxicityModel:
    """Weights; ``buckets`` is sorted and ``table`` has a last row of zeros for buckets not met."""

    def __init__(self, buckets: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets = buckets
        self.table = rng.normal(0, 0.1, (len(buckets) + 1, DIM)).astype(np.float32)
        self.table[-1] = 0
        self.conv = rng.normal(0, 0.3, (sum(WIDTHS), DIM, FILTERS)).astype(np.float32)  # a matrix for each offset of each width
        self.shift = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1.0)
        self.thresholds: dict[str, float] = {}

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.buckets, buckets)
        at[at == len(self.buckets)] = 0
        return np.where(self.buckets[at] == buckets, at, len(self.buckets)) if len(self.buckets) else np.zeros(len(buckets), dtype=np.int64)

    def embed(self, words: list[bytes]) -> np.ndarray:
        each = [features(w) for w in words]
        n = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = self.rows(np.fromiter((b for f in each for b in f), dtype=np.int64, count=int(n.sum())))
        return np.add.reduceat(self.table[flat], np.cumsum(n) - n, axis=0) if len(each) else np.zeros((0, DIM), np.float32)

    def products(self, emb: np.ndarray) -> np.ndarray:
        """Per word the products with every matrix: offsets of width 1, then of width 2, then of width 3."""
        return emb @ self.conv.transpose(1, 0, 2).reshape(DIM, -1)

    def pooled(self, p: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Filter maxima of the texts that start at ``starts`` of ``p``. PAD zero rows stand after each text; filters start at its words and at the first of those."""
        cuts = np.stack((starts, np.append(starts[1:], len(p)) - PAD + 1), axis=1).ravel()
        out, sums, k = [], [], 0
        for w in WIDTHS:
            s = p[:, FILTERS * k : FILTERS * (k + 1)].copy()
            for j in range(1, w):
                s[:-j] += p[j:, FILTERS * (k + j) : FILTERS * (k + j + 1)]
            k += w
            sums.append(s)
            out.append(np.maximum.reduceat(s, cuts, axis=0)[::2])
        return np.concatenate(out, axis=1), sums

    def logits(self, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(p, starts)[0] + self.shift, 0) @ self.out + self.bias


def layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of several texts one after the other, number 0 (no word) PAD times after each; and their starts."""
    n = np.fromiter((len(t) + PAD for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(n)
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    for t, e in zip(texts, ends):
        ids[e - PAD - len(t) : e - PAD] = t
    return ids, ends - n


def fit(rows: list[tuple[str | None, int, str | None]], steps: int = STEPS, seed: int = 7, cut: float = CUT, met: np.ndarray | None = None, start: ToxicityModel | None = None, held: np.ndarray | None = None) -> ToxicityModel:
    """``rows``: (text, label 0 or 1, language). Without any row of either label every score is low.

    ``met``: the buckets to learn, if they were counted over more rows; ``start``: a model to go on from; ``held``: rows that only set thresholds, every fifth if not given.
    """
    vocab: dict[bytes, int] = {}
    texts = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(t and t.encode())], dtype=np.int64) for t, _, _ in rows]
    label = np.array([y for _, y, _ in rows], dtype=np.float32)
    each = [features(w) for w in vocab]
    if met is None:  # buckets of too few texts would only tell the training texts apart
        met, times = buckets_of(texts, each)
        met = met[times >= LEAST_TEXTS]
    model = start or ToxicityModel(met, seed)
    if not len(met) or not label.any() and start is None:
        model.bias = np.float32(-5)
        return model
    n_feat = np.array([0, *map(len, each)])
    flat = model.rows(np.array([b for f in each for b in f], dtype=np.int64))
    first = np.cumsum(n_feat) - n_feat
    grad2, bias2 = getattr(model, "grad2", None) or ({k: np.full_like(getattr(model, k), SLOW if k == "table" else 1e-6) for k in ("table", "conv", "shift", "out")}, 1e-6)
    rng = np.random.default_rng(seed)
    held = np.arange(len(rows)) % 5 == 4 if held is None else held
    train = np.nonzero(~held)[0]
    epochs = min(MOST_EPOCHS, max(LEAST_EPOCHS, -(-steps * BATCH // max(1, len(train))))) if start is None else MORE_EPOCHS
    weight = np.where(label > 0, min(4.0, max(1.0, 0.5 * (len(label) - label.sum()) / max(1, label.sum()))), 1.0).astype(np.float32)
    cols = np.arange(len(WIDTHS) * FILTERS)

    def word_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = n_feat[ids]
        at = np.repeat(first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return flat[at], np.repeat(np.arange(len(ids)), n)

    for epoch in range(epochs):
        rate = 0.1 * (1 - epoch / epochs) + 0.01
        order = rng.permutation(train)
        for k in range(0, len(order), BATCH):
            pick = order[k : k + BATCH]
            ids, starts = layout([texts[i] for i in pick])
            uniq, inv = np.unique(ids, return_inverse=True)
            f, owner = word_rows(uniq)
            emb = np.zeros((len(uniq), DIM), dtype=np.float32)
            emb[n_feat[uniq] > 0] = np.add.reduceat(model.table[f], np.nonzero(np.diff(owner, prepend=-1))[0], axis=0)
            seen = rng.random(len(uniq)) >= WORD_DROP
            emb[~seen] = 0
            pool, sums = model.pooled(model.products(emb)[inv], starts)
            act = np.maximum(pool + model.shift, 0)
            z = act @ model.out + model.bias
            dz = (1 / (1 + np.exp(-z)) - label[pick]) * weight[pick] / len(pick)
            g_out, d_act = act.T @ dz, dz[:, None] * model.out * (act > 0)
            g_conv, g_emb = np.zeros_like(model.conv), np.zeros_like(emb)
            # where each maximum stood
            ends = np.append(starts[1:], len(ids)) - PAD + 1
            place = np.empty(pool.shape, dtype=np.int64)
            for i, (a, b) in enumerate(zip(starts, ends)):
                for w_at, s in enumerate(sums):
                    place[i, FILTERS * w_at : FILTERS * (w_at + 1)] = a + np.argmax(s[a:b], axis=0)
            m = 0
            for w_at, w in enumerate(WIDTHS):
                sl = slice(FILTERS * w_at, FILTERS * (w_at + 1))
                for j in range(w):
                    word = inv[place[:, sl] + j]
                    d = d_act[:, sl]
                    g_conv[m] = np.einsum("nfd,nf->df", emb[word], d)
                    np.add.at(g_emb, word.ravel(), (d[:, :, None] * model.conv[m].T[None]).reshape(-1, DIM))
                    m += 1
            moved = np.nonzero(seen & (np.abs(g_emb).sum(1) > 0))[0]
            moved = moved[uniq[moved] > 0]
            f, owner = word_rows(uniq[moved])
            rows_f, back = np.unique(f, return_inverse=True)
            g_rows = np.zeros((len(rows_f), DIM), dtype=np.float32)
            np.add.at(g_rows, back, g_emb[moved][owner])
            grad2["table"][rows_f] += g_rows**2
            model.table[rows_f] -= rate * g_rows / np.sqrt(grad2["table"][rows_f])
            model.table[-1] = 0
            for name, g in (("conv", g_conv), ("shift", d_act.sum(0)), ("out", g_out)):
                grad2[name] += g**2
                getattr(model, name)[...] -= rate * g / np.sqrt(grad2[name])
            bias2 += float(dz.sum()) ** 2
            model.bias -= np.float32(rate * dz.sum() / np.sqrt(bias2))
    model.grad2 = grad2, bias2
    if start is None and held.any():
        emb = np.concatenate([np.zeros((1, DIM), np.float32), model.embed(list(vocab))])
        ids, starts = layout([texts[i] for i in np.nonzero(held)[0]])
        score = 1 / (1 + np.exp(-model.logits(model.products(emb)[ids], starts)))
        langs = np.array([x or "" for _, _, x in rows])[held]
        for lang in sorted(set(langs)):
            model.thresholds[lang] = best_threshold(score[langs == lang], label[held][langs == lang], cut)
    return model


def buckets_of(texts: list[np.ndarray], each: list[tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of texts (word numbers from 1) and how many texts have each; ``each``: the words' buckets."""
    bucket_of = [np.array(f) for f in each]
    per_text = [np.unique(np.concatenate([bucket_of[i - 1] for i in np.unique(t)])) for t in texts if len(t)]
    return np.unique(np.concatenate(per_text) if per_text else np.zeros(0, dtype=np.int64), return_counts=True)


def best_threshold(score: np.ndarray, label: np.ndarray, default: float = CUT) -> float:
    """The middle of the gap at the best F1; ``default`` without positives."""
    if not label.any():
        return default
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + label.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # a cut can't part equal scores
    k = int(np.argmax(f1))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


class Scanner:
    """Scores texts; keeps the products of words it has met."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.p = np.zeros((1024, sum(WIDTHS) * FILTERS), dtype=np.float32)
        self.n = 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            new = list(dict.fromkeys(w for w in words if w not in ids))
            while self.n + len(new) > len(self.p):
                self.p = np.concatenate([self.p, np.zeros_like(self.p)])
            self.p[self.n : self.n + len(new)] = self.model.products(self.model.embed(new))
            for w in new:
                ids[w] = self.n
                self.n += 1
            return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))

    def scores(self, texts: list[bytes | None], most: int = 200_000) -> np.ndarray:
        out, some, size = [], [], 0

        def flush():
            ids, starts = layout(some)
            out.append(1 / (1 + np.exp(-self.model.logits(self.p[ids], starts).astype(np.float64))))

        for t in texts:
            if self.n > _CACHE_WORDS or size > most:
                if some:
                    flush()
                some, size = [], 0
                if self.n > _CACHE_WORDS:
                    self._clear()
            some.append(self.numbers(words_of(t)))
            size += len(some[-1])
        if some:
            flush()
        return np.concatenate(out) if out else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, in_training) -> DataFrame:
    """(o, text, y, lang) of all labelled training rows with a text; o is a hash of text and doc_id."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumnRenamed("doc_id", "l_id")
    rows = docs.where(in_training).where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text", "doc_id").alias("o"), "text", F.col("lang").cast("string").alias("lang"))
    return materialize(rows.join(known.hint("merge"), F.col("doc_id") == F.col("l_id")).select("o", "text", F.col("y").cast("int").alias("y"), "lang"), "tox_rows")


def _part(batches) -> list[tuple[int, str, int, str | None]]:
    """A worker's rows, repeated ones once, in an order of their own."""
    rows = {tuple(r.values()) for b in batches for r in b.to_pylist()}
    return sorted(rows, key=lambda r: (xxhash.xxh3_64_intdigest(r[1].encode(), 5), r[0], r[2], r[3] or ""))


def _held(rows) -> np.ndarray:
    return np.array([r[0] % 5 == 4 for r in rows], dtype=bool)


def learn(rows: DataFrame, cut: float = CUT, share: int = SHARE) -> ToxicityModel:
    """The model of all ``rows`` (o, text, y, lang); the driver holds a model, and no text."""
    spark = rows.sparkSession
    n = rows.count()
    workers = max(1, -(-n // share))

    def first(batches):
        part = _part(batches)
        if not part:
            return
        got = fit([r[1:] for r in part], cut=cut) if workers == 1 else fit([r[1:] for r in part], cut=cut, met=sent.value, held=_held(part))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["model"])

    if workers == 1:
        got = rows.repartition(1).mapInArrow(first, "model binary").collect()  # one row
        return pickle.loads(got[0]["model"]) if got else fit([], cut=cut)

    def count(batches):
        vocab: dict[bytes, int] = {}
        for b in batches:
            texts = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(t)], dtype=np.int64) for t in utf8(b.column(0))]
            met, times = buckets_of(texts, [features(w) for w in vocab])
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(times.astype(np.int64))], names=["bucket", "times"])
            vocab.clear()

    counted = rows.select("text").mapInArrow(count, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("c"))
    counted = materialize(counted.where(F.col("c") >= LEAST_TEXTS), "tox_buckets")
    met = np.sort(counted.where(F.col("c") >= head_threshold(counted, BUCKETS)).select("bucket").toArrow().column(0).to_numpy().astype(np.int64))
    sent = spark.sparkContext.broadcast(met)
    own = rows.where(F.pmod(F.xxhash64(F.col("o"), F.lit(1)), F.lit(workers)) == 0).repartition(1)
    got = own.mapInArrow(first, "model binary").collect()  # one row
    model = pickle.loads(got[0]["model"]) if got else ToxicityModel(met)
    if model.bias == -5 and not hasattr(model, "grad2"):  # no row with label 1 in that share
        model = ToxicityModel(met)
    begun = spark.sparkContext.broadcast(pickle.dumps(model))
    names = ("conv", "shift", "out", "bias")
    cols = [f"x{k}" for k in range(DIM)]

    def go_on(batches):
        shares: dict[int, list] = {}
        for r in _part(batches):
            shares.setdefault(r[4], []).append(r)
        n = total = None
        for _, part in sorted(shares.items()):
            m = fit([r[1:4] for r in part], cut=cut, met=sent.value, start=pickle.loads(begun.value), held=_held(part))
            rest = np.concatenate([np.ravel(getattr(m, k)) for k in names])
            rest = np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)
            vocab: dict[bytes, int] = {}
            texts = [np.array([vocab.setdefault(w, len(vocab) + 1) for w in words_of(r[1].encode())], dtype=np.int64) for r in part]
            found, times = buckets_of(texts, [features(w) for w in vocab])
            at = m.rows(found)
            ok = at < len(m.buckets)
            slots = np.concatenate((at[ok], len(m.table) + np.arange(len(rest))))
            w = np.concatenate((times[ok], np.full(len(rest), len(part)))).astype(np.int64)
            if n is None:
                n, total = np.zeros(len(m.table) + len(rest), dtype=np.int64), np.zeros((len(m.table) + len(rest), DIM), dtype=np.int64)
            n[slots] += w
            total[slots] += np.round(np.concatenate((m.table[at[ok]], rest)).astype(np.float64) * _UNIT).astype(np.int64) * w[:, None]
        if n is not None:
            slots = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n[slots]), *[pa.array(total[slots, k]) for k in range(DIM)]], names=["slot", "n", *cols])

    tasks = -(-workers // TOGETHER)
    shares = rows.select("o", "text", "y", "lang", F.pmod(F.hash(F.xxhash64("o")), F.lit(workers)).alias("worker")).repartitionById(tasks, F.col("worker") % tasks)
    told = shares.mapInArrow(go_on, f"slot long, n long, {', '.join(f'{c} long' for c in cols)}")
    mean = told.groupBy("slot").agg(*[(F.sum(c) / F.sum("n") / _UNIT).cast("float").alias(c) for c in cols]).toArrow()  # a row a bucket: as long as the model
    slot, value = mean.column(0).to_numpy(), np.stack([mean.column(c).to_numpy() for c in cols], 1).astype(np.float32)
    of_table = slot < len(model.table)
    model.table[slot[of_table]] = value[of_table]
    rest = np.zeros((slot.max() + 1 - len(model.table), DIM), dtype=np.float32)
    rest[slot[~of_table] - len(model.table)] = value[~of_table]
    flat, at = rest.ravel(), 0
    for k in names:
        size = np.size(getattr(model, k))
        x = flat[at : at + size].reshape(np.shape(getattr(model, k)))
        setattr(model, k, np.float32(x) if k == "bias" else x.copy())
        at += size
    model.__dict__.pop("grad2", None)
    sent_model = spark.sparkContext.broadcast(model)

    def score(batches):
        scanner = Scanner(sent_model.value)
        for b in batches:
            cell = np.floor(scanner.scores(utf8(b.column(0))) * CELLS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(cell)], names=["y", "lang", "cell"])

    kept = rows.where(F.pmod("o", F.lit(5)) == 4).select("text", "y", "lang").mapInArrow(score, "y int, lang string, cell long")
    per = kept.groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "cell").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")).toArrow().to_pandas()
    for lang, x in per.groupby("lang"):
        s, hits, n = (x[c].to_numpy().astype(np.int64) for c in ("cell", "hits", "n"))
        label = np.concatenate([np.repeat([1.0, 0.0], [h, k - h]) for h, k in zip(hits, n)])
        model.thresholds[str(lang)] = best_threshold(np.repeat((s + 0.5) / CELLS, n), label, cut)
    return model


def held_out(doc_id, n: int, k: int):
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n == k, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, cut: float = CUT, share: int = SHARE) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold and flagged for each row of ``docs`` (doc_id, text, lang).

    ``predicted`` is score >= ``cut``; ``flagged`` is score >= the language's calibrated threshold (``cut`` for a language without
    labelled rows). Defined results: null and empty texts get the score of a text without words; a null doc_id hashes as the
    empty string and is no training row; labels other than 0 and 1 are ignored, of several for one id the highest holds. Repeated rows
    have equal results; an empty table gives an empty one; other columns than the three are not read. A text of any length is scored
    and learned from whole. Repeated training rows are learned from once; a worker learns from ``share`` of them.
    """
    spark = docs.sparkSession
    ship(spark)
    out = held_out(F.col("doc_id"), folds, fold)
    trained = learn(training_rows(docs, labels, ~out), cut, share)
    trained.__dict__.pop("grad2", None)
    model = spark.sparkContext.broadcast(trained)
    pairs = model.value.thresholds

    def scan(batches):
        scanner = Scanner(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(scanner.scores(utf8(b.column(3))))], names=["doc_id", "held_out", "lang", "score"])

    slim = docs.select("doc_id", out.alias("held_out"), F.col("lang").cast("string").alias("lang"), "text")
    scored = slim.mapInArrow(scan, slim.drop("text").schema.add("score", "double"))
    threshold = F.lit(cut)
    for lang, t in sorted(pairs.items()):
        threshold = F.when(F.coalesce("lang", F.lit("")) == lang, F.lit(t)).otherwise(threshold)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))

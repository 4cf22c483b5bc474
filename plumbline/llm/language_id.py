"""Language identification of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes (up to three letters of either end), its letter pairs and triples with word bounds, and the
word itself (the lexicon). A run of over ``PIECE`` letters without white space is cut into several positions; no letter is passed over. Their learned weights add up to an emission score for each language; learned transition scores join
neighbours. Forward-backward gives each word's probabilities; a text's language is the one with the largest mean
over its words, and that mean is the score. Both passes run over many texts at once, position by position.

Training: at most ``per_lang`` labelled texts of each language (of at most ``max_chars`` characters, by the hash of the text), cut into
runs of words that are put together at random, so that transitions are learned from text that changes its language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.llm.common import below, materialize, sample_texts, ship

PER_LANG, MAX_CHARS, MAX_WORDS = 250, 8_000, 240_000
MAX_ROWS = 20_000  # of all languages: what the driver holds and broadcasts
STEPS, SEQ, BATCH = 3, 32, 128
PIECE = 64  # letters a position
_CACHE_WORDS, _GRID_WORDS = 300_000, 150_000
_STRIP = "".join(map(chr, range(0x21, 0x30))) + ":;<=>?@[\\]^_`{|}~«»„“”‚‘’…–—¡¿0123456789"


def pieces(w: str) -> list[str]:
    """A word of any length as positions of at most ``PIECE`` letters; neighbours share two letters, so that each triple is in one of them."""
    return [w] if len(w) <= PIECE else [w[k : k + PIECE] for k in range(0, len(w) - 2, PIECE - 2)]


def words_of(text: str) -> list[str]:
    """Lower-case words without punctuation about them, long ones in pieces; words without a letter are passed over."""
    words = [w for x in text.lower().split() if (w := x.strip(_STRIP)) and not w.isnumeric()]
    return [p for w in words for p in pieces(w)] if any(len(w) > PIECE for w in words) else words


def features(w: str) -> list[str]:
    s = f"\x02{w}\x03"
    out = [f"w{w}"]
    out += [f"p{w[:k]}" for k in (1, 2, 3)] + [f"s{w[-k:]}" for k in (1, 2, 3)]
    out += map("".join, zip(s, s[1:]))
    out += map("".join, zip(s, s[1:], s[2:]))
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Crf:
    """weights[feature] and transition scores over ``langs``."""

    def __init__(self, langs: list[str]):
        self.langs, self.index = langs, {}
        self.weights = np.zeros((1, len(langs)), dtype=np.float64)
        self.trans = np.zeros((len(langs), len(langs)))
        self.prior = np.zeros(len(langs))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words; features that were not learned count nothing."""
        get = self.index.get
        each = [[i for i in map(get, features(w)) if i is not None] or [0] for w in words]
        n = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
        flat = np.fromiter((i for e in each for i in e), dtype=np.int64, count=int(n.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0) if len(each) else np.zeros((0, len(self.langs)))

    def marginals(self, emit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward. emit: exp'd scores (position, text, language), texts in falling order of length; returns the same shape."""
        return forward_backward(emit, lengths, np.exp(self.trans - self.trans.max()), np.exp(self.prior - self.prior.max()))[0]


def forward_backward(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals, scaled forward, scaled backward); rows past a text's end are left zero."""
    steps = emit.shape[0]
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # texts that reach position t
    a = emit[0] * prior
    alpha[0] = a / a.sum(1, keepdims=True)
    for t in range(1, steps):
        k = live[t]
        a = (alpha[t - 1, :k] @ trans) * emit[t, :k]
        a /= a.sum(1, keepdims=True)
        alpha[t, :k] = a
    back = trans.T
    beta[steps - 1, : live[steps - 1]] = 1
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        b = (beta[t + 1, :k] * emit[t + 1, :k]) @ back
        b /= b.sum(1, keepdims=True)
        beta[t, :k] = b
        beta[t, k : live[t]] = 1
    post = alpha * beta
    total = post.sum(2, keepdims=True)
    np.divide(post, total, out=post, where=total > 0)
    return post, alpha, beta


def scaled(scores: np.ndarray) -> np.ndarray:
    """exp of scores against each row's largest, not below 1e-12, so that no row vanishes."""
    return np.exp(np.maximum(scores - scores.max(-1, keepdims=True), -27.0))


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 11, max_words: int = MAX_WORDS) -> Crf:
    """``rows``: (text, language)."""
    langs = sorted({lang for _, lang in rows})
    crf, rng = Crf(langs), np.random.default_rng(seed)
    if not langs:
        return crf
    vocab: dict[str, int] = {}
    runs: list[tuple[np.ndarray, int]] = []
    share = max(1, max_words // len(langs))
    used = dict.fromkeys(langs, 0)
    for text, lang in rows:
        if used[lang] >= share:
            continue
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in words_of(text)], dtype=np.int64)
        used[lang] += len(ids)
        cut = 0
        while cut < len(ids):
            n = int(rng.integers(4, 2 * SEQ))
            runs.append((ids[cut : cut + n], langs.index(lang)))
            cut += n
    if not vocab:
        return crf
    each = [features(w) for w in vocab]
    times: dict[str, int] = {}
    for f in each:
        for x in set(f):
            times[x] = times.get(x, 0) + 1
    crf.index = {x: i + 1 for i, x in enumerate(x for x, n in times.items() if n > 1 or x[0] == "w")}
    crf.weights = np.zeros((len(crf.index) + 1, len(langs)))
    known = [[crf.index[x] for x in f if x in crf.index] for f in each]
    n_feat = np.array([len(k) for k in known])
    flat = np.array([i for k in known for i in k], dtype=np.int64)
    first = np.cumsum(n_feat) - n_feat
    grad_w, grad_t = np.full_like(crf.weights, 1e-3), np.full_like(crf.trans, 1e-3)
    for step in range(steps):
        order = rng.permutation(len(runs))
        ids = np.concatenate([runs[i][0] for i in order])
        gold = np.concatenate([np.full(len(runs[i][0]), runs[i][1]) for i in order])
        n_seq = max(1, len(ids) // SEQ)
        if len(ids) < SEQ:
            seqs, golds = ids[None], gold[None]
        else:
            seqs, golds = ids[: n_seq * SEQ].reshape(n_seq, SEQ), gold[: n_seq * SEQ].reshape(n_seq, SEQ)
        rate = 0.3 / (1 + step)
        for k in range(0, len(seqs), BATCH):
            x, y = seqs[k : k + BATCH].T, golds[k : k + BATCH].T
            uniq, inv = np.unique(x, return_inverse=True)
            n = n_feat[uniq]
            f = flat[np.repeat(first[uniq] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            emit_u = np.add.reduceat(crf.weights[f], np.cumsum(n) - n, axis=0)
            emit = scaled(emit_u[inv.reshape(x.shape)])
            trans = np.exp(crf.trans - crf.trans.max())
            post, alpha, beta = forward_backward(emit, np.full(x.shape[1], x.shape[0]), trans, np.ones(len(langs)))
            d = post.copy()
            np.put_along_axis(d, y[:, :, None], np.take_along_axis(d, y[:, :, None], 2) - 1, 2)
            g_u = np.stack([np.bincount(inv.ravel(), d[:, :, c].ravel(), len(uniq)) for c in range(len(langs))], 1)
            g_rows = np.repeat(g_u, n, axis=0)
            g = np.stack([np.bincount(f, g_rows[:, c], len(crf.weights)) for c in range(len(langs))], 1)
            g += 1e-4 * crf.weights
            grad_w += g * g
            crf.weights -= rate * g / np.sqrt(grad_w)
            if len(x) > 1:
                pair = alpha[:-1, :, :, None] * trans * (emit[1:] * beta[1:])[:, :, None, :]
                pair /= pair.sum((2, 3), keepdims=True)
                g_t = pair.sum((0, 1))
                np.add.at(g_t, (y[:-1].ravel(), y[1:].ravel()), -1.0)
                grad_t += g_t * g_t
                crf.trans -= rate * g_t / np.sqrt(grad_t)
    crf.weights[0] = 0
    return crf


class Tagger:
    """Labels texts; keeps the emissions of words it has met."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.emit = np.zeros((1024, max(1, len(self.crf.langs))))
        self.n = 0

    def numbers(self, words: list[str]) -> np.ndarray:
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
        except KeyError:
            new = list(dict.fromkeys(w for w in words if w not in ids))
            while self.n + len(new) > len(self.emit):
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.emit[self.n : self.n + len(new)] = scaled(self.crf.emissions(new))
            for w in new:
                ids[w] = self.n
                self.n += 1
            return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))

    def words(self, text: str | None) -> list[tuple[str, str, float]]:
        """(word, language, probability) along a text."""
        w = words_of(text or "")
        if not w or not self.crf.langs:
            return []
        p = self.crf.marginals(self.emit_of(w)[:, None], np.array([len(w)]))[:, 0]
        return [(x, self.crf.langs[k], float(q[k])) for x, q in zip(w, p) for k in [int(q.argmax())]]

    def emit_of(self, w: list[str]) -> np.ndarray:
        i = self.numbers(w)
        return self.emit[i]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: `und` and 0 if it has no letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        waiting: list[tuple[int, np.ndarray]] = []
        for k, t in enumerate(texts):
            if self.n > _CACHE_WORDS:
                self._run(waiting, out)
                waiting = []
                self._clear()
            if self.crf.langs and has_letter(t):
                waiting.append((k, self.numbers(words_of(t) or [p for x in t.lower().split() for p in pieces(x)])))
        self._run(waiting, out)
        return out

    def _run(self, waiting: list[tuple[int, np.ndarray]], out: list) -> None:
        waiting.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(waiting):
            longest = len(waiting[at][1])
            some = waiting[at : at + max(1, _GRID_WORDS // longest)]
            at += len(some)
            lengths = np.array([len(i) for _, i in some])
            grid = np.zeros((longest, len(some)), dtype=np.int64)
            for c, (_, i) in enumerate(some):
                grid[: len(i), c] = i
            mean = self.crf.marginals(self.emit[grid], lengths).sum(0) / lengths[:, None]
            for (k, _), m in zip(some, mean):
                c = int(m.argmax())
                out[k] = (self.crf.langs[c], min(1.0, float(m[c])))


def training_rows(docs: DataFrame, in_training, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """At most ``per_lang`` (text, lang) of each language, those with the smallest hashes.

    Languages are counted first; then only a share of each language's hashes, with a few times the rows wanted, is ranked. Of very many languages the
    most frequent are learned.
    """
    rows = docs.where(in_training & F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= max_chars))
    rows = materialize(rows.select("doc_id", "lang", F.xxhash64("text", "doc_id").alias("o")), "lid_candidates")
    few = F.lit(False)
    for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_ROWS // per_lang).collect():
        few = few | ((F.col("lang") == r["lang"]) & below(F.col("o"), per_lang, r["n"]))
    order = Window.partitionBy("lang").orderBy(F.pmod("o", F.lit(1 << 31)), "o", "doc_id")
    ids = rows.where(few).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_lang)
    return [(r["text"], r["lang"]) for r in sample_texts(docs, ids.select("doc_id", "o").limit(MAX_ROWS), "lang")]


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang).

    Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing was labelled; rows with a
    null language or id are not learned from; ties go to the language that is first in order. Repeated rows have equal results, and
    count as often as they stand there where labelled rows are drawn; an empty table gives an empty one; other columns than the three are not read. A
    text of any length is labelled whole, by one task that holds its words' features.
    """
    spark = docs.sparkSession
    ship(spark)
    out = F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold, F.lit(False))
    rows = training_rows(docs, ~out & F.col("doc_id").isNotNull(), **options)
    rows.sort(key=lambda r: xxhash.xxh3_64_intdigest(r[0].encode(), 5))
    crf = spark.sparkContext.broadcast(fit(rows))

    def scan(batches):
        tagger = Tagger(crf.value)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                langs, scores = zip(*tagger.label(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select("doc_id", out.alias("held_out"), "text")
    return slim.mapInArrow(scan, slim.drop("text").schema.add("lang_pred", "string").add("score", "double"))

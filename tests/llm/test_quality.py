import math
import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality
from plumbline.llm.common import materialize


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [None, "", "\n\n", "a b c a b c", "a a a a a", "x", "a b", "one # two\n\none # two\none # two ", "é\x85ü \xa0 ß\r\nq\rq\n", "a b c d a b c d a b " * 9, "w | w | w | <b>"]


@pytest.mark.parametrize("text", TEXTS)
def test_measure(text):
    assert quality.measure(text)[:5] == plain(text)


def test_measure_at_random():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "\t", "é", "a b", "c "]) for _ in range(rng.randint(0, 60)))
        assert quality.measure(text)[:5] == plain(text)


def plain_bound(k, n, level):
    """The share at which at most k of n has probability ``level``, from the binomial sum itself."""
    cdf = lambda p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) > level else (lo, mid)
    return hi


@pytest.mark.parametrize("k,n", [(0, 1), (0, 50), (1, 50), (7, 300), (49, 50), (30, 1000)])
def test_bound_is_exact(k, n):
    for level in (0.05, 1e-4):
        assert quality.false_rejection_bound(k, n, level) == pytest.approx(plain_bound(k, n, level), rel=1e-9)
    assert quality.false_rejection_bound(5, 5, 0.01) == 1.0 == quality.false_rejection_bound(0, 0, 0.01)


def test_bound_covers_as_promised():
    """Of many labelled sets, the bound falls short of the true share in no more than the level's part."""
    rng, p, n, level = random.Random(3), 0.02, 400, 0.1
    short = sum(quality.false_rejection_bound(sum(rng.random() < p for _ in range(n)), n, level) < p for _ in range(2000))
    assert short / 2000 < level


def test_propose():
    counts = [("en", "symbols", 0, 1000, 0), ("en", "symbols", 30, 4, 20), ("en", "symbols", 60, 0, 50), ("en", "repeats", 5, 1004, 2), ("de", "symbols", 9, 3, 2)]
    assert quality.propose(counts) == {"en": [{"symbols": 37}, {"symbols": 30}, {"symbols": 0}]} and quality.propose([]) == {}
    # lenient steps add a rule each, the best finder first; then the margins go; steps are nested
    more = [*counts, ("en", "one_word", 10, 1004, 0), ("en", "one_word", 80, 0, 70)]
    steps = quality.propose(more)["en"]
    assert steps[:4] == [{"one_word": 19}, {"one_word": 19, "symbols": 37}, {"one_word": 10, "symbols": 37}, {"one_word": 10, "symbols": 30}]
    assert all(x.keys() <= y.keys() and all(y[r] <= x[r] for r in x) for x, y in zip(steps, steps[1:]))
    # a rule that loses too many good documents in the end keeps its margin
    kept = quality.propose([("en", "repeats", 20, 900, 0), ("en", "repeats", 40, 100, 0), ("en", "repeats", 70, 0, 9)])["en"]
    assert kept[0] == {"repeats": 46} and kept[-1] == {"repeats": 40}


def test_select():
    level, later = 0.8 * 0.05, 0.2 * 0.05
    assert quality.select({"en": [(1000, 0, 50), (1000, 0, 50), (1000, 2, 70), (1000, 30, 900)]}, 1) == {"en": (2, quality.false_rejection_bound(2, 1000, later))}
    assert quality.select({"en": [(1000, 0, 50)]}, 1) == {"en": (0, quality.false_rejection_bound(0, 1000, level))}
    assert quality.select({"en": [(100, 0, 50)]}, 1) == {}  # too few to promise anything
    assert quality.select({"en": [(1000, 50, 99), (1000, 0, 50)]}, 1) == {}  # the first failure ends the test
    assert quality.select({"en": [(200, 0, 9)]}, 1) and not quality.select({"en": [(200, 0, 9)]}, 40)  # more strata, stricter levels
    # Holm: the surest stratum meets the strictest level, and the last one the whole; after a failure none passes
    assert set(quality.select({"a": [(400, 0, 9)], "b": [(300, 0, 9)], "c": [(170, 0, 9)]}, 3)) == {"a", "b", "c"}
    assert set(quality.select({"a": [(400, 0, 9)], "b": [(160, 0, 9)], "c": [(155, 0, 9)]}, 3)) == {"a"}


@pytest.mark.parametrize("k,n", [(0, 1), (0, 50), (3, 50), (50, 50)])
def test_chance_is_the_binomial_sum(k, n):
    want = sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) if k < n else 1.0
    assert quality.chance(k, n, 0.02) == pytest.approx(want, rel=1e-9)


def test_family_error_is_bounded():
    """All of four strata lose just more than alpha at every step: hardly a labelled set lets any cutoff through."""
    rng, alpha, wrong = random.Random(5), 0.02, 0
    for _ in range(1500):
        tests = {s: [(400, lost := sum(rng.random() < alpha * 1.001 for _ in range(400)), 50), (400, lost, 60)] for s in "abcd"}
        wrong += bool(quality.select(tests, 4))
    assert wrong / 1500 <= 0.05


BIG = Path("/root/testdata/sf0.1")


def plain_bins(text):
    c = dict(zip(quality.COUNTS, quality.measure(text)))
    share = lambda x, of: min(math.ceil(100 * x / max(of, 1)), 100)
    n = c["n_words"]
    out = {r: share(c[k], n) for r, k in (("symbols", "n_symbols"), ("repeats", "n_repeat_words"), ("capitals", "n_upper"), ("exclaims", "n_bang"), ("one_word", "n_common"))}
    return out | {"dup_lines": share(c["n_dup_lines"], c["n_lines"]), "long_words": min(4 * c["word_chars"] // n, 100)}


@pytest.mark.skipif(not BIG.exists(), reason="needs the larger tables")
def test_whole_query_at_sf01(spark):
    """Every row of the query against texts measured and cutoffs counted one by one; and what the cutoffs are worth on the holdout."""
    import xxhash

    from plumbline.llm.queries import QUERIES

    docs = [tuple(r) for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang").collect()]
    label = {}
    for i, x in spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality").collect():
        if x in (0, 1):
            label[i] = min(x, label.get(i, 1))
    texts = {}
    for i, t, lang in docs:
        if i in label and quality.passes(t, {}):
            own = texts.setdefault((lang, t), [label[i], None])
            own[0] = min(own[0], label[i])
    for (lang, t), own in texts.items():
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        signed = h - (1 << 64) if h >> 63 else h
        again = xxhash.xxh64_intdigest(signed.to_bytes(8, "little", signed=True), 42)
        own[1] = (again - (1 << 64) if again >> 63 else again) % quality.DESIGN == 0
    measured = {k: plain_bins(k[1]) for k in texts}
    counts = [(lang, r, b, int(texts[lang, t][0] == 1), int(texts[lang, t][0] == 0)) for (lang, t), m in measured.items() if texts[lang, t][1] for r, b in m.items()]
    family = quality.propose(counts)
    over = lambda m, cut: any(m[r] > c for r, c in cut.items())
    held = {s: [(m, texts[k][0]) for k, m in measured.items() if k[0] == s and not texts[k][1]] for s in family}
    tests = {s: [(sum(q for _, q in held[s]), sum(q == 1 and over(m, cut) for m, q in held[s]), sum(q == 0 and over(m, cut) for m, q in held[s])) for cut in steps] for s, steps in family.items()}
    chosen = {s: family[s][k] for s, (k, _) in quality.select(tests, len(family)).items()}
    got = {r["doc_id"]: (r["n_words"], r["kept"]) for r in QUERIES["op3_quality_rules"](spark, str(BIG)).collect()}
    assert got == {i: (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), quality.passes(t, chosen.get(lang, {}))) for i, t, lang in docs}
    assert {"en", "de", "fr", "es"} <= set(chosen)
    for s in chosen:
        bad = [over(m, chosen[s]) for m, q in held[s] if q == 0]
        good = [over(m, chosen[s]) for m, q in held[s] if q == 1]
        assert sum(bad) >= 0.6 * len(bad) and sum(good) <= quality.ALPHA * len(good)


def test_same_verdict_in_both_forms(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    cutoffs = [("en", "symbols", 5, 0.0), ("de", "long_words", 30, 0.0), (None, "capitals", 10, 0.0)]
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang")))
    m = quality.measures(docs).withColumn("kept", ~quality.base_failed() & (F.size(quality.verdict(cutoffs, F.col("stratum"))) == 0))
    by = {}
    for s, r, c, _ in cutoffs:
        by.setdefault(s, {})[r] = c
    text = {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    got = {r["doc_id"]: r["kept"] for r in m.collect()}
    assert got == {k: quality.passes(t, by.get(s, {})) for k, (t, s) in text.items()} and len(set(got.values())) == 2
    kept = {r["doc_id"] for r in quality.keep(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}


def test_rejects_bad_and_keeps_good(spark):
    """Enough labelled documents: the rule is found, within the promised loss."""
    rng = random.Random(4)
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(k, good + (" ### $$ %%" * 40 if k % 5 == 0 else " ### $$ %%" * (k % 97 == 0)) + f" {rng.random()}", "en") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(6000)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert sum(not got[k] for k in got if k % 5) <= 0.02 * 4800
    assert sum(got[k] for k in got if k % 5 == 0) <= 12


@pytest.mark.parametrize("distinct", [6, 3000])
def test_copies_count_once(spark, distinct):
    """Copies of a few labelled texts promise nothing where as many texts do, and a text with both labels is a bad one."""
    plain_words, symbols = " ".join(f"word{j}" for j in range(80)), " ".join(f"#{j}" for j in range(60))
    texts = [f"{k} {plain_words} {symbols if k % 2 else k}" for k in range(distinct)]
    docs = spark.createDataFrame([(k, texts[k % distinct], "en") for k in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0 and k != 2), 0) for k in range(3000)], "doc_id long, quality int, toxic int")
    cutoffs = quality.calibrate(materialize(quality.measures(docs), "t"), labels)
    assert [r for _, r, _, _ in cutoffs] == ([] if distinct == 6 else ["symbols"])
    assert quality.keep(docs, labels).count() == (3000 if distinct == 6 else 1500)


def test_clashing_columns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.withColumns({"counts": F.lit("x"), "Text_Hash": F.lit(1), "stratum": F.lit(None), "n_words": F.lit(0), "n_repeat_words": F.lit(9)})
    got = quality.keep(odd, labels)
    assert got.columns == odd.columns and {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in quality.keep(docs, labels).collect()}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, None, "k"), (1, "", "en", "k"), (1, "a " * 30_000, None, None), (2, "é" * 100_000, "xx", "k")], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (1, 5, 0), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels)
    assert got.count() == 4 and not got.where("kept").count()
    assert quality.keep(docs, labels.limit(0)).columns == docs.columns
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0
    fine = spark.createDataFrame([(None, " ".join(map(str, range(60))), None)], "doc_id long, text string, lang string")
    assert quality.keep(fine, labels).count() == 1

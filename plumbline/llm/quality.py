"""Quality rules whose cutoffs are risk-controlled on labelled documents.

Every rule rejects where a measure exceeds a cutoff. Labelled documents are parted by the hash of their text, and each distinct text
of a stratum counts once: copies are no independent evidence, and never stand on both sides. The design third
proposes, for each stratum (language), the rules that find bad documents there and a nested family of steps, lenient ones first: one rule after
another, the best finders first, with a cutoff well above all good design documents; then one after another without that margin;
then all with cutoffs that lose a growing share of the good design documents.

The holdout tests the family in this fixed order. A step is admissible while the exact (Clopper-Pearson) upper bound of its share of rejected
good documents, for all its rules together, is at most ``alpha``; the first step that fails ends the stratum's test. The first steps of all strata share
FIRST of ``delta`` by Holm's method, the strata's later steps the rest by Bonferroni, a fixed order needing no correction within a stratum. So with
probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good documents, whichever admissible step is then taken: the one that
rejects the most bad holdout documents less ``penalty`` times the good ones. A stratum with too few labelled documents gets no cutoff: it keeps what
passes the base rules.

Measures are taken once from whole texts; what is collected are counts per (stratum, rule, bin) and per (stratum, step).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, scratch_name, ship

BINS = 100
ALPHA, DELTA, PENALTY = 0.02, 0.05, 4
SHARES = (0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)  # of good design documents that the last steps lose
MARGIN = 0.1  # of the bins above the good design documents, which the first cutoffs leave out
FIRST = 0.8  # of delta for the strata's first steps
DESIGN = 3  # one labelled document in so many proposes cutoffs, the others test them
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_common")


def measure(text: str | None) -> tuple[int, ...]:
    """The COUNTS of a whole text; all zero for null."""
    text = text or ""
    words = [w for w in _SPACE.split(text) if w]
    n = len(words)
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip("\x20\t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            reached = 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeat += i + 3 - max(i, reached)
                    reached = i + 3
    top = Counter(words).most_common(1)[0][1] if n else 0
    upper = sum(map(str.isupper, words))
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeat, lines, upper, text.count("!") + text.count("?"), top


def counted(text: Column) -> Column:
    """struct of the COUNTS of a text."""

    @F.arrow_udf("struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">")
    def scan(texts: pa.Array) -> pa.Array:
        got = [measure(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))], names=list(COUNTS))

    return scan(text)


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, text_hash, COUNTS) of each row of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.xxhash64("text").alias("text_hash"), counted(F.col("text")).alias("counts"))
    return rows.select("doc_id", "stratum", "text_hash", "counts.*")


def base_failed(at: str = "") -> Column:
    """``at``: what stands before the COUNTS' names."""
    return (F.col(f"{at}n_words") < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))


def rules(at: str = "") -> dict[str, Column]:
    """Rule -> measure as an integer bin 0 .. BINS; higher is worse."""
    c = {name: F.col(f"{at}{name}") for name in COUNTS}
    words = F.greatest(c["n_words"], F.lit(1))

    def share(x: Column, of: Column) -> Column:
        return F.least(F.ceil(BINS * x / F.greatest(of, F.lit(1))), F.lit(BINS)).cast("int")

    return {
        "symbols": share(c["n_symbols"], words),
        "dup_lines": share(c["n_dup_lines"], c["n_lines"]),
        "repeats": share(c["n_repeat_words"], words),
        "capitals": share(c["n_upper"], words),
        "exclaims": share(c["n_bang"], words),
        "one_word": share(c["n_common"], words),
        "long_words": F.least(F.floor(4 * c["word_chars"] / words), F.lit(BINS)).cast("int"),
    }


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(2000):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def false_rejection_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a binomial share of which k of n were seen; 1 if n is 0."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        # P(X <= k; p) = 1 - I_p(k + 1, n - k)
        lo, hi = (mid, hi) if 1 - beta_cdf(k + 1, n - k, mid) > level else (lo, mid)
    return hi


Cutoffs = dict[str, int]


def propose(counts: list[tuple[str | None, str, int, int, int]], penalty: float = PENALTY) -> dict[str | None, list[Cutoffs]]:
    """stratum -> its steps, each a cutoff by rule, from the design documents' (stratum, rule, bin, good, bad).

    A rule must find three bad documents to be proposed: with the margin for the first steps; for the further ones, at the last share, and more
    than ``penalty`` times the good ones that it then rejects.
    """
    cells: dict[tuple, list[list[int]]] = {}
    for s, r, b, good, bad in counts:
        cell = cells.setdefault((s, r), [[0] * (BINS + 1), [0] * (BINS + 1)])
        cell[0][b] += good
        cell[1][b] += bad
    out: dict[str | None, list[Cutoffs]] = {}
    for s in {s for s, _ in cells}:
        lenient, tight, shared = [], [], {}
        for r in sorted(r for x, r in cells if x == s):
            good, bad = cells[s, r]
            n = sum(good)
            if not n:
                continue
            top = max(b for b, g in enumerate(good) if g)
            wide = min(BINS, top + max(2, math.ceil(MARGIN * (BINS - top))))
            found = sum(bad[wide + 1 :])
            if found >= 3:
                lenient.append((-found, r, wide))
            cuts = []
            for share in SHARES:
                cutoff = BINS
                while cutoff > 0 and sum(good[cutoff:]) <= share * n:
                    cutoff -= 1
                cuts.append(cutoff)
            hit, lost = sum(bad[cuts[-1] + 1 :]), sum(good[cuts[-1] + 1 :])
            if hit >= 3 and hit > penalty * lost:
                tight.append((-sum(bad[top + 1 :]), r, top))
                shared[r] = cuts
        steps: list[Cutoffs] = [{}]
        for _, r, cutoff in sorted(lenient) + sorted(tight):
            steps.append(steps[-1] | {r: cutoff})
        for k in range(len(SHARES) if shared else 0):
            steps.append(steps[-1] | {r: min(cuts[k], steps[-1].get(r, BINS)) for r, cuts in shared.items()})
        steps = [x for x, before in zip(steps[1:], steps) if x != before]
        if steps:
            out[s] = steps
    return out


def chance(lost: int, n: int, share: float) -> float:
    """Probability that of n documents at most ``lost`` are rejected, if ``share`` of all were; 1 of none."""
    return 1.0 if lost >= n else 1 - beta_cdf(lost + 1, n - lost, share)


def select(tests: dict[str | None, list[tuple[int, int, int]]], strata: int, alpha: float = ALPHA, delta: float = DELTA, penalty: float = PENALTY) -> dict[str | None, tuple[int, float]]:
    """stratum -> (step, bound) from each step's (good documents, rejected ones of them, rejected bad ones) of the holdout."""
    out: dict[str | None, tuple[int, float]] = {}
    strata = max(strata, len(tests))
    order = sorted((s for s in tests if tests[s]), key=lambda s: (chance(tests[s][0][1], tests[s][0][0], alpha), s is None, s or ""))
    for i, s in enumerate(order):
        best = 0.0
        for k, (n, lost, hit) in enumerate(tests[s]):
            level = FIRST * delta / (strata - i) if k == 0 else (1 - FIRST) * delta / strata
            if chance(lost, n, alpha) > level:
                break
            if hit - penalty * lost > best:
                best = hit - penalty * lost
                out[s] = k, false_rejection_bound(lost, n, level)
        else:
            k += 1
        if k == 0:  # Holm: where one first step fails, all that are less sure fail
            break
    return out


def calibrate(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> list[tuple[str | None, str, int, float]]:
    """(stratum, rule, cutoff, the stratum's bound) from all labelled rows of ``measured`` that pass the base rules. ``labels``: (doc_id, quality 0 or 1).

    Of several labels of a document, or of a text in a stratum, the lowest holds.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumnRenamed("doc_id", "l_id")
    rows = measured.where(~base_failed()).join(known, F.col("doc_id") == F.col("l_id"))
    # copies share their measures, so any of them stands for the text
    texts = rows.select("stratum", "text_hash", "quality", *[v.alias(k) for k, v in rules().items()]).groupBy("stratum", "text_hash").agg(*[F.min(c).alias(c) for c in ("quality", *rules())])
    rows = materialize(texts.withColumn("design", F.pmod(F.xxhash64("text_hash"), F.lit(DESIGN)) == 0).drop("text_hash"), "quality_labelled")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("bin")) for k in rules()])).alias("m")
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    counts = rows.where("design").select("stratum", "quality", each).groupBy("stratum", "m.rule", "m.bin").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    family = propose([tuple(r) for r in counts.collect()])
    if not family:
        return []
    hits = []
    longest = max(map(len, family.values()))
    for k in range(longest):
        over = F.lit(False)
        for s, steps in family.items():
            for rule, cutoff in steps[k].items() if k < len(steps) else ():
                over = over | (F.col("stratum").eqNullSafe(F.lit(s)) & (F.col(rule) > cutoff))
        hits += [F.count_if(good & over).alias(f"lost{k}"), F.count_if(bad & over).alias(f"hit{k}")]
    held = rows.where(~F.col("design")).groupBy("stratum").agg(F.count_if(good).alias("n"), *hits).collect()
    tests = {r["stratum"]: [(r["n"], r[f"lost{k}"], r[f"hit{k}"]) for k in range(len(family[r["stratum"]]))] for r in held if r["stratum"] in family}
    chosen = select(tests, len(family), alpha, delta)
    return [(s, rule, cutoff, bound) for s, (k, bound) in sorted(chosen.items(), key=lambda x: (x[0] is None, x[0] or "")) for rule, cutoff in sorted(family[s][k].items())]


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed, rejected_by (rule names) and kept for each row of ``docs``.

    Defined results: null text counts nothing and fails the base rules; a null stratum is a stratum; labels other than 0 and 1
    are ignored, and of several for one id the lowest holds; without labels nothing but the base rules rejects. Rows of equal
    text are judged alike, and repeated rows each have their own; an empty table gives an empty one; other columns are not read. A text
    of any length is measured whole, by one task, which holds its words and three-word windows.
    """
    measured = materialize(measures(docs, stratum), "quality")
    cutoffs = calibrate(measured, labels, alpha, delta)
    out = measured.withColumns({"base_failed": base_failed(), "rejected_by": verdict(cutoffs, F.col("stratum"))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def verdict(cutoffs: list[tuple[str | None, str, int, float]], stratum: Column, at: str = "") -> Column:
    """Array of the rules that reject a row."""
    failed = []
    for rule, value in rules(at).items():
        over = F.lit(False)
        for s, r, cutoff, _ in cutoffs:
            if r == rule:
                over = over | (stratum.eqNullSafe(F.lit(s)) & (value > cutoff))
        failed.append(F.when(over, F.lit(rule)))
    return F.array_compact(F.array(*failed))


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that are kept, whatever their ids and other columns: each row is judged by itself, and nothing is joined back.

    Texts are measured once; rows are written with their measures, of which the cutoffs and then the verdicts are taken.
    """
    ship(docs.sparkSession)
    counts, digest = scratch_name(docs, "counts"), scratch_name(docs, "text_hash")
    rows = materialize(docs.withColumns({counts: counted(F.col("text")), digest: F.xxhash64("text")}), "quality")
    of = F.col(stratum).cast("string")
    cutoffs = calibrate(rows.select("doc_id", of.alias("stratum"), F.col(digest).alias("text_hash"), f"{counts}.*"), labels, alpha, delta)
    at = f"{counts}."
    return rows.where(~base_failed(at) & (F.size(verdict(cutoffs, of, at)) == 0)).drop(counts, digest)


def passes(text: str | None, cutoffs: dict[str, int]) -> bool:
    """The verdict on one text, as ``judge`` gives it."""
    c = dict(zip(COUNTS, measure(text)))
    n = c["n_words"]
    if n < 50 or 100 * c["n_repeat_words"] > 50 * n:
        return False

    def share(x: int, of: int) -> int:
        return min(math.ceil(BINS * x / max(of, 1)), BINS)

    bins = {
        "symbols": share(c["n_symbols"], n),
        "dup_lines": share(c["n_dup_lines"], c["n_lines"]),
        "repeats": share(c["n_repeat_words"], n),
        "capitals": share(c["n_upper"], n),
        "exclaims": share(c["n_bang"], n),
        "one_word": share(c["n_common"], n),
        "long_words": min(4 * c["word_chars"] // n, BINS),
    }
    return all(bins[rule] <= cutoff for rule, cutoff in cutoffs.items())

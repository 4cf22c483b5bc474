"""The corpus pipeline, stage by stage against plain Python on its own input."""

import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from plumbline.llm import quality  # noqa: E402
from plumbline.llm.common import materialize, read  # noqa: E402
from plumbline.llm.tokenize import vocabulary_path  # noqa: E402
from tests.llm.test_decontaminate import plain as plain_leaks  # noqa: E402
from tests.llm.test_mixing import plain_targets, sizes_of  # noqa: E402
from tests.llm.test_simhash import plain_components, plain_fingerprint  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    out = [read(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), f"test_{name}"))
    return out


def rows(df):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mix_sources", "token_output"]


def test_quality(spark, sf, stages):
    before, after = rows(stages[0]), rows(stages[1])
    cutoffs = {}
    labels = read(spark, sf, "labels")
    for s, r, c, bound in quality.calibrate(materialize(quality.measures(stages[0]), "t"), labels):
        cutoffs.setdefault(s, {})[r] = c
        assert bound <= quality.ALPHA
    lang = {r["doc_id"]: r["lang"] for r in stages[0].collect()}
    assert after == [x for x in before if quality.passes(x[1], cutoffs.get(lang[x[0]], {}))] and 0 < len(after) < len(before)


def test_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    group = plain_components([plain_fingerprint(t) for _, t, _ in before])
    assert after == [x for k, x in enumerate(before) if group[k] == k] and len(after) < len(before)


def test_decontamination(spark, sf, stages):
    before, after = rows(stages[2]), rows(stages[3])
    items = [(r["item_id"], r["text"]) for r in read(spark, sf, "benchmark").collect()]
    hit = {r[0]: r for r in plain_leaks([(i, t) for i, t, _ in before], items) if r[5]}
    assert hit and [x for x in before if x[0] not in hit] == [x for x in after if x[0] not in hit]
    assert {x[0] for x in before} - {x[0] for x in after} == {i for i, r in hit.items() if 2 * r[2] >= r[1]}
    assert not any(r[5] for r in plain_leaks([(i, t) for i, t, _ in after if i in hit], items))


def test_mix(stages):
    before, after = rows(stages[3]), rows(stages[4])
    want, got = plain_targets(sizes_of(before)), sizes_of(after)
    longest = max(len(re.findall(r"\S+", t)) for _, t, _ in before)
    assert set(after) <= set(before) and max(after.count(x) for x in set(after)) <= 3
    assert all(abs(got.get(s, 0) - want[s]) <= longest for s in want)


def test_tokens(stages):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(vocabulary_path()), 0, []
    for i, text, _ in rows(stages[4]):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in stages[5].collect()) == want


def test_run(spark, sf, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[5].collect()))

"""Token counts, encoding and token files."""

import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import token_counts, token_files
from plumbline.llm.tokenize import ChunkEncoder, vocabulary_path


def greedy(pieces, text):
    """Longest match by trying every length; None if there is no cut."""
    n, at = 0, 0
    while at < len(text):
        k = next((k for k in range(len(text), at, -1) if text[at:k] in pieces), None)
        if k is None:
            return None
        n, at = n + 1, k
    return n


@given(st.sets(st.binary(min_size=1, max_size=5).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=12), st.lists(st.binary(max_size=14).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=20))
@settings(max_examples=300, deadline=None)
def test_longest_match(pieces, words):
    pieces = {b"_", *pieces, *(b"_" + p for p in list(pieces)[:4])}
    machine = token_counts.LongestMatch(sorted(pieces), b"_")
    for w in words:
        assert machine.count(w) == (greedy(pieces, b"_" + w) or 1)


def test_longest_match_on_the_vocabulary(spark, sf):
    pieces = token_counts.pieces_of(vocabulary_path("byte_bpe_50k.json"))
    known, machine = set(pieces), token_counts.LongestMatch(pieces, b" ")
    assert len(pieces) == 50_256
    rng = random.Random(1)
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    words = {w.encode() for t in texts for w in t.split()}
    for w in [*rng.sample(sorted(words), 500), b"", "🙂漢字".encode(), bytes(range(128, 200))]:
        assert machine.count(w) == greedy(known, b" " + w)


def test_count_query(spark, sf):
    from plumbline.llm.queries import QUERIES

    known = set(token_counts.pieces_of(vocabulary_path("byte_bpe_50k.json")))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op1_token_counts"](spark, sf).collect()
    assert len(got) == len(docs)
    cost = {w: greedy(known, b" " + w) for w in {w for t in docs.values() for w in t.encode().split()}}
    for r in got:
        words = docs[r["doc_id"]].encode().split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(map(cost.__getitem__, words)))
    clash = spark.createDataFrame([(1, "two words", 9, "x", 7)] * 2, "doc_id long, text string, n_words int, word string, n_tokens int")
    assert [r["n_words"] for r in token_counts.count_tokens(clash).collect()] == [2, 2]
    odd = spark.createDataFrame([(1, None, 3), (None, "", 3), (1, "a " * 90_000, 3)], "doc_id long, text string, n_tokens int")
    assert sorted(r["n_words"] for r in token_counts.count_tokens(odd).collect()) == [0, 0, 90_000]
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


ODD = ["", " ", "İ<", "é! É", "don't'll 'S", "ΑΣ ΑΣΑ ς", "<|endoftext|>x <|END|>", "a\x1cb\x85c\xa0d　e f", "½ ² Ⅷ 12", "é ́ ﬁ ŉ ǰ ǅ ſ K", "x\x0by\x0cz\r\n", "😀👍🏽 漢字 가", "ÀÉÎ...***", "a" * 3000]


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(vocabulary_path(), 2000)


@pytest.mark.parametrize("text", ODD)
def test_chunks_encode_as_the_library_does(encoder, text):
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from([*"abzé İſK'12½.,<>|!ßΣςñ\t\n\x1c\x85\xa0 　", "́", "'s", "'LL", "<|endoftext|>", "the", "Über", "漢"]), max_size=25).map("".join))
@settings(max_examples=400, deadline=None)
def test_chunks_encode_as_the_library_does_at_random(encoder, text):
    assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=300), max_size=12), st.sampled_from([1, 7, 128]), st.sampled_from([10, 90, 100]))
@settings(max_examples=80, deadline=None)
def test_file_round_trip(tmp_path_factory, docs, block, percentile):
    path = str(tmp_path_factory.mktemp("t") / "x.pfor")
    w = token_files.TokenFileWriter(path, block, percentile)
    for k, d in enumerate(docs):
        w.add(None if k == 1 else k, np.array(d, dtype="<u4").tobytes())
    w.close()
    r = token_files.TokenFileReader(path)
    assert [x.tolist() for x in r.documents()] == docs and r.names == [None if k == 1 else k for k in range(len(docs))]
    flat = [x for d in docs for x in d]
    for a, b in ((0, len(flat)), (len(flat) // 3, len(flat) // 2), (len(flat), len(flat))):
        assert r.ids(a, b).tolist() == flat[a:b]
    small = token_files.TokenFileReader(path).documents(step=5)
    assert [x.tolist() for x in small] == docs


def test_outliers_become_exceptions(tmp_path):
    ids = np.full(128, 1000, dtype=np.uint32)
    ids[:120] += np.arange(120, dtype=np.uint32) % 16
    ids[7] = 4_000_000_000
    (block,) = token_files.pack_blocks(ids)
    assert block[4] == 4 and block[5] == 1 and len(block) == 6 + 64 + 5
    assert token_files.unpack_block(block, 0, 128).tolist() == ids.tolist()


def test_token_query(spark, sf):
    from tokenizers import Tokenizer

    from plumbline.llm.queries import QUERIES

    t = Tokenizer.from_file(vocabulary_path())
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op4_token_files"](spark, sf).collect()}
    start = 0
    for i, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(got[i][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_odd_tables(spark):
    rows = [(3, "b"), (None, "z"), (3, None), (1, ""), (3, "a"), (2, "w " * 50_000), (3, "a")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    _, manifest = token_files.write_token_files(docs, files=3)
    got = [(r["doc_id"], r["n_tokens"]) for r in token_files.read_token_files(manifest).orderBy("start").collect()]
    assert [i for i, _ in got] == [None, 1, 2, 3, 3, 3, 3] and sorted(n for i, n in got if i == 3) == [1, 2, 2, 2] and got[1][1] == 1
    _, empty = token_files.write_token_files(docs.limit(0))
    assert token_files.read_token_files(empty).count() == 0
    assert json.dumps(manifest.columns) == '["file", "shard", "n_docs", "n_tokens"]'

"""Token counts by a linear longest-match automaton.

Greedy word pieces: from a word's start, always the longest piece of the vocabulary; pieces at the start of a word have a
marker in front. The trie over all pieces gets failure links: where the trie has no way on from node v by the next byte, the
pieces that greedy matching would cut off by now are fixed, so the scan pops their precomputed number and goes on at f(v), the
node of what is left. Every byte is looked at once, and each failure step pops at least a piece: time is linear in the word.
Only numbers are kept, no piece is built. A word that can't be cut into pieces is one unknown token.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import ship, utf8
from plumbline.llm.tokenize import byte_alphabet, vocabulary_path

CACHE_WORDS = 500_000


class LongestMatch:
    """Automaton over byte strings. ``marker`` starts the first piece of every word."""

    def __init__(self, pieces: list[bytes], marker: bytes):
        self.marker = marker
        self.next: list[dict[int, int]] = [{}]
        piece, parent, byte = [False], [0], [0]
        for p in pieces:
            v = 0
            for c in p:
                w = self.next[v].get(c)
                if w is None:
                    w = self.next[v][c] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                    parent.append(v)
                    byte.append(c)
                v = w
            piece[v] = v != 0
        # Breadth first, so links of shorter strings are known. fail < 0: no greedy cut exists.
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        order = [0]
        for v in order:
            order.extend(self.next[v].values())
        for v in order[1:]:
            if piece[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            u, c = parent[v], byte[v]
            z, n = self.fail[u], self.pops[u]
            while z >= 0 and c not in self.next[z]:
                n += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.next[z][c], n
        self.start = 0
        for c in marker:
            self.start = self.next[self.start].get(c, -1)
            if self.start < 0:
                raise ValueError("no piece starts with the marker")

    def count(self, word: bytes) -> int:
        """Pieces of marker + word; 1 if there is no cut."""
        nodes, fail, pops = self.next, self.fail, self.pops
        v, n = self.start, 0
        for c in word:
            w = nodes[v].get(c)
            while w is None:
                if fail[v] < 0:
                    return 1
                n += pops[v]
                v = fail[v]
                if v < 0:
                    return 1
                w = nodes[v].get(c)
                if w is None and v == 0:
                    return 1
            v = w
        while v > 0:  # what is left at the end is cut off piece by piece
            if fail[v] < 0:
                return 1
            n += pops[v]
            v = fail[v]
        return n


def pieces_of(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file; special tokens, which have other characters or stand apart, are left out."""
    spec = json.loads(open(path, encoding="utf-8").read())
    special = {t["content"] for t in spec.get("added_tokens", [])}
    table = byte_alphabet()
    return [bytes(table[c] for c in t) for t in spec["model"]["vocab"] if t not in special and all(c in table for c in t)]


_AUTOMATA: dict[str, tuple[LongestMatch, dict[bytes, int]]] = {}


def automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The worker's automaton for a vocabulary file, and its cache of words."""
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(pieces_of(path), b" "), {}
    return _AUTOMATA[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of ``docs`` (doc_id, text): a narrow scan, nothing is shuffled.

    Words are runs without ASCII white space; a null or empty text has none of either. Rows are counted one by one, so repeated rows have equal
    results; an empty table gives an empty one; other columns are not read. A text of any length is counted whole, by one task.
    """
    ship(docs.sparkSession)
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")

    def scan(batches):
        machine, cache = automaton(path)
        for b in batches:
            words, tokens = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64)
            for i, text in enumerate(utf8(b.column(1))):
                w = (text or b"").split()
                words[i] = len(w)
                try:
                    tokens[i] = sum(map(cache.__getitem__, w))
                except KeyError:
                    if len(cache) > cache_words:
                        cache.clear()
                    for x in set(w).difference(cache):
                        cache[x] = machine.count(x)
                    tokens[i] = sum(map(cache.__getitem__, w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(scan, docs.select("doc_id").schema.add("n_words", "long").add("n_tokens", "long"))

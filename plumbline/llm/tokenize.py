"""Whole-text encoding with a public tokenizer, by white-space chunks that are cached.

The tokenizer's normaliser and pre-tokeniser never look across white space, so a text's ids are those of its chunks one after
the other; words repeat, so most chunks are found in a bounded cache that a Python worker keeps over its tasks. Letters
are lowered and a tail of ASCII punctuation is parted off before the library sees a chunk, where neither changes the ids. A word of
plain Latin letters is one unit of the pre-tokeniser and normalised already: it goes to the library's model at once, as the
string that its byte-level step would make of it. All other chunks go through the library's whole chain.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np

from plumbline.llm.common import word_groups

END_ID = 1
CACHE_CHUNKS = 200_000
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class ChunkEncoder:
    """Texts -> ids. Chunks that were met have numbers, and their ids stand in one array; two generations of chunks and parts are kept, so that frequent ones stay."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.parts: dict[str, list[int]] = {"": []}
        self.old_parts: dict[str, list[int]] = {}
        self.most = cache_chunks
        #: Strings that the library finds in raw text before anything else; chunks that hold one are encoded as they are.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: tuple | None = None  # the chunks before the last clearing: number, flat, first, length
        self.number: dict[bytes, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.old = (self.number, self.flat, self.first, self.length) if self.number else None
        self.number = {}
        self.flat, self.size = np.zeros(1 << 16, dtype=np.uint32), 0
        self.first, self.length = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)

    def _split(self, chunk: str) -> tuple[str, str]:
        if "<" in chunk and any(s in chunk for s in self.special):
            return chunk, ""
        core = chunk.rstrip(_TAIL)
        if not core or not core[-1].lower().isalpha():  # a capital may be lowered to a letter and a mark, which joins the tail
            return (chunk.lower() if chunk.isascii() else chunk), ""
        return (core.lower() if core.isascii() else core), chunk[len(core) :]

    def _ids(self, part: str) -> list[int]:
        if part.isalpha() and (part.isascii() or max(part) < "\u0180" and "\u0130" not in part):
            word = part.lower()
            plain = word if word.isascii() else "".join(map(self.stand_in.__getitem__, word.encode()))
            return [t.id for t in self.tokenizer.model.tokenize(plain)]
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def _part(self, part: str) -> list[int]:
        got = self.parts.get(part)
        if got is None:
            got = self.old_parts.get(part)
            self.parts[part] = got = self._ids(part) if got is None else got
        return got

    def learn(self, chunks: list[bytes]) -> None:
        """Number new chunks, which hold no ASCII white space."""
        if self.old is not None:
            number, flat, first, length = self.old
            was = np.fromiter(map(number.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
            known, new = np.nonzero(was >= 0)[0], np.nonzero(was < 0)[0]
            if len(known):
                n = length[was[known]]
                self._store([chunks[i] for i in known.tolist()], flat[np.repeat(first[was[known]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n)
                chunks = [chunks[i] for i in new.tolist()]
        if not chunks:
            return
        if len(self.parts) > self.most:
            self.parts, self.old_parts = {"": []}, self.parts
        known, ids, n = self.parts.get, [], []
        for c in b" ".join(chunks).decode("utf-8", "replace").split(" "):
            core = c.rstrip(_TAIL)
            if core.isalpha() and (core.isascii() or max(core) < "\u0180" and "\u0130" not in core):
                a, b = core.lower(), c[len(core) :]
            else:
                a, b = self._split(c)
            x, y = known(a), known(b)
            x = self._part(a) if x is None else x
            y = self._part(b) if y is None else y
            ids += x
            ids += y
            n.append(len(x) + len(y))
        self._store(chunks, np.array(ids, dtype=np.uint32), np.array(n, dtype=np.int64))

    def _store(self, chunks: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        at = len(self.number)
        while at + len(n) > len(self.first):
            self.first, self.length = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.length))
        while self.size + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.size : self.size + len(ids)] = ids
        self.first[at : at + len(n)], self.length[at : at + len(n)] = self.size + np.cumsum(n) - n, n
        self.size += len(ids)
        self.number |= {c: at + k for k, c in enumerate(chunks)}

    def _numbers(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of distinct chunks."""
        out = np.fromiter(map(self.number.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = np.nonzero(out < 0)[0].tolist()
        if new:
            some = [chunks[i] for i in new]
            self.learn(some)
            out[new] = np.fromiter(map(self.number.__getitem__, some), dtype=np.int64, count=len(new))
        return out

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a whole text in UTF-8 as little-endian uint32 bytes; null is empty."""
        import pyarrow as pa

        return b"".join(ids[:-1].astype("<u4").tobytes() for ids, _ in self.encode_texts(pa.array([text], pa.binary())))

    def encode_texts(self, column):
        """(ids of some texts one after the other, END_ID after each; how many each has) for slices of an Arrow column of texts; null is empty."""
        for chunks, place, m in word_groups(column):
            if len(self.number) > self.most:
                self._clear()
            numbers = self._numbers(chunks)[place]
            n = self.length[numbers]
            total, ends = np.concatenate(([0], np.cumsum(n))), np.cumsum(m)
            each = total[ends] - total[ends - m]
            out = np.full(int(total[-1]) + len(m), END_ID, dtype=np.uint32)
            at = np.arange(int(total[-1]))
            out[at + np.repeat(np.arange(len(m)), each)] = self.flat[np.repeat(self.first[numbers] - total[:-1], n) + at]
            yield out, each + 1


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]

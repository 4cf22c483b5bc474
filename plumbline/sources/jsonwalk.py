"""A walk over JSON text as it comes in: values are decoded where they are wanted, and stepped over where not.

Memory holds the piece at hand and the value that is being decoded. Stepping over a value looks for brackets and quotes only: no number in it is
read, and what stands between them is not checked.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

_SPACE = re.compile(r"[ \t\n\r]*")
_MARK = re.compile(r'[\[\]{}"]')
_IN_STRING = re.compile(r'["\\]')
_SCALAR_END = re.compile(r"[,\]}\s]")


class Walker:
    """Text of one JSON document behind a binary file, from its beginning on."""

    def __init__(self, source, piece: int = 1 << 16):
        self.source, self.piece = source, piece
        self.decode = codecs.getincrementaldecoder("utf-8")().decode
        self.text, self.at, self.ended = "", 0, False

    def _more(self) -> bool:
        """Drop what is behind, and read on; False at the end."""
        if self.ended:
            return False
        data = self.source.read(self.piece)
        self.ended = not data
        self.text, self.at = self.text[self.at :] + self.decode(data, self.ended), 0
        return not self.ended or bool(self.text)

    def peek(self) -> str:
        """The next character that is not white space; empty at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if self.ended or not self._more():
                return ""

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"JSON: {wanted!r} expected, not {self.peek()!r}")
        self.at += 1

    def _extent(self, keep: bool) -> str:
        """Step over the next value; its text if it is to be kept."""
        first, kept = self.peek(), []
        if not first:
            raise ValueError("JSON: a value expected, not the end")
        depth, in_string, scalar = 0, False, first not in '[{"'

        def forward(to: int) -> None:
            if keep:
                kept.append(self.text[self.at : to])
            self.at = to

        while True:
            pattern = _SCALAR_END if scalar else _IN_STRING if in_string else _MARK
            m = pattern.search(self.text, self.at)
            if m is None:
                forward(len(self.text))
                if not self._more():
                    if scalar:
                        return "".join(kept)
                    raise ValueError("JSON: the text ends within a value")
                continue
            if scalar:
                forward(m.start())
                return "".join(kept)
            if m.group() == "\\":
                while m.start() + 2 > len(self.text):  # the escaped character is in the next piece
                    forward(m.start())
                    if not self._more():
                        raise ValueError("JSON: the text ends within a value")
                    m = pattern.search(self.text, self.at)
                forward(m.start() + 2)
                continue
            forward(m.end())
            if m.group() == '"':
                in_string = not in_string
            else:
                depth += 1 if m.group() in "[{" else -1
            if not in_string and depth == 0:
                return "".join(kept)

    def raw(self) -> str:
        """The text of the next value, not decoded."""
        return self._extent(True)

    def value(self):
        """The next value, decoded."""
        return json.loads(self.raw())

    def skip(self) -> None:
        self._extent(False)

    def keys(self) -> Iterator[str]:
        """The keys of the object that is next. The caller takes or skips each key's value before it asks for the next key."""
        self.take("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            key = self.value()
            if not isinstance(key, str):
                raise ValueError("JSON: a key must be a string")
            self.take(":")
            yield key
            if self.peek() == ",":
                self.at += 1
                continue
            self.take("}")
            return

    def items(self) -> Iterator[int]:
        """Numbers of the elements of the array that is next; the caller takes or skips each element."""
        self.take("[")
        if self.peek() == "]":
            self.at += 1
            return
        n = 0
        while True:
            yield n
            n += 1
            if self.peek() == ",":
                self.at += 1
                continue
            self.take("]")
            return

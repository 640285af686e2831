"""Cuts of a text that no pre-token of the byte-level pattern crosses, and a bounded memo over them.

A pre-token holds white space only at its start, so a space after a character that isn't white space always begins a
new one, and what follows splits alike in any text. Words repeat, so each is encoded once while the memo holds it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_SPACE_AFTER_SPACE = re.compile(r"\s ")
#: A Latin word and one of some marks behind it: the pattern parts these two and nothing else.
MARKS = frozenset(".,;:!?")
plain_word = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)[.,;:!?]").fullmatch
latin = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_CUT = re.compile(r"(?<=\S)(?= )")


def cut_words(text: str) -> list[str]:
    """Parts of ``text``: the first as it stands, each later one without the single space before it."""
    if _SPACE_AFTER_SPACE.search(text):
        first, *rest = _CUT.split(text)
        return [first, *(part[1:] for part in rest)]
    return text.split(" ")


class Memo(dict):
    """``encode(part)`` for parts seen before. It holds two generations of ``limit`` parts; a part that is asked for again
    moves to the younger one, and the older is dropped when the younger is full. A word with a mark behind it is put
    together from the two."""

    def __init__(self, encode: Callable[[str], bytes], mark: Callable[[str], bytes], limit: int = 500_000):
        super().__init__()
        self.encode, self.mark, self.limit, self.older = encode, mark, limit, {}

    def __missing__(self, part: str) -> bytes:
        if part[-1:] in MARKS and (found := plain_word(part)):
            return self[found[1]] + self.mark(part[-1])
        value = self.older.get(part)
        if value is None:
            value = self.encode(part)
            if len(part) > 64:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[part] = value
        return value


def joined(text: str, encode: Callable[[str], bytes], memo: Memo) -> bytes:
    """The encodings of all parts in order. ``memo`` encodes a part with its space."""
    first, *rest = cut_words(text)
    return encode(first) + b"".join(map(memo.__getitem__, rest))

"""Texts as arrays of code points, for work on whole batches at once."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np

#: Longer texts are worked on in pieces of this many code points, cut after white space.
PIECE = 1 << 19


@lru_cache(maxsize=None)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, is it a letter or digit, its single lower-case form."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    word = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            word[i], letter[i] = True, c.isalpha()
            low = c.lower()
            if low != c and len(low) == 1:
                lower[i] = ord(low)
    return letter, word, lower


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def cut(text: str, limit: int = PIECE):
    """(offset, piece): the whole text in pieces that end after a line, a sentence or a word."""
    start = 0
    while len(text) - start > limit:
        stop = start + limit
        for mark in ("\n", ". ", " "):
            at = text.rfind(mark, start, stop)
            if at > start:
                stop = at + len(mark)
                break
        yield start, text[start:stop]
        start = stop
    yield start, text[start:]

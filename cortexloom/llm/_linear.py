"""Hashed n-gram features of words, counted per document in Arrow batches.

A document is the bag of its words; a word is the bag of its own hash and of its character
n-grams' hashes. What a linear model needs of a word (a row of scores) is worked out once per
distinct word and remembered, so that long texts cost one table lookup a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np

#: Distinct words a task remembers; when full it starts anew, which costs time only.
REMEMBERED = 300_000


def grams(word: bytes, low: int, high: int, buckets: int) -> list[int]:
    """Hash buckets of a word and of its character n-grams, its edges marked by < and >."""
    crc = zlib.crc32
    if word.isascii():  # a byte is a character
        w = b"<%b>" % word
        out = [crc(word, 1) % buckets] if len(w) <= 66 else []
        for n in range(low, high + 1):
            out += [crc(w[i : i + n], n) % buckets for i in range(len(w) - n + 1)]
    else:
        t = f"<{word.decode('utf-8', 'replace')}>"
        out = [crc(word, 1) % buckets] if len(t) <= 66 else []  # a longer run without spaces has no hash of the whole
        for n in range(low, high + 1):
            out += [crc(t[i : i + n].encode(), n) % buckets for i in range(len(t) - n + 1)]
    return out or [crc(word, 1) % buckets]


def mean_rows(words: list[bytes], ids_of: Callable[[bytes], list[int]], table: np.ndarray) -> np.ndarray:
    """For each word the mean of its buckets' rows in ``table``."""
    out = np.zeros((len(words), table.shape[1]), np.float32)
    step = max(64, (1 << 19) // max(1, table.shape[1]) // 32)
    for at in range(0, len(words), step):
        ids = [ids_of(w) for w in words[at : at + step]]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
        out[at : at + step] = np.add.reduceat(table[flat], np.cumsum(n) - n) / n[:, None]
    return out


class WordTable:
    """Rows of numbers by word, filled by ``rows_of(words)`` on first sight."""

    def __init__(self, rows_of: Callable[[list[bytes]], np.ndarray], width: int):
        self.rows_of, self.width = rows_of, width
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((4096, self.width), np.float32)

    def rows_for(self, words: list[bytes]) -> np.ndarray:
        """Positions of the words' rows in ``rows``."""
        at = self.at
        try:
            return np.fromiter(map(at.__getitem__, words), np.int64, len(words))
        except KeyError:
            pass
        new = [w for w in dict.fromkeys(words) if w not in at]
        if len(at) + len(new) > max(REMEMBERED, len(new)):
            self.clear()
            at, new = self.at, list(dict.fromkeys(words))
        if len(at) + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), self.width), np.float32)])
        self.rows[len(at) : len(at) + len(new)] = self.rows_of(new)
        at.update(zip(new, range(len(at), len(at) + len(new))))
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))


def blocks(words: list[bytes], size: int = 1 << 17):
    """A document's words in bounded blocks."""
    for i in range(0, len(words), size):
        yield words[i : i + size]

"""Texts as one array of code points, shared by the models of this subpackage."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# General categories grouped to nine classes.
LOWER, UPPER, LETTER, DIGIT, BLANK, LINE, STOP, MARK, SYMBOL = range(9)
CLASSES = 9
_SENTENCE = ".,;:?'\"-()"


def _class_of(c: int) -> int:
    ch, kind = chr(c), unicodedata.category(chr(c))
    if ch == "\n":
        return LINE
    if ch.isspace():
        return BLANK
    if kind in ("Ll", "Mn", "Mc"):
        return LOWER
    if kind in ("Lu", "Lt"):
        return UPPER
    if kind[0] == "L":
        return LETTER
    if kind[0] == "N":
        return DIGIT
    if ch in _SENTENCE or kind in ("Pi", "Pf", "Pd"):
        return STOP
    return MARK if ch == "!" else SYMBOL


@lru_cache(1)
def classes() -> np.ndarray:
    return np.fromiter(map(_class_of, range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter proper, not a combining mark."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@dataclass
class Texts:
    cp: np.ndarray  # code points of all texts
    begin: np.ndarray  # first index of each text
    size: np.ndarray  # code points of each text
    doc: np.ndarray  # text of each code point

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        texts = [t or "" for t in texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return cls(cp, np.cumsum(size) - size, size, np.repeat(np.arange(len(texts), dtype=np.int32), size))

    def per_text(self, weights: np.ndarray) -> np.ndarray:
        """Sum of a number for each code point over each text."""
        upto = np.concatenate([[0], np.cumsum(weights, dtype=np.int64)])
        return upto[self.begin + self.size] - upto[self.begin]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the longest runs of marked code points that lie in one text."""
        first = np.zeros(len(inside) + 1, bool)
        first[self.begin[self.size > 0]] = True
        before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
        starts = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
        ends = np.flatnonzero(inside & (~after | first[1:])) + 1
        return starts, ends


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1

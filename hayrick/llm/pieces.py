"""Vectorised pre-tokenisation and a piece cache, shared by the token operators.

Pre-tokenisation for byte-level BPE splits text into contractions, letter runs, digit runs, other runs (each with
at most one leading space) and white space. Here it is a small automaton over symbols taken from a codepoint-class
array. Every symbol is a function from states to states; functions compose associatively, so a blocked scan over
their composition table gives the state before every character at once, and with it every boundary.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# The classes of the splitting pattern.
_L, _N, _O, _W = range(4)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ONE, _TWO = "stmd", ("re", "ve", "ll")
# Symbols: letter, digit, other, apostrophe of a one- or two-letter contraction, space that joins what follows,
# last white space before text, any other white space.
LET, NUM, OTH, Q1, Q2, SPACE, LAST, INNER = range(8)
# States: inside letters, digits, others; after a joining space; inside white space; nothing open; contraction letters due.
A, B, D, P, WS, X, C1, C2 = range(8)
_BLOCK = 128


@lru_cache(1)
def class_table() -> np.ndarray:
    kinds = {"L": _L, "N": _N}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _O) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[_WHITE] = _W
    return table


def _step(symbol: int, state: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this character."""
    if symbol == LET:
        if state in (C1, C2):
            return (X if state == C1 else C1), False
        return A, state not in (A, P)
    if symbol == NUM:
        return B, state not in (B, P)
    if symbol == OTH or (symbol in (Q1, Q2) and state in (D, P)):
        return D, state not in (D, P)
    if symbol in (Q1, Q2):
        return (C1 if symbol == Q1 else C2), True
    if symbol == INNER:
        return WS, state != WS
    return (P if symbol == SPACE else X), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(next state, starts a piece) by symbol and state, function of each symbol, composition table, identity.

    Symbols 8 to 15 are those of a document's first character: constant functions, so documents need no gap.
    """
    after = np.array([[_step(s, q)[0] for q in range(8)] for s in range(8)] + [[_step(s, X)[0]] * 8 for s in range(8)], np.uint8)
    starts = np.array([[_step(s, q)[1] for q in range(8)] for s in range(8)] + [[True] * 8 for s in range(8)])
    found = {tuple(range(8)): 0}
    for f in map(tuple, after.tolist()):
        found.setdefault(f, len(found))
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in list(found):
            for h in (tuple(g[x] for x in f), tuple(f[x] for x in g)):
                if h not in found:
                    found[h] = len(found)
                    todo.append(h)
    order = list(found)
    compose = np.array([[found[tuple(g[x] for x in f)] for g in order] for f in order], np.uint8)
    return after, starts, np.array([found[tuple(f)] for f in after.tolist()], np.uint8), compose, len(order)


def symbols(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The automaton's symbol of every character; ``first`` marks those that begin a document."""
    cls = class_table()[cp]
    n = len(cp)
    white = cls == _W
    joined = np.zeros(n, bool)  # the next character is text of the same document
    joined[:-1] = ~white[1:] & ~first[1:]
    out = np.where(white, np.where(joined, np.where(cp == 32, SPACE, LAST), INNER), cls).astype(np.uint8)
    marks = np.flatnonzero(cp == 39)
    if len(marks):
        padded = np.concatenate([cp, np.zeros(2, cp.dtype)])
        fresh = np.concatenate([first, np.ones(2, bool)])
        a, b = padded[marks + 1], padded[marks + 2]
        same1 = ~fresh[marks + 1]
        same2 = same1 & ~fresh[marks + 2]
        out[marks[same1 & np.isin(a, [ord(c) for c in _ONE])]] = Q1
        out[marks[same2 & np.logical_or.reduce([(a == ord(t[0])) & (b == ord(t[1])) for t in _TWO])]] = Q2
    return out + (first.astype(np.uint8) << 3)


def piece_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the characters at which a piece starts."""
    if not len(cp):
        return np.zeros(0, np.int64)
    after, starts, function, compose, size = automaton()
    sym = symbols(cp, first)
    n = len(sym)
    rows = -(-n // _BLOCK)
    grid = np.zeros(rows * _BLOCK, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, _BLOCK).T)
    flat_after, flat_compose, flat_starts = after.ravel(), compose.ravel(), starts.ravel()
    # Up: each block's composed function. Across: the state before each block. Down: the state before each character.
    total = function[grid[0]]
    for line in grid[1:]:
        total = flat_compose[total.astype(np.int32) * size + function[line]]
    maps = np.array([_image(f) for f in range(size)], np.uint8)
    state = np.empty(rows, np.uint8)
    now = X
    for r, f in enumerate(total.tolist()):
        state[r] = now
        now = maps[f, now]
    out = np.empty(grid.shape, bool)
    for j, line in enumerate(grid):
        at = (line << 3) | state
        out[j] = flat_starts[at]
        state = flat_after[at]
    return np.flatnonzero(out.T.ravel()[:n])


@lru_cache(None)
def _image(f: int) -> tuple[int, ...]:
    """The states that function number ``f`` maps 0 to 7 to, found through its composition with constants."""
    after, _, function, compose, _ = automaton()
    # Constant functions of first characters: each sends all states to one known state.
    reach = {}
    for s in range(16):
        if len(set(after[s].tolist())) == 1:
            reach.setdefault(int(after[s][0]), int(function[s]))
    known = {int(function[s]): after[s] for s in range(16)} | {0: np.arange(8, dtype=np.uint8)}
    todo = list(known)
    while todo:
        a = todo.pop()
        for b in list(known):
            for x, y in ((a, b), (b, a)):
                c = int(compose[x, y])
                if c not in known:
                    known[c] = known[y][known[x]]
                    todo.append(c)
    return tuple(int(v) for v in known[f])


class Pool:
    """Variable-length runs in one growing array."""

    def __init__(self, dtype):
        self.data, self.ends, self.n = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        base = int(self.ends[self.n])
        while base + len(flat) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(lengths) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.data[base : base + len(flat)] = flat
        self.ends[self.n + 1 : self.n + 1 + len(lengths)] = base + np.cumsum(lengths)
        self.n += len(lengths)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of all runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class PieceCache:
    """Ids of pieces by their bytes: an open-addressing table over 64-bit hashes, each hit compared byte by byte.

    ``encode_new`` gets unseen pieces (bytes) and returns (ids of all of them, number of ids of each). The table
    starts afresh when it would hold more than ``most`` pieces, so a worker's memory is bounded, and a text of more pieces
    than that is looked up part by part. Slots are at least 2.4 times the pieces, so a free one is always found.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 1_200_000):
        self.encode_new, self.most = encode_new, most
        rng = np.random.default_rng(20)
        self.mark = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.power = np.ones(1, np.uint64)
        self.bits = max(10, int(most * 2.4).bit_length())
        self.reset()

    def reset(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros(1 << 14, np.uint64)
        self.bytes, self.ids = Pool(np.uint8), Pool(np.uint32)

    def _hash(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pos: np.ndarray) -> np.ndarray:
        longest = int(lengths.max())
        while len(self.power) < longest:
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * longest + 64, np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
        h = np.add.reduceat(self.mark[data] * self.power[pos], starts)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        at = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            got = self.slots[at[left]]
            hit = (got >= 0) & (self.keys[np.maximum(got, 0)] == h[left])
            out[left[hit]] = got[hit]
            left = left[(got >= 0) & ~hit]
            at[left] = (at[left] + 1) & int(mask)
        return out

    def _insert(self, h: np.ndarray, first: int) -> None:
        mask = len(self.slots) - 1
        while first + len(h) > len(self.keys):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
        number = np.arange(first, first + len(h), dtype=np.int32)
        self.keys[number] = h
        at = (h & np.uint64(mask)).astype(np.int64)
        while len(number):
            free = self.slots[at] < 0
            self.slots[at[free]] = number[free]
            lost = self.slots[at] != number
            number, at = number[lost], (at[lost] + 1) & mask

    def lookup(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each piece); pieces tile ``data`` from ``starts``."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(starts) > self.most:  # more pieces than the table may hold: part by part
            edges = [*range(0, len(starts), self.most), len(starts)]
            ends = np.append(starts, len(data))
            parts = [self.lookup(data[starts[a] : ends[b]], starts[a:b] - starts[a]) for a, b in zip(edges, edges[1:])]
            return tuple(np.concatenate(x) for x in zip(*parts))
        lengths = np.diff(starts, append=len(data))
        pos = np.arange(len(data)) - np.repeat(starts, lengths)
        h = self._hash(data, starts, lengths, pos)
        slot = self._find(h)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            _, one = np.unique(h[missing], return_index=True)
            new = missing[one]
            if self.ids.n + len(new) > self.most:
                self.reset()
                _, new = np.unique(h, return_index=True)
            ends = starts + lengths
            raw = data.tobytes()
            flat, counts = self.encode_new([raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            first = self.ids.n
            self.ids.extend(flat, counts)
            self.bytes.extend(data[runs(starts[new], lengths[new])], lengths[new])
            self._insert(h[new], first)
            slot = self._find(h)
        # A shared hash shows as a difference in length or bytes; such pieces are encoded on their own.
        known = self.bytes.ends[slot + 1] - self.bytes.ends[slot]
        ok = known == lengths
        where = np.minimum(np.repeat(self.bytes.ends[slot], lengths) + pos, len(self.bytes.data) - 1)
        differs = self.bytes.data[where] != data
        if differs.any() or not ok.all():
            ok &= ~np.logical_or.reduceat(differs, starts)
        counts = self.ids.ends[slot + 1] - self.ids.ends[slot]
        if ok.all():
            return self.ids.data[runs(self.ids.ends[slot], counts)], counts
        raw, ends = data.tobytes(), starts + lengths
        own_flat, own_counts = self.encode_new([raw[starts[i] : ends[i]] for i in np.flatnonzero(~ok)])
        parts = np.split(self.ids.data[runs(self.ids.ends[slot], counts)], np.cumsum(counts)[:-1])
        for i, ids in zip(np.flatnonzero(~ok), np.split(own_flat, np.cumsum(own_counts)[:-1]), strict=True):
            parts[i], counts[i] = ids, len(ids)
        return np.concatenate(parts), counts


def encode_texts(texts: list[str | None], cache: PieceCache) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids per text, pieces' first bytes, ids per piece) of all texts; null counts as empty."""
    texts = [t or "" for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    begin = np.cumsum(sizes) - sizes
    first = np.zeros(len(cp), bool)
    first[begin[sizes > 0]] = True
    at = piece_starts(cp, first)
    data = np.frombuffer(joined.encode(), np.uint8)
    if len(data) == len(cp):
        start = at
    else:
        width = 1 + (cp > 0x7F).astype(np.int8) + (cp > 0x7FF) + (cp > 0xFFFF)
        start = (np.cumsum(width, dtype=np.int64) - width)[at]
    ids, counts = cache.lookup(data, start)
    upto = np.concatenate([[0], np.cumsum(counts)])
    edge = np.searchsorted(at, np.append(begin, len(cp)))
    return ids, np.diff(upto[edge]), start, counts


def encode_around(texts: list[str | None], cache: PieceCache, strings: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids per text) where each of ``strings`` inside a text stands for its one id; the longest string wins."""
    if not strings or not any(x in t for t in texts if t for x in strings):
        return encode_texts(texts, cache)[:2]
    cut = re.compile("(" + "|".join(map(re.escape, sorted(strings, key=len, reverse=True))) + ")")
    parts = [cut.split(t or "") for t in texts]  # plain text at even places, strings at odd ones
    ids, counts, _, _ = encode_texts([x for p in parts for x in p[::2]], cache)
    stop = np.cumsum(counts)
    out, per_text, k = [], [], 0
    for p in parts:
        own = []
        for i, x in enumerate(p):
            if i % 2:
                own.append(np.array([strings[x]], np.uint32))
            else:
                own.append(ids[stop[k] - counts[k] : stop[k]])
                k += 1
        out += own
        per_text.append(sum(map(len, own)))
    return np.concatenate(out), np.array(per_text, np.int64)


def batches(texts: list[str | None], most_chars: int = 1 << 18):
    """Slices [a, b) of a list of texts, each of about ``most_chars`` characters (a longer text stands alone)."""
    a = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most_chars:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(texts):
        yield a, len(texts)

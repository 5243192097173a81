"""Byte-level BPE encoding and decoding with a rank file, vectorised.

Pieces come from the automaton in ``pieces``; each unseen piece is merged by rank together with all other unseen
pieces of its length class, and then cached. Token offsets are kept, so that any run of tokens can be traced to
its bytes and decoded by itself.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm.pieces import PieceCache, batches, encode_texts, runs

_NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMerger:
    """Merges pieces by rank: again and again the leftmost pair of lowest rank, until none is in the table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.values[at], _NONE)

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        is_whole = np.flatnonzero(whole >= 0)
        done = [(is_whole, whole[is_whole].astype(np.uint32), np.ones(len(is_whole), np.int64))]
        for i in np.flatnonzero((whole < 0) & (lengths > 256)).tolist():
            ids = np.array(self._long(pieces[i]), np.uint32)
            done.append((np.array([i]), ids, np.array([len(ids)])))
        for low, high in ((0, 4), (4, 6), (6, 8), (8, 12), (12, 16), (16, 32), (32, 64), (64, 128), (128, 256)):
            members = np.flatnonzero((whole < 0) & (lengths > low) & (lengths <= high))
            if len(members):
                done.append((members, *self._together([pieces[i] for i in members.tolist()])))
        counts = np.zeros(len(pieces), np.int64)
        for members, _, n in done:
            counts[members] = n
        flat = np.empty(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        for members, ids, n in done:
            flat[runs(begin[members], n)] = ids
        return flat, counts

    def _together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        t = np.full((len(pieces), width + 1), -1, np.int64)
        t[:, :-1][np.arange(width) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        r = self.rank(t[:, :-1], t[:, 1:])
        cols = np.arange(width + 1)
        live = np.arange(len(pieces))
        while True:
            j = r[live].argmin(1)
            best = r[live, j]
            go = best < _NONE
            live, j, best = live[go], j[go], best[go]
            if not len(live):
                break
            row, rank = t[live], r[live]
            gone = cols > j[:, None]
            row = np.where(gone, np.concatenate([row[:, 1:], np.full((len(row), 1), -1)], 1), row)
            rank = np.where(gone[:, :-1], np.concatenate([rank[:, 1:], np.full((len(row), 1), _NONE)], 1), rank)
            k = np.arange(len(live))
            row[k, j] = best
            rank[k, j] = self.rank(best, row[k, j + 1])
            left = j > 0
            rank[k[left], j[left] - 1] = self.rank(row[k[left], j[left] - 1], best[left])
            t[live], r[live] = row, rank
        keep = t[:, :-1] >= 0
        return t[:, :-1][keep].astype(np.uint32), keep.sum(1)

    def _long(self, piece: bytes) -> list[int]:
        """One long piece, with a heap of pairs over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], nxt[i] = rank, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] < n and (r := get((ids[x] << 32) | ids[nxt[x]])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[nxt[x]]))
        return [x for x in ids if x >= 0]


@lru_cache(2)
def _encoder(path: str) -> PieceCache:
    """A worker's piece cache for this rank file. The file has a fixed size of about 1 MB."""
    return PieceCache(RankMerger(read_ranks(path)))


@lru_cache(2)
def _tokens(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens, one after another, and where each ends (from 0 on)."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32, copy=False)))


def encode(docs: DataFrame, rank_file: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(doc_id, ids, ends): the token ids of every text and, with ``offsets``, the byte at which each token ends.

    Defined cases: null or empty text has no tokens; other columns of the input are ignored; repeated rows are
    encoded each; an empty table gives an empty result. ``id_col`` may have any type.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", ends array<int>" * offsets

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (_, token_ends) = _encoder(rank_file), _tokens(rank_file)
        width = np.diff(token_ends)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                ids, counts, _, _ = encode_texts(texts[a:b], cache)
                out = [batch.column(0).slice(a, b - a), _lists(ids, counts)]
                if offsets:
                    ends = np.cumsum(width[ids])
                    before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
                    out.append(_lists(ends - np.repeat(before, counts), counts))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "ends"][: len(out)])

    return source.mapInArrow(run, schema)


def _bytes_of(lists: pa.ListArray, data: np.ndarray, token_ends: np.ndarray) -> pa.Array:
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    size = token_ends[ids + 1] - token_ends[ids]
    flat = data[runs(token_ends[ids], size)]
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    valid = pa.py_buffer(np.packbits(lists.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes()) if lists.null_count else None
    return pa.Array.from_buffers(pa.binary(), len(lists), [valid, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(flat)])


def decode(encoded: DataFrame, rank_file: str, keep: tuple[str, ...] = ("doc_id", "ids"), most: int = 1 << 19) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the token ids. A null list decodes to null; an unknown id fails."""
    source = encoded.select(*keep)
    at = keep.index("ids")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, token_ends = _tokens(rank_file)
        for batch in it:
            counts = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(counts, dtype=np.int64)
            low = 0
            while low < batch.num_rows:  # rows with about `most` tokens at a time
                done = upto[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(upto, done + most, "right")))
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, _bytes_of(part.column(at), data, token_ends)], names=[*keep, "decoded"])
                low = high

    return source.mapInArrow(run, f"{fields}, decoded binary")

"""Target-distribution importance resampling over hashed n-grams.

Every text is a bag of runs of one to three words, each hashed to a bucket by its CRC-32. The log ratio of a bucket's
share in target texts and in the corpus is its gain, and a document's weight is the sum of its features' gains. Noise
from the id (Gumbel) is added to the weight, and the best scores are the sample: a draw without replacement in
proportion to the ratio of the two distributions.

CRC-32 is linear over XOR but for a constant that the length decides. A table holds what a byte contributes at every
distance from a span's end, so the hashes of all words are one table look-up a byte and one ``bitwise_xor.reduceat``
over the spans. The four bytes of a register are contributions like any others, so the same table moves a register
past the words after it: that joins words to runs, and folds spans longer than the table block by block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.llm.pieces import batches
from hayrick.session import materialize

#: Distances from the end that the table holds; longer spans fold in blocks of so many bytes.
FAR = 256
#: Bytes of one long text that are hashed at a time.
WINDOW = 1 << 22
_ALL = np.uint32(0xFFFFFFFF)


def _table() -> np.ndarray:
    """Row d + 4 has what each byte contributes to the register at distance d from the end; the first four rows are a
    register's own bytes, highest first, before anything follows."""
    step = np.array([zlib.crc32(bytes([b]), 0) for b in range(256)], np.uint32)
    step ^= step[0]  # without the constant of the length
    out = np.empty((FAR + 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.uint32(24)
    for d in range(1, FAR + 4):
        out[d] = (out[d - 1] >> np.uint32(8)) ^ step[out[d - 1] & np.uint32(255)]
    return out


_AT = _table()
_FLAT = _AT.ravel()
_SPACE = _AT[4, 32]


def moved(register: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after ``by`` zero bytes each; longer ways are gone block by block."""
    register, by = register.copy(), by.copy()
    while len(far := np.flatnonzero(by > FAR)):
        register[far] = _step(register[far], np.full(len(far), FAR))
        by[far] -= FAR
    return _step(register, by)


def _step(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    row = n << 8
    return _FLAT.take(row + 768 + (s & 255)) ^ _FLAT.take(row + 512 + (s >> 8 & 255)) ^ _FLAT.take(row + 256 + (s >> 16 & 255)) ^ _FLAT.take(row + (s >> 24))


def _spaced(s: np.ndarray) -> np.ndarray:
    """Registers after one space."""
    return s >> np.uint32(8) ^ _AT[4].take(s & 255) ^ _SPACE


_CONSTANT = _step(np.full(FAR + 1, _ALL), np.arange(FAR + 1)) ^ _ALL


def constants(length: np.ndarray) -> np.ndarray:
    """The CRC-32 of so many zero bytes: what a register lacks to the checksum of a span of that length."""
    out = _CONSTANT[np.minimum(length, FAR)]
    if len(far := np.flatnonzero(length > FAR)):
        out[far] = moved(np.full(len(far), _ALL), length[far]) ^ _ALL
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register of each span [start, end) of bytes; spans are in order, apart and not empty."""
    length = ends - starts
    inside = np.repeat(starts - np.cumsum(length) + length, length) + np.arange(length.sum())
    left = np.repeat(ends - 1, length) - inside
    blocks = -(-length // FAR)
    begin = np.cumsum(length) - length
    if (blocks == 1).all():
        return np.bitwise_xor.reduceat(_FLAT.take((left + 4 << 8) + data[inside]), begin)
    own = np.repeat(np.arange(len(length)), blocks)
    nth = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # blocks end at whole distances from the end
    cut = begin[own] + np.where(nth > 0, length[own] - (blocks[own] - nth) * FAR, 0)
    part = np.bitwise_xor.reduceat(_FLAT.take((left % FAR + 4 << 8) + data[inside]), cut)
    first = np.cumsum(blocks) - blocks
    out = part[first]
    for k in range(1, int(blocks.max())):
        longer = np.flatnonzero(blocks > k)
        out[longer] = _step(out[longer], np.full(len(longer), FAR)) ^ part[first[longer] + k]
    return out


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of lower-cased bytes; texts begin at ``fresh`` and no word runs over their edges."""
    inside = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[fresh] = edge[-1] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _runs(register: np.ndarray, length: np.ndarray, text: np.ndarray, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32, text) of all runs of one to three words but those within the first ``carried`` words."""
    crc, whose = [register ^ constants(length)], [text]
    run, size = register, length
    for k in (1, 2):
        if len(register) <= k:
            break
        run = moved(_spaced(run[:-1]), length[k:]) ^ register[k:]
        size = size[:-1] + 1 + length[k:]
        same = text[:-k] == text[k:]
        if carried > k:
            same[: carried - k] = False
        crc.append((run ^ constants(size))[same])
        whose.append(text[:-k][same])
    crc[0], whose[0] = crc[0][carried:], whose[0][carried:]
    return np.concatenate(crc), np.concatenate(whose)


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(CRC-32 of features, text of each feature, words of each text), in parts: a long text is hashed by windows that
    share two words, so memory is bounded by WINDOW and the longest word."""
    raw = [(t or "").encode() for t in texts]
    if len(raw) == 1 and len(raw[0]) > WINDOW:
        yield from _long(np.frombuffer(raw[0], np.uint8))
        return
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    begin = np.cumsum(size) - size
    starts, ends = _words(data, begin)
    if not len(starts):
        yield np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        return
    text = np.searchsorted(begin + size, starts, "right")
    crc, whose = _runs(registers(data, starts, ends), ends - starts, text)
    yield crc, whose, np.bincount(text, minlength=len(raw))


def _long(raw: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    carry = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    low = 0
    while low < len(raw):
        high = min(low + WINDOW, len(raw))
        while high < len(raw) and _WORD_BYTE[_LOWER[raw[high]]]:  # up to the end of the word
            gap = np.flatnonzero(~_WORD_BYTE[_LOWER[raw[high : high + WINDOW]]])
            high = high + int(gap[0]) if len(gap) else min(high + WINDOW, len(raw))
        data = _LOWER[raw[low:high]]
        starts, ends = _words(data, np.zeros(1, np.int64))
        if len(starts):
            own, n = (registers(data, starts, ends), ends - starts), len(carry[0])
            register, length = (np.concatenate(x) for x in zip(carry, own, strict=True))
            crc, whose = _runs(register, length, np.zeros(len(register), np.int64), n)
            yield crc, whose, np.array([len(starts)])
            carry = register[-2:], length[-2:]
        low = high


def bucket_counts(texts: DataFrame, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket. Every task adds up its own, so at most ``buckets`` rows leave it."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in it:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                for crc, _, _ in features(texts[a:b]):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket's smoothed shares in the target and in the source."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = gain.astype(np.float64)  # whole numbers, whose sums stay exact
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                words, n, weight = (np.zeros(b - a, np.int64) for _ in range(3))
                for crc, whose, counted in features(texts[a:b]):
                    words += counted
                    n += np.bincount(whose, minlength=b - a)
                    weight += np.bincount(whose, value[crc % np.uint32(len(gain))], b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 Gumbel) of a number in (0, 1) that the seed and the id decide."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(key, "UTF-8"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def draw(scored: DataFrame, percent: int) -> DataFrame:
    """``scored`` (doc_id, score, able, ...) with ``rank``: 1, 2, 3 ... for the best ``percent`` % of rows marked able.

    Rows are dealt by ranges of their order and each range is shifted by the rows before it: no task sees them all.
    Better scores first, ties to smaller ids, null ids last; rows with one score and id take places in any order.
    """
    order = [F.when(F.col("able"), 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("m")), "draw-order")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"), F.count(F.when(F.col("able"), 1)).alias("a"))  # a row per range
    all_able = F.coalesce(F.sum("a").over(Window.partitionBy()), F.lit(0))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    shifts = sizes.select("part", (before - F.col("low") + 1).alias("shift"), F.floor(all_able * percent / 100).cast("bigint").alias("take"))
    place = F.col("m") + F.col("shift")
    return dealt.join(F.broadcast(shifts), "part").withColumn("rank", F.when(place <= F.col("take"), place)).drop("part", "m", "shift", "take")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for those not drawn.

    Counts are over all rows of both tables; what reaches the driver is one number a bucket.

    Defined cases: null and empty texts, and texts without words, have no features and weight 0, and texts of less than
    ``least_words`` words are not drawn; a null id has the noise of an empty one and loses ties; rows that repeat count
    and may be drawn each; other columns are ignored; with an empty target all gains follow the corpus alone; an empty
    table gives an empty result.
    """
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_col))
    weighed = weigh(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(weighed.select("doc_id", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("able")), "importance-scores")
    return draw(scored, percent).select("doc_id", "n_features", "weight", "score", "rank")

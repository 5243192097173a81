"""Near-duplicate detection by MinHash with odd sketches.

Every document's set of word shingles is reduced to MinHash samples. Runs of samples form band keys that propose
pairs, and all samples are folded into an odd sketch: a bitmap in which each sample flips one bit, so that the
population count of two sketches' XOR estimates how many samples differ. Pairs that the sketches cannot rule out
are confirmed on the full sets.

Buckets are never expanded into all their pairs. Each bucket tests its members against its smallest one, the hub.
Members that stay outside the hub's component meet the other documents of that hub in tiles of bounded size (see
``tiles``), where the triangle inequality of the Jaccard distance, set sizes and sketches rule most pairs out, and the
documents that have a pair left are decided on their sets; only links leave a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm.components import connected_components
from hayrick.llm.pieces import batches
from hayrick.llm.tiles import outsider_links, sketches_within
from hayrick.session import discard, materialize

BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
BITS = 512
#: Ids that are sent to every task at most: 16 bytes each.
FEW_IDS = 250_000
#: Rows of 32,768 bits in the bitmap of more ids.
BIT_SLOTS = 4096

_RNG = np.random.default_rng(41)
_MARK = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MUL = _RNG.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_ODD = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word after lower-casing A-Z, number of words of each text)."""
    raw = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begin = np.cumsum(sizes) - sizes
    fresh = np.ones(len(data), bool)
    fresh[1:] = blank[:-1]
    fresh[begin[sizes > 0]] = True
    starts = np.flatnonzero(fresh & ~blank)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(starts, prepend=0, append=len(data)))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _STEP)]), dtype=np.uint64)
    h = np.add.reduceat(np.where(blank, np.uint64(0), _MARK[data] * power[place]), starts)
    return _mix(h), np.diff(np.searchsorted(starts, np.append(begin, len(data))))


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Each text's sorted set of shingles, as 64-bit hashes; a text of fewer words has its whole sequence as one."""
    return (s for s, _ in hashed_sets(*word_hashes([t or "" for t in texts]), words))


def hashed_sets(h: np.ndarray, counts: np.ndarray, words: int, cost: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """``shingle_sets`` of ``word_hashes``, and of each shingle the sum of its words' ``cost`` if that is given."""
    gram = np.zeros(len(h), np.uint64)
    total = None if cost is None else np.concatenate([[0], np.cumsum(cost)])
    for k in range(min(words, len(h))):  # a slice may hold fewer words than a shingle
        gram[: len(h) - k] = (gram[: len(h) - k] ^ h[k:]) * _STEP + np.uint64(k + 1) if k else h * _STEP
    gram = _mix(gram)
    stop = np.cumsum(counts)
    for end, n in zip(stop.tolist(), counts.tolist(), strict=True):
        if n >= words:
            s = gram[end - n : end - words + 1]
            if total is None:
                s, sums = np.sort(s), None
            else:
                order = np.argsort(s)
                s, sums = s[order], (total[end - n + words : end + 1] - total[end - n : end - words + 1])[order]
            new = np.concatenate([[True], s[1:] != s[:-1]])
            yield s[new], None if sums is None else sums[new]
        elif n:
            one = np.array([n], np.uint64)
            for at in range(end - n, end):
                one = _mix((one ^ h[at : at + 1]) * _STEP)
            yield one, None if total is None else total[end : end + 1] - total[end - n]
        else:
            yield np.zeros(0, np.uint64), None if total is None else np.zeros(0, total.dtype)


def samples_of(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that is not empty."""
    low = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = None
    for a in range(0, len(low), 2048):
        part = (low[a : a + 2048, None] * _MUL + _ADD).min(0)
        out = part if out is None else np.minimum(out, part)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys: equal where all samples of a band are."""
    wide = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), wide.shape[:2]).copy()
    for r in range(ROWS):
        key = _mix((key ^ wide[:, :, r]) * _STEP + np.uint64(r))
    return key.view(np.int64)


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """(documents, BITS / 64) words of the parity bitmap of all (sample number, sample) pairs."""
    bit = _mix((sig.astype(np.uint64) + np.uint64(1)) * _ODD) % np.uint64(BITS)
    at = np.arange(len(sig), dtype=np.int64)[:, None] * BITS + bit.astype(np.int64)
    odd = (np.bincount(at.ravel(), minlength=len(sig) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sig), BITS), axis=1, bitorder="little").view(np.int64)


def sketch_limit(similarity: float, sigmas: float = 5.8) -> int:
    """The largest XOR population count that a pair of this similarity shows but for a chance of about 1e-8."""
    differ = 2 * SAMPLES * (1 - similarity)
    shrink = (1 - 2 / BITS) ** differ
    mean = BITS / 2 * (1 - shrink)
    from_samples = 2 * math.sqrt(SAMPLES * similarity * (1 - similarity)) * shrink
    return math.ceil(mean + sigmas * math.hypot(from_samples, math.sqrt(mean * (1 - mean / BITS))))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def sketch(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, two fingerprints of the whole set, band keys, odd sketch) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                n, prints, sig = [], [], []
                for s in shingle_sets(texts[a:b], words):
                    n.append(len(s))
                    prints.append((_mix(s).sum(), _mix(s ^ _STEP).sum()))
                    sig.append(samples_of(s) if len(s) else np.zeros(SAMPLES, np.uint32))
                sig = np.array(sig)
                keys, odd = band_keys(sig), odd_sketches(sig)
                prints = np.array(prints, np.uint64).view(np.int64)
                listed = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), listed(keys), listed(odd)],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands", "odd"],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>, odd array<bigint>")


def fingerprints(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and two fingerprints of each set."""
    found = [(len(s), _mix(s).sum().view(np.int64), _mix(s ^ _STEP).sum().view(np.int64)) for s in sets]
    return [pa.array(x, pa.int64()) for x in zip(*found, strict=True)]


def equal_sets(printed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest document of each set (doc_id), and the links (a, b) of all others to it."""
    able = printed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(able.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "dup-classes")
    copies = able.join(classes.where("n > 1"), ["n_shingles", "fp1", "fp2"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return classes.select(F.col("rep").alias("doc_id")), copies


def full_sets(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shingles): the sorted set of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                sets = list(shingle_sets(texts[a:b], words))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "shingles"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _plausible(percent: int) -> F.Column:
    """Whether sizes (na, nb) and sketches (oa, ob) allow the similarity."""
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    count = sum((F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(BITS // 64)), F.lit(0))
    return sizes & (count <= sketch_limit(percent / 100))


def _features(reps: DataFrame, side: str) -> DataFrame:
    return reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n{side}"), F.col("odd").alias(f"o{side}"))


def id_bits(ids: DataFrame) -> DataFrame:
    """(slot, bits): a bitmap of the hashes of ``ids`` (doc_id), in at most BIT_SLOTS rows of 4 kB."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BIT_SLOTS << 15))
    return ids.groupBy(F.shiftright(at, 15).alias("slot")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))


def among(rows: DataFrame, ids: DataFrame, some: bool = True) -> DataFrame:
    """The rows whose doc_id is among written ``ids`` (doc_id), or those whose is not. ``ids`` are sent to the rows if they are
    counted to be few. Their number grows with the corpus: of more a bitmap is sent, and only rows that it cannot settle
    are shuffled."""
    if ids.count() <= FEW_IDS:
        return rows.join(F.broadcast(ids), "doc_id", "left_semi" if some else "left_anti")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(BIT_SLOTS << 15))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).bitwiseAND(F.lit(4095)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int"))
    told = rows.withColumn("slot", F.shiftright(at, 15)).join(F.broadcast(materialize(id_bits(ids), "id-bits")), "slot", "left")
    told = told.withColumn("maybe", F.coalesce(bit == 1, F.lit(False)))
    left = told.where("maybe").select(*rows.columns).hint("merge").join(ids, "doc_id", "left_semi" if some else "left_anti")
    return left if some else left.unionByName(told.where("not maybe").select(*rows.columns))


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles) of the wanted documents, written."""
    wanted = materialize(wanted, "dup-wanted")
    return materialize(full_sets(among(text_rows(docs, id_col, text_col), wanted), words), "dup-sets")


def pair_distances(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds to the pairs (a, b) the Jaccard distance of their full sets and whether they are linked."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(b, "b").join(a, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    both = both.withColumn("whole", F.size("sa") + F.size("sb") - F.col("common"))
    linked = (100 * F.col("common") >= percent * F.col("whole")).alias("linked")
    return both.select(*pairs.columns, (1 - F.col("common") / F.col("whole")).alias("dist"), linked)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; documents are linked at ``percent`` % similarity or more.

    component_id is the smallest doc_id that links lead to. A pair at exactly 80 % is proposed by no band with a
    chance of 3e-6, and more similar pairs with less; every proposed pair is decided on the full sets.

    Defined cases: null, empty or blank text has the empty set and no links; rows that repeat a doc_id are one
    node, which has the links of each; rows with a null doc_id have none and get a null component; other columns
    are ignored; an empty table gives an empty result.
    """
    sketched = materialize(sketch(docs, words, id_col, text_col), "dup-sketches")
    # Equal sets first: one representative of each set goes on, linked to the others.
    first, copies = equal_sets(sketched)
    able = sketched.where("n_shingles > 0 and doc_id is not null")
    reps = materialize(able.join(first, "doc_id", "left_semi").select("doc_id", "n_shingles", "bands", "odd"), "dup-reps")

    rows = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = rows.join(buckets, "key").where("doc_id <> hub").groupBy(F.col("hub").alias("a"), F.col("doc_id").alias("b")).agg(F.max(F.col("members") > 2).alias("crowd"))
    # A pair that shares only buckets of two is settled by its sketches where they suffice.
    stars = stars.join(_features(reps, "b"), "b").join(_features(reps, "a"), "a").where(F.col("crowd") | _plausible(percent)).select("a", "b", "crowd")
    stars = materialize(stars, "dup-stars")
    wanted = stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct()
    sets = sets_of(docs, wanted, words, id_col, text_col)
    stars = materialize(pair_distances(stars, sets, percent), "dup-scored")
    edges = stars.where("linked").select("a", "b").unionByName(copies)
    labels = materialize(connected_components(edges), "dup-labels")

    marks = reps.select("doc_id", F.col("n_shingles").alias("n"), F.col("odd").alias("mark"), F.lit(0).alias("need"))
    crowds = stars.where("crowd").select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), "dist")
    more = outsider_links(crowds, labels, marks, lambda some: sets.join(some, "doc_id", "left_semi"), sketches_within(sketch_limit(percent / 100)), percent)
    if not more.isEmpty():
        whole = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        labels = materialize(connected_components(whole), "dup-labels")

    out = sketched.select("doc_id", "n_shingles").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

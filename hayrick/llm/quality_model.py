"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; everything else is unlabelled. A first classifier tells positives from
unlabelled text; the class prior is the smallest ratio of unlabelled to positive mass above a threshold of its
scores. Then a linear model over standardised text statistics is fitted to the non-negative unbiased risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]).

The fit uses at most SAMPLE positives and SAMPLE unlabelled texts, chosen by a hash of their ids; scoring is one
pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm.pieces import batches
from hayrick.llm.textarrays import BLANK, CLASSES, DIGIT, LETTER, LINE, LOWER, MARK, SYMBOL, UPPER, Texts, classes

#: Bound on the positives, and on the unlabelled texts, that the model is fitted to.
SAMPLE = 20_000
STATS = 13
FEATURES = STATS + CLASSES * CLASSES


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, FEATURES): ratios of letters, symbols, repeats and lines, and shares of neighbouring class pairs."""
    t = Texts.of(texts)
    n = len(texts)
    out = np.zeros((n, FEATURES))
    if not len(t.cp):
        return out
    cls = classes()[t.cp]
    gap = (cls == BLANK) | (cls == LINE)
    start, end = t.runs(~gap)
    doc = t.doc[start]
    words = np.bincount(doc, minlength=n)
    some = np.maximum(words, 1)
    # A word's hash from prefix sums of hashed characters weighted by their place.
    place = np.arange(len(t.cp)) - np.repeat(np.append(0, start), np.diff(start, prepend=0, append=len(t.cp)))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), np.uint64(0x9E3779B97F4A7C15))]), dtype=np.uint64)
    value = (t.cp.astype(np.uint64) + np.uint64(0x5851F42D)) * np.uint64(0xD6E8FEB86659FD93) * power[place]
    word = np.add.reduceat(np.where(gap, np.uint64(0), value), start) if len(start) else np.zeros(0, np.uint64)
    same_doc = doc[1:] == doc[:-1]
    twice = np.bincount(doc[1:][same_doc & (word[1:] == word[:-1])], minlength=n)
    pair = word[:-1] * np.uint64(3) + word[1:]

    def distinct(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        key = (h >> np.uint64(20)) ^ (d.astype(np.uint64) << np.uint64(44))
        _, first = np.unique(key, return_index=True)
        return np.bincount(d[first], minlength=n)

    lines = t.per_text(cls == LINE) + 1
    length = end - start
    size = np.maximum(t.size, 1)
    letters = np.maximum(t.per_text((cls == LOWER) | (cls == UPPER) | (cls == LETTER)), 1)
    lone = length == 1
    out[:, :STATS] = np.stack(
        [
            np.log1p(words), np.minimum(np.log1p(np.bincount(doc, weights=length, minlength=n) / some), 5), distinct(word, doc) / some,
            distinct(pair[same_doc], doc[1:][same_doc]) / some, twice / some, t.per_text(cls == UPPER) / letters, np.minimum(t.per_text(cls == SYMBOL) / some, 3),
            np.minimum(t.per_text(cls == MARK) / some, 3), t.per_text(cls == DIGIT) / size, np.minimum(np.log1p(words / lines), 8), t.per_text(t.cp > 127) / size,
            np.bincount(doc, weights=lone, minlength=n) / some, np.bincount(doc, weights=length > 20, minlength=n) / some,
        ],
        1,
    )
    inside = t.doc[1:] == t.doc[:-1]
    at = (t.doc[1:].astype(np.int64) * CLASSES + cls[:-1]) * CLASSES + cls[1:]
    out[:, STATS:] = np.bincount(at[inside], minlength=n * CLASSES * CLASSES).reshape(n, -1) / size[:, None]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(gradient, size: int, steps: int, rate: float = 0.05) -> np.ndarray:
    """Adam on a parameter vector that starts at zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for k in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Smallest ratio of unlabelled to positive mass above a score, each with a margin for its sampling error."""
    cuts = np.unique(np.quantile(pos, np.linspace(0.02, 0.98, 97)))
    p = np.array([(pos >= c).mean() for c in cuts])
    u = np.array([(unl >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(40) / 2 / len(unl)) + np.sqrt(np.log(40) / 2 / len(pos))
    at = np.argmin((u + margin) / np.maximum(p, 1e-9))
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """(risk of trusted positives, estimated risk of negatives): the second falls below 0 where a model overfits."""
    good = prior * float(np.logaddexp(0, -(p @ w)).mean())
    return good, float(np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean())


def pu_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative unbiased risk; where the negatives' part is below 0, a step that raises it again."""
    fp, fu = _sigmoid(p @ w), _sigmoid(u @ w)
    good = -prior * ((1 - fp)[:, None] * p).mean(0)
    bad = (fu[:, None] * u).mean(0) - prior * (fp[:, None] * p).mean(0)
    return good + bad if pu_risk(w, p, u, prior)[1] >= 0 else -bad


def fit(pos: np.ndarray, unl: np.ndarray, steps: int = 400, decay: float = 1e-4) -> Model:
    """The model from features of positives and of unlabelled texts. Without either, every score is one half."""
    width = pos.shape[1]
    if not len(pos) or not len(unl):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    mean, scale = unl.mean(0), unl.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    one = lambda x: np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], 1)
    mixed = np.random.default_rng(0)  # halves must not follow any pattern in the rows' order
    p, u = one(pos[mixed.permutation(len(pos))]), one(unl[mixed.permutation(len(unl))])
    half = slice(0, None, 2), slice(1, None, 2)

    def tell(w: np.ndarray) -> np.ndarray:
        a, b = p[half[0]], u[half[0]]
        return -((1 - _sigmoid(a @ w))[:, None] * a).mean(0) + (_sigmoid(b @ w)[:, None] * b).mean(0) + decay * w

    w = _descend(tell, width + 1, steps // 2)
    check = (p[half[1]], u[half[1]]) if len(p) > 1 and len(u) > 1 else (p, u)
    prior = estimate_prior(check[0] @ w, check[1] @ w)

    w = _descend(lambda w: pu_gradient(w, p, u, prior) + decay * w, width + 1, steps)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def _feature_rows(rows: DataFrame, most: int) -> np.ndarray:
    """Features of a bounded sample, on the driver: at most ``most`` rows of FEATURES numbers; texts stay where they are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(0).to_pylist()
            for a, b in batches(texts):
                x = features(texts[a:b])
                ends = pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["x"])

    table = rows.select("text").mapInArrow(run, "x array<double>").limit(most).toArrow()
    return table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if table.num_rows else np.zeros((0, FEATURES))


def train(docs: DataFrame, positives: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, seed: int = 5) -> Model:
    """Fits the model to rows of ``docs`` whose id is in ``positives`` (one column of ids), and to rows of ``docs`` at large.

    Both samples are thinned by a hash of the id to ``sample`` rows on average, before any text is moved.

    Defined cases: null ids match no positive and belong to the rows at large; rows that repeat an id are in or out of a
    sample together; null and empty texts have all features 0; without positives or without rows every score is one half.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    trusted = positives.toDF("doc_id").distinct()
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / float(1 << 53)
    thin = lambda df, n: df.where(unit < min(1.0, sample / max(n, 1)))
    picked = thin(trusted, trusted.count())
    chosen = source.join(picked, "doc_id", "left_semi")
    return fit(_feature_rows(chosen, 2 * sample), _feature_rows(thin(source, source.count()), 2 * sample))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability that a text is good, from its whole text.

    Defined cases: null and empty texts have all features 0 and get that vector's score; every row is scored by
    itself; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(1).to_pylist()
            for a, b in batches(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(model.score(features(texts[a:b])))], names=["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")

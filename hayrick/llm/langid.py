"""Language identification of mixed-language text.

Training counts, over all labelled texts, hashed letter trigrams inside words and the scripts of letters, by language.
For a text, the script of each word narrows the languages; trigram log-probabilities score the word in each of them;
Viterbi over the words with a penalty for switching labels spans. The language of most letters is the text's.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm.textarrays import LETTER, LOWER, UPPER, Texts, classes, letters
from hayrick.llm.pieces import batches

BUCKETS = 1 << 16
#: A model holds BUCKETS * languages numbers; more languages than this are refused.
MOST_LANGUAGES = 512
#: Words times languages that are in memory at a time, but for a longer text, which is walked whole.
CELLS = 1 << 23
SWITCH = 9.0
SMOOTH = 0.5
#: A language is a candidate for a script that holds at least this part of its letters.
SCRIPT_SHARE = 0.002

# First code points of script ranges, in order, each range running to the next one.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB10, "Other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"),
    (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
)
_NAMES = sorted({name for _, name in SCRIPTS})
_FROM = np.array([a for a, _ in SCRIPTS], np.uint32)
_SCRIPT = np.array([_NAMES.index(name) for _, name in SCRIPTS], np.uint8)


@dataclass
class Words:
    start: np.ndarray  # code point indices into the texts
    end: np.ndarray
    gram: np.ndarray  # bucket of the trigram around each letter, word after word
    script: np.ndarray  # script of each word's first letter
    per_text: np.ndarray  # words of each text


def words_of(texts: list[str | None]) -> tuple[Texts, Words]:
    t = Texts.of([x and x.lower() if x is None or len(x.lower()) == len(x) else "".join(c if len(c.lower()) != 1 else c.lower() for c in x) for x in texts])
    cls = classes()[t.cp]
    letter = (cls == LOWER) | (cls == UPPER) | (cls == LETTER)
    start, end = t.runs(letter)
    # Runs of combining marks alone are no words.
    upto = np.concatenate([[0], np.cumsum(letters()[t.cp], dtype=np.int64)])
    real = upto[end] > upto[start]
    for a, b in zip(start[~real].tolist(), end[~real].tolist(), strict=True):
        letter[a:b] = False
    start, end = start[real], end[real]
    cp = t.cp.astype(np.uint64)
    before, after = np.roll(cp, 1), np.roll(cp, -1)
    before[start] = 0
    after[end - 1] = 0
    h = ((before * np.uint64(0x9E3779B97F4A7C15)) ^ (cp + np.uint64(0x51ED27))) * np.uint64(0xD6E8FEB86659FD93)
    h = ((h ^ (h >> np.uint64(29))) + after) * np.uint64(0x94D049BB133111EB)
    gram = ((h >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)[letter]
    script = _SCRIPT[np.searchsorted(_FROM, t.cp[start], "right") - 1] if len(start) else np.zeros(0, np.uint8)
    per_text = np.diff(np.searchsorted(start, np.append(t.begin, len(t.cp))))
    return t, Words(start, end, gram, script, per_text)


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # (BUCKETS, languages) log-probabilities
    candidate: np.ndarray  # (scripts, languages) of 0 and 1


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts trigrams and scripts by language over all rows with a language.

    Partitions add up their texts first, so at most (BUCKETS + scripts) * languages rows leave each of them. Defined
    cases: rows with a null language, and null or empty texts, teach nothing; repeated rows count each; ids are not
    used; an empty table gives a model without languages; more than MOST_LANGUAGES languages fail.
    """
    source = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in it:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                own = sorted(set(langs[a:b]))
                if len(seen.keys() | set(own)) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                _, w = words_of(texts[a:b])
                number = np.repeat(np.array([own.index(x) for x in langs[a:b]], np.int64), w.per_text)
                width = BUCKETS + len(_NAMES)
                length = w.end - w.start
                counts = np.bincount(np.repeat(number, length) * width + w.gram, minlength=len(own) * width)
                counts = counts + np.bincount(number * width + BUCKETS + w.script, weights=length, minlength=len(own) * width).astype(np.int64)
                for lang, row in zip(own, counts.reshape(len(own), width), strict=True):
                    seen[lang] = seen.get(lang, 0) + row
        for lang, row in seen.items():
            at = np.flatnonzero(row)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], names=["lang", "bucket", "n"])

    rows = source.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = rows.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((BUCKETS + len(_NAMES), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    counts[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    used = max(1, int((grams.sum(1) > 0).sum()))
    score = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * used)).astype(np.float32)
    return Model(languages, score, scripts / np.maximum(scripts.sum(0), 1) >= SCRIPT_SHARE)


def viterbi(score: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; texts are walked side by side, the longest first.

    ``score`` is (words, languages), text after text; ``counts`` has the words of each text.
    """
    out = np.zeros(len(score), np.uint16)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return out
    begin = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    live = np.searchsorted(-length, -np.arange(int(length[0])), "left")  # texts with more than t words
    best = score[begin].copy()
    came = np.full(len(score), -1, np.int32)  # the language switched from
    stay = np.ones(score.shape, bool)
    for t in range(1, int(length[0])):
        k = live[t]
        now = best[:k]
        top = now.argmax(1)
        jump = now[np.arange(k), top] - switch
        at = begin[:k] + t
        keep = now >= jump[:, None]
        stay[at], came[at] = keep, top
        best[:k] = np.where(keep, now, jump[:, None]) + score[at]
    state = np.zeros(len(order), np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        k = live[t]
        last = live[t + 1] if t + 1 < len(live) else 0
        state[last:k] = best[last:k].argmax(1)
        at = begin[:k] + t
        out[at] = state[:k]
        if t:
            row = np.arange(k)
            state[:k] = np.where(stay[at, state[:k]], state[:k], came[at])
    return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every row; spans are (start, end, lang) in code points.

    score is the share of letters in spans of the predicted language. Defined cases: null text, or text without a
    letter (combining marks alone are none), is ``und`` with score 0 and no spans; equal shares go to the first language by name; a word whose
    script no language uses fits all alike; with no languages learned everything is ``und``; other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # The model's size is bounded by BUCKETS * MOST_LANGUAGES floats.
    packed = spark.sparkContext.broadcast(pickle.dumps((model.languages, model.score, model.candidate)))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    def measure(texts: list[str | None], table: np.ndarray, candidate: np.ndarray) -> tuple[np.ndarray, ...]:
        """(points of every word in every language, words of each text, where words start and end in their text)."""
        t, w = words_of(texts)
        many = table.shape[1]
        points = np.zeros((len(w.start), many), np.float32)
        if points.size:
            length = w.end - w.start
            first = np.cumsum(length) - length
            for j in range(many):
                points[:, j] = np.add.reduceat(table[:, j][w.gram], first)
            fits = candidate[w.script]
            points[~(fits | ~fits.any(1, keepdims=True))] = -1e6
        shift = np.repeat(t.begin, w.per_text)
        return points, w.per_text, w.start - shift, w.end - shift

    def label(ids: pa.Array, parts: list[tuple[np.ndarray, ...]], languages: list[str]) -> pa.RecordBatch:
        points, per_text, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        many, n, names = len(languages), len(ids), ["doc_id", "lang_pred", "score", "spans"]
        if not points.size:
            none = pa.array([[]] * n, pa.list_(span))
            return pa.RecordBatch.from_arrays([ids, pa.array(["und"] * n), pa.array([0.0] * n), none], names=names)
        best = viterbi(points, per_text, switch)
        doc = np.repeat(np.arange(n), per_text)
        share = np.bincount(doc * many + best, weights=end - start, minlength=n * many).reshape(n, many)
        total = share.sum(1)
        pred = share.argmax(1)
        score = share[np.arange(n), pred] / np.maximum(total, 1)
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])]))
        stop = np.append(cut[1:], len(doc))
        flat = pa.StructArray.from_arrays([pa.array(start[cut].astype(np.int32)), pa.array(end[stop - 1].astype(np.int32)), pa.array(languages).take(pa.array(best[cut].astype(np.int32)))], fields=list(span))
        edges = np.concatenate([[0], np.cumsum(np.bincount(doc[cut], minlength=n))]).astype(np.int32)
        guess = [languages[p] if letters_of else "und" for p, letters_of in zip(pred.tolist(), total.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(guess, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(edges), flat)], names=names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, candidate = pickle.loads(packed.value)
        for batch in it:
            texts = batch.column(1).to_pylist()
            low, parts, cells = 0, [], 0
            for a, b in batches(texts):
                parts.append(measure(texts[a:b], table, candidate))
                cells += parts[-1][0].size
                if cells > CELLS or b == len(texts):  # texts are walked side by side, as many as memory allows
                    yield label(batch.column(0).slice(low, b - low), parts, languages)
                    low, parts, cells = b, [], 0

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")

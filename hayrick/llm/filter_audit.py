"""Filter interaction audit: what every order of the same filters removes, step by step.

A document is known by the mask of filters that it fails, and in a given order it is removed at the first step whose
filter is in its mask. Orders are numbered lexicographically by their Lehmer codes, so all orders that begin alike have
consecutive numbers. For a mask the orders that remove it at a step are therefore a few intervals: one for each beginning
of that many filters of which the last alone is in the mask. The counts of a mask are added where such an interval begins
and subtracted where it ends (a difference array for each step), and one prefix sum over the numbers gives what is
removed at that step in every order.

Spark counts documents by part and mask; only those counts, at most 2 ** filters for a part, meet the arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayrick.llm.common import WORD
from hayrick.session import materialize

#: Parts whose arrays are computed at a time.
PARTS = 128
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rank_of(beginning: tuple[int, ...], k: int) -> int:
    """The lexicographic number of the first order of ``k`` filters that begins so (its Lehmer code as a number)."""
    return sum((x - sum(y < x for y in beginning[:i])) * factorial(k - 1 - i) for i, x in enumerate(beginning))


def interval_ends(k: int) -> np.ndarray:
    """(masks, (orders + 1) * k): +1 where an interval of orders that remove the mask at a step begins, -1 where it ends."""
    out = np.zeros((1 << k, factorial(k) + 1, k), np.int64)
    masks = np.arange(1 << k)
    for step in range(k):
        for beginning in permutations(range(k), step + 1):
            first = rank_of(beginning, k)
            passed = sum(1 << x for x in beginning[:-1])
            own = masks[(masks & passed == 0) & (masks >> beginning[-1] & 1 == 1)]
            out[own, first, step] += 1
            out[own, first + factorial(k - 1 - step), step] -= 1
    return out.reshape(1 << k, -1)


def audit_counts(counts: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The seven counts as (parts, orders, steps) arrays from (parts, 3, masks): documents, good ones and toxic ones."""
    orders = np.array(list(permutations(range(k))))
    removed, good, toxic = np.moveaxis((counts @ interval_ends(k)).reshape(len(counts), 3, -1, k).cumsum(2)[:, :, :-1], 1, 0)
    fails = np.stack([counts[:, 0, np.arange(1 << k) >> f & 1 == 1].sum(1) for f in range(k)], 1)
    alone = counts[:, 0, 1 << np.arange(k)]
    shapley = np.stack([np.where(orders == f, removed, 0).sum((1, 2)) for f in range(k)], 1)
    kept = counts[:, 0].sum(1)[:, None, None] - removed.cumsum(2)
    return dict(zip(COUNTS, (kept, removed, fails[:, orders] - removed, alone[:, orders], good, toxic, shapley[:, orders]), strict=True))


def audit(flags: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, and the seven counts): one row for each part, order of ``letters`` and step.

    ``flags`` has part, mask (bit i: the document fails filter i), good and toxic. Counts are of documents of the part:
    kept after the step, removed by it, redundant (failing its filter, removed earlier), unique_fails (failing its filter
    alone), good_lost and toxic_lost (removed by it), shapley (removed by its filter, summed over all orders).

    Defined cases: rows that repeat count each; a null mask counts as 0, null flags as no, a null part as the empty
    string; an empty table gives an empty result.
    """
    k = len(letters)
    sums = flags.select(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).alias("mask"), *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("bigint").alias(c) for c in ("good", "toxic")])
    sums = sums.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 2 ** k
    names = ["".join(letters[f] for f in p) for p in permutations(range(k))]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for a in range(0, len(pdf), PARTS):
                some = pdf.iloc[a : a + PARTS]
                counts = np.zeros((len(some), 3, 1 << k), np.int64)
                for i, listed in enumerate(some["counts"]):
                    for c in listed:
                        counts[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                rows = len(names) * k
                found = {"part": np.repeat(some["part"].to_numpy(), rows), "filter_order": np.tile(np.repeat(names, k), len(some)), "step": np.tile(np.arange(1, k + 1), len(some) * len(names))}
                yield pd.DataFrame(found | {name: x.ravel() for name, x in audit_counts(counts, k).items()})

    return parts.mapInPandas(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself: A few words, B repeated words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 65 * n.cast("bigint"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 5 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, mask): bits 0 to 4 tell which of the filters A to E every row fails; E is a text of a smaller id.

    The smallest id of each text is found by its SHA-256 with sums before the shuffle, and meets its own row by digest
    and id, so that no group of copies, however large, comes to one task.

    Defined cases: null text is the empty text, which is a text like others; a null id comes after every other, so its
    text is a copy if any row with an id holds it, while null ids alone are no copies of each other; rows that repeat the
    smallest id of a text are all first; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(part_col).cast("string").alias("part"), text.alias("text"))
    found = text_failures(F.col("text"))
    mask = sum((F.when(failed, 1 << i).otherwise(0) for i, failed in enumerate(found.values())), F.lit(0))
    thin = materialize(some.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-masks")
    first = thin.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    same = (thin["digest"] == first["digest"]) & thin["doc_id"].eqNullSafe(first["doc_id"])
    copy = F.when(first["first"].isNull(), 1 << len(found)).otherwise(0)
    return thin.join(first, same, "left").select(thin["doc_id"], "part", (F.col("mask") + copy).alias("mask"))


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of filters A to E over documents with the labels (doc_id, quality, toxic) that some of them have.

    Defined cases as in ``failures`` and ``audit``; of labels that repeat an id any that says so counts; rows without
    labels, or with null ones, are neither good nor toxic.
    """
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return audit(failures(docs, id_col, text_col, part_col).join(marks, "doc_id", "left"), "ABCDE")

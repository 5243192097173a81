"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Inside a source a document's expected number of copies grows with its
length class; the whole part of that number is certain, and the fractional part is its inclusion probability
in a Pareto order sample: documents are ranked by random odds over inclusion odds and a prefix is taken. The
prefix ends where the words taken come closest to the target, so the sample's size is fixed in words.

Nothing needs a source's rows in one place: words are summed over ranges of ranks, the range in which a source's target
falls is divided again until it holds at most EDGE documents, and only those are ordered row by row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.llm.common import key_of, small_table, uniform, water_fill, word_count
from hayrick.session import materialize

#: Source weights, repeated in the order of the source names.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Ranks are whole numbers of RANK_BITS bits, divided into 2^BIN_BITS ranges at a time.
RANK_BITS, BIN_BITS = 53, 11
#: Documents of a source that are ordered row by row around its target.
EDGE = 1000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> target words of each source.

    One row per source: the ordering that deals out the weights runs over source names, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    return water_fill(
        sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights))).withColumn("_all", total),
        F.col("_all"), F.lit(float(most)) * F.col("source_size"), F.when(F.col("source_size") > 0, F.col("weight")).otherwise(0.0), [], "target",
    ).drop("_all", "weight")


def _rank(u: Column, odds: Column) -> Column:
    """The Pareto order as a whole number: random odds over inclusion odds, by their logarithm, which spreads odds of any
    size over the range."""
    logit = F.log(u / (F.lit(1.0) - u)) - F.log(odds)
    return F.floor((F.greatest(F.lit(-99.0), F.least(F.lit(99.0), logit)) + F.lit(100.0)) * F.lit(float(1 << 45))).cast("bigint")


def find_edges(ranked: DataFrame, edge: int = EDGE) -> DataFrame:
    """(skey, low, high, words_in): ranks below ``low`` are in, from ``high`` on out, and words_in words lie below ``low``.

    ``ranked`` has skey, rank, size > 0 and the source's residual target. The range between the two holds at most ``edge``
    documents, unless they share one rank. All sources are refined together; nothing but their number goes to the driver.
    """
    todo = ranked.groupBy("skey").agg(F.max("residual").alias("residual"))
    todo = materialize(todo.select("skey", "residual", F.lit(0).cast("bigint").alias("base"), F.lit(RANK_BITS - BIN_BITS).alias("shift"), F.lit(0).cast("bigint").alias("before")), "mix-open")
    done = []
    while not todo.isEmpty():
        bins = ranked.drop("residual").join(todo, "skey").withColumn("bin", F.expr("shiftright(rank - base, shift)")).where((F.col("bin") >= 0) & (F.col("bin") < 1 << BIN_BITS))
        bins = bins.groupBy("skey", "residual", "base", "shift", "before", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("skey").orderBy("bin"))
        bins = bins.withColumn("upto", upto)
        over = F.when(F.col("upto") > F.col("residual"), F.struct("bin", "n", "upto", "words"))
        hit = bins.groupBy("skey", "residual", "base", "shift").agg(F.min(over).alias("hit"), F.max("upto").alias("all"))
        low = F.col("base") + F.expr("shiftleft(hit.bin, shift)")
        high = low + F.expr("shiftleft(1L, shift)")
        start = F.col("hit.upto") - F.col("hit.words")
        found = hit.select(
            "skey", "residual", "shift",
            F.coalesce(low, F.lit(1 << 62)).alias("low"), F.coalesce(high, F.lit(1 << 62)).alias("high"), F.coalesce(start, "all").alias("words_in"),
            (F.col("hit").isNull() | (F.col("hit.n") <= edge) | (F.col("shift") == 0)).alias("done"),
        )
        found = materialize(found, "mix-edges")
        done.append(found.where("done").select("skey", "low", "high", "words_in"))
        todo = found.where("not done").select("skey", "residual", F.col("low").alias("base"), F.greatest(F.lit(0), F.col("shift") - BIN_BITS).alias("shift"), F.col("words_in").alias("before"))
    none = small_table(ranked.sparkSession, [], "skey string, low bigint, high bigint, words_in bigint")
    return functools.reduce(DataFrame.unionByName, done, none)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """How many copies of each document the mix takes.

    Returns one row per input row: doc_id, size, source_size, target, copies, taken (= copies * size).

    Defined cases: null or empty text has size 0 and, like any document of size 0, is never taken; a null source
    is a source of its own, last in order; rows that repeat a doc_id are separate documents; an empty table gives
    an empty result; other columns of the input are ignored.
    """
    size = word_count(F.col(text_col)) if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    rows = rows.withColumns(
        {
            "skey": key_of(F.col("source")),
            "len_class": F.floor(F.log2(F.col("size") + 1)).cast("int"),
            "u": uniform(F.col("doc_id"), F.col("size"), F.col("source"), seed=seed),
        }
    )
    rows = materialize(rows.select("doc_id", "skey", "source", "size", "len_class", "u"), "mix-sizes")

    classes = materialize(rows.groupBy("skey", "source", "len_class").agg(F.sum("size").alias("words")), "mix-classes")
    sources = materialize(source_targets(classes.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, share, most), "mix-targets")

    # Expected copies of a document of each length class: proportional to 1 + class / 16, at most `most`.
    classes = classes.join(sources.select("skey", "source_size", "target"), "skey")
    boost = F.lit(1.0) + F.col("len_class") / F.lit(16.0)
    classes = water_fill(classes, F.col("target"), F.lit(float(most)) * F.col("words"), boost * F.col("words"), ["skey"], "share")
    expected = F.when(F.col("words") > 0, F.least(F.lit(float(most)), F.col("share") / F.col("words"))).otherwise(F.lit(0.0))
    classes = classes.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + F.lit(1e-12)).cast("bigint"))
    rest = F.greatest(F.lit(0.0), F.col("expected") - F.col("whole"))
    classes = classes.withColumn("odds", F.when(rest > 1e-12, rest / (F.lit(1.0) - rest)))
    residual = F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("skey")))
    classes = materialize(classes.withColumn("residual", residual).select("skey", "len_class", "source_size", "target", "whole", "odds", "residual"), "mix-odds")

    ranked = rows.join(classes, ["skey", "len_class"]).withColumn("rank", F.when(F.col("size") > 0, _rank(F.col("u"), F.col("odds"))))
    result = ["doc_id", "size", "source_size", "target", "whole"]
    ranked = materialize(ranked.select("skey", "rank", "residual", *result), "mix-ranked")
    edges = materialize(find_edges(ranked.where("rank is not null").select("skey", "rank", "residual", "size")), "mix-edge")
    ranked = ranked.join(edges, "skey", "left")
    between = F.coalesce((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), F.lit(False))
    settled = ranked.where(~between).select(*result, F.coalesce(F.col("rank") < F.col("low"), F.lit(False)).cast("bigint").alias("extra"))
    order = Window.partitionBy("skey").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("words_in")
    edge = ranked.where(between).withColumn("extra", (earlier + F.col("size") / 2 <= F.col("residual")).cast("bigint")).select(*result, "extra")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0)).cast("bigint")
    return (
        settled.unionByName(edge)
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )

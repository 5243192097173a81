"""Ranking metrics. ``ranked`` has (query_id, page_id, rank), ``relevant`` (query_id, page_id), ``queries`` query_id.

Two gains exist side by side: ``ndcg`` leaves ranks 1 and 2 undiscounted (rank r >= 2 is divided by log2 r) and drops
repeated pages first; ``ndcg_standard`` divides by log2(r + 1) and does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _discount(r: Column, standard: bool) -> Column:
    r = r.cast("double")
    return F.log2(r + 1.0) if standard else F.when(r < 2, F.lit(1.0)).otherwise(F.log2(r))


def _ideal(n: Column, k: int, standard: bool) -> Column:
    steps = F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int"))
    return F.when(n > 0, F.aggregate(F.transform(steps, lambda i: F.lit(1.0) / _discount(i, standard)), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def distinct_ranks(ranked: DataFrame) -> DataFrame:
    """Each page at its first place, places closed up."""
    first = ranked.groupBy("query_id", "page_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def per_query(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_relevant, ndcg, ndcg_standard, recall, first_relevant_rank) of every query.

    Defined cases: a query without relevant or without ranked pages scores 0, its first relevant rank is null; relevant
    pairs that repeat count once; pages of queries that are not asked are ignored; no queries give no rows.
    """
    rel = relevant.select("query_id", "page_id").distinct()
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    hits = distinct_ranks(ranked).join(rel, ["query_id", "page_id"]).where(F.col("rank") <= k)
    own = hits.groupBy("query_id").agg(F.sum(F.lit(1.0) / _discount(F.col("rank"), False)).alias("dcg"), F.count(F.lit(1)).alias("found"))
    plain = ranked.join(rel, ["query_id", "page_id"])
    std = plain.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.lit(1.0) / _discount(F.col("rank"), True))).alias("dcg_standard"), F.min("rank").alias("first_relevant_rank")
    )
    rows = queries.select("query_id").join(total, "query_id", "left").join(own, "query_id", "left").join(std, "query_id", "left")
    n = F.coalesce("n_relevant", F.lit(0))
    ratio = lambda dcg, standard: F.round(F.when(n > 0, F.coalesce(dcg, F.lit(0.0)) / _ideal(n, k, standard)).otherwise(F.lit(0.0)), 6)
    return rows.select(
        "query_id",
        n.cast("bigint").alias("n_relevant"),
        ratio("dcg", False).alias("ndcg"),
        ratio("dcg_standard", True).alias("ndcg_standard"),
        F.round(F.when(n > 0, F.coalesce("found", F.lit(0)) / n).otherwise(F.lit(0.0)), 6).alias("recall"),
        F.col("first_relevant_rank").cast("int").alias("first_relevant_rank"),
    )


def recall_at(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, depths: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """(query_id, k, recall) at several depths; a query without relevant pages has recall 0, repeated pages count once."""
    rel = relevant.select("query_id", "page_id").distinct()
    total = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    found = distinct_ranks(ranked).join(rel, ["query_id", "page_id"]).groupBy("query_id").agg(*[F.count(F.when(F.col("rank") <= k, 1)).alias(f"at{k}") for k in depths])
    rows = queries.select("query_id").join(total, "query_id", "left").join(found, "query_id", "left")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"at{k}", F.lit(0)).alias("hits")) for k in depths])
    rows = rows.select("query_id", "n", F.explode(each).alias("d"))
    return rows.select("query_id", "d.k", F.round(F.when(F.col("n") > 0, F.col("d.hits") / F.col("n")).otherwise(F.lit(0.0)), 6).alias("recall"))


def means(scores: DataFrame) -> DataFrame:
    """One row of means; no queries give 0."""
    return scores.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in ("ndcg", "ndcg_standard", "recall")], F.count(F.lit(1)).alias("n_queries"))


def error_report(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, k: int = 10, text: str = "query") -> DataFrame:
    """One row per query, worst first: the standard NDCG, first relevant rank, relevant ids and returned ids."""
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    rel = relevant.groupBy("query_id").agg(listed(F.sort_array(F.collect_set("page_id"))).alias("relevant_page_ids"))
    top = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(listed(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page_id"))), lambda s: s["page_id"])).alias("returned"))
    rows = per_query(queries, ranked, relevant, k).join(queries.select("query_id", text), "query_id").join(rel, "query_id", "left").join(top, "query_id", "left")
    return rows.select(
        "query_id", text, F.col("ndcg_standard").alias("ndcg_at_k"), "first_relevant_rank",
        F.coalesce("relevant_page_ids", F.lit("")).alias("relevant_page_ids"), F.coalesce("returned", F.lit("")).alias("returned"),
    ).orderBy("ndcg_at_k", "query_id")

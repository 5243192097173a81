"""Roll-up of chunk scores to pages, ranking, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.config import DEFAULT, Settings


def _by_score() -> Column:
    return [F.col("score").desc(), F.col("page_ord")]


def roll_up(scored: DataFrame, pages: DataFrame, alpha: float, topn: int) -> DataFrame:
    """(query_id, page_id, page_ord, score) from matched chunk scores (query_id, page_id, chunk_id, score >= 0).

    The mean runs over the best min(topn, n_chunks) chunks of the page, unmatched ones counting as 0; ``pages`` gives
    n_chunks and page_ord. Scores are rounded to six places so that ties fall to page_ord.

    Defined cases: chunks that repeat count each; pages that ``pages`` does not know are left out; null scores are
    left out; an empty table gives an empty result.
    """
    best = Window.partitionBy("query_id", "page_id").orderBy(F.col("score").desc())
    top = scored.where(F.col("score").isNotNull()).withColumn("r", F.row_number().over(best)).where(F.col("r") <= topn)
    sums = top.groupBy("query_id", "page_id").agg(F.max("score").alias("most"), F.sum("score").alias("total"))
    mean = F.col("total") / F.least(F.lit(topn), F.col("n_chunks")).cast("double")
    score = F.round(F.lit(float(alpha)) * F.col("most") + F.lit(1.0 - alpha) * mean, 6)
    return sums.join(pages.select("page_id", "page_ord", "n_chunks"), "page_id").select("query_id", "page_id", "page_ord", score.alias("score"))


def zero_pages(queries: DataFrame, pages: DataFrame, depth: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, page_ord) of the pages that a list of ``depth`` can need beyond those with a match.

    If m < depth pages match, the first ``depth`` pages in page order hold at least depth - m unmatched ones; so those
    suffice. With ``allowed`` (query_id, page_id, page_ord), the first allowed pages of each query that has any.
    """
    first = pages.select("page_id", "page_ord").orderBy("page_ord").limit(depth).collect()
    kind = pages.schema["page_id"].dataType.simpleString()
    listed = F.array(*[F.struct(F.lit(r["page_id"]).cast(kind).alias("page_id"), F.lit(r["page_ord"]).cast("bigint").alias("page_ord")) for r in first])
    listed = listed.cast(f"array<struct<page_id:{kind},page_ord:bigint>>")
    with_first = lambda q: q.select("query_id", F.explode(listed).alias("p")).select("query_id", "p.page_id", "p.page_ord")
    if allowed is None:
        return with_first(queries)
    own = Window.partitionBy("query_id").orderBy("page_ord")
    limited = allowed.withColumn("r", F.row_number().over(own)).where(F.col("r") <= depth)
    free = queries.select("query_id").join(allowed.select("query_id").distinct(), "query_id", "left_anti")
    return limited.select("query_id", "page_id", "page_ord").unionByName(with_first(free))


def fill_zero(scored: DataFrame, queries: DataFrame, pages: DataFrame, depth: int, allowed: DataFrame | None = None) -> DataFrame:
    """Page scores (query_id, page_id, page_ord, score) with the pages of ``zero_pages`` added at score 0.

    Of a page that is listed already, the greater score stays; null scores are left out.
    """
    both = scored.select("query_id", "page_id", "page_ord", "score").unionByName(zero_pages(queries, pages, depth, allowed).withColumn("score", F.lit(0.0)))
    return both.groupBy("query_id", "page_id", "page_ord").agg(F.max("score").alias("score")).where(F.col("score").isNotNull())


def rank(scored: DataFrame, depth: int) -> DataFrame:
    """The best ``depth`` pages of each query with their rank; ties go to the earlier page, null scores come last."""
    order = Window.partitionBy("query_id").orderBy(*_by_score())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def fuse(dense: DataFrame | None, sparse: DataFrame | None, settings: Settings = DEFAULT) -> DataFrame:
    """(query_id, page_id, score, rank): reciprocal rank fusion; ties keep the dense order, then the sparse one.

    Defined cases: a page that one leg lacks gets nothing from it; one leg alone keeps its order; two empty legs give an
    empty result. Ranks are expected to be distinct within a query and leg, as ``rank`` gives them.
    """
    if dense is None and sparse is None:
        raise ValueError("no ranking to fuse")
    listed = lambda df, name: df.select("query_id", "page_id", F.col("rank").alias(name))
    if dense is None:
        both = listed(sparse, "sparse_rank").withColumn("dense_rank", F.lit(None).cast("int"))
    elif sparse is None:
        both = listed(dense, "dense_rank").withColumn("sparse_rank", F.lit(None).cast("int"))
    else:
        both = listed(dense, "dense_rank").join(listed(sparse, "sparse_rank"), ["query_id", "page_id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(settings.rrf_k)) + F.col(c)), F.lit(0.0))
    both = both.withColumn("score", part("dense_rank") + part("sparse_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank"))
    return both.withColumn("rank", F.row_number().over(order)).select("query_id", "page_id", "score", "rank")

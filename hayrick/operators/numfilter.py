"""The number filter: a query that names numbers keeps pages that carry one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hayrick.functions import text as T


def page_numbers(rows: DataFrame, numbers: str = "numbers") -> DataFrame:
    """(page_id, page_ord, number): the numbers of each page, once each; of rows without that column those of their text. An inner
    explode would have Spark look in the scan for rows that have numbers, before ``of_listed`` leaves rows out."""
    own = F.col(numbers) if numbers in rows.columns else T.numbers(F.col("text"))
    return rows.select("page_id", "page_ord", F.explode_outer(own).alias("number")).where(F.col("number").isNotNull()).distinct()


def asked_numbers(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, number): the numbers that queries name."""
    return queries.select("query_id", F.explode(T.query_numbers(F.coalesce(F.col(text), F.lit("")))).alias("number"))


def allowed_pages(queries: DataFrame, numbered: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, page_id, page_ord) for queries whose numbers some page carries; other queries are not filtered."""
    return asked_numbers(queries, text).join(numbered, "number").select("query_id", "page_id", "page_ord").distinct()


def allowed_of(listed: DataFrame, queries: DataFrame, numbered: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, page_id): of the listed pages (query_id, page_id) those that carry one of their query's numbers.

    For pruning after fusion this is enough: a query whose numbers no page carries and one whose numbers no listed page
    carries both keep their lists. So the pages of a number are never listed, however many carry it.
    """
    pairs = listed.select("query_id", "page_id").join(asked_numbers(queries, text), "query_id")
    return pairs.join(numbered.select("page_id", "number"), ["page_id", "number"], "left_semi").select("query_id", "page_id").distinct()


def of_listed(rows: DataFrame, listed: DataFrame, broadcast_rows: int) -> DataFrame:
    """``rows`` of listed pages alone where these are at most ``broadcast_rows``, else all: no text of another page is searched for
    numbers, and none of its numbers is shuffled. ``listed`` is counted first, so it should lie written."""
    pages = listed.select("page_id").distinct()
    return rows.join(F.broadcast(pages), "page_id", "left_semi") if pages.count() <= broadcast_rows else rows


def keep_allowed(scored: DataFrame, allowed: DataFrame) -> DataFrame:
    """Before ranking: rows of filtered queries go unless their page is allowed."""
    filtered = allowed.select("query_id").distinct().withColumn("_f", F.lit(True))
    flagged = scored.join(allowed.select("query_id", "page_id").withColumn("_a", F.lit(True)), ["query_id", "page_id"], "left").join(filtered, "query_id", "left")
    return flagged.where("_a or _f is null").drop("_a", "_f")


def prune(fused: DataFrame, allowed: DataFrame) -> DataFrame:
    """After fusion: allowed pages only, unless none is left for the query; ranks close up.

    Defined cases: a query that ``allowed`` does not name keeps its list; allowed pages that repeat count once; an
    empty list stays empty.
    """
    flagged = fused.join(allowed.select("query_id", "page_id").distinct().withColumn("_a", F.lit(1)), ["query_id", "page_id"], "left")
    some = F.max("_a").over(Window.partitionBy("query_id"))
    kept = flagged.withColumn("_some", some).where("_a = 1 or _some is null")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("rank", place).drop("_a", "_some")

"""Files in and out: pages, labelled queries, reports, chunk dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hayrick.functions import text as T
from hayrick.session import materialize

_PAGE = t.StructType([t.StructField("page_id", t.StringType()), t.StructField("title", t.StringType()), t.StructField("content", t.StringType())])


def _page_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_PAGE).json(path, multiLine=True, pathGlobFilter="*.json").withColumn("file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("file", r"\.json$", "")
    return rows.select(T.page_id(F.coalesce("page_id", stem)).alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"), "file")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per page, in the order of the file names as strings; the id defaults to the file's stem.

    A missing folder fails. ``page_ord`` numbers the names from 0: names are dealt by range and sorted within their
    range, and each range is shifted by the number of names before it, so no task sees all of them.
    """
    rows = _page_rows(spark, folder)
    part = F.spark_partition_id()
    names = materialize(rows.select("file").repartitionByRange("file").sortWithinPartitions("file").select("file", part.alias("part"), F.monotonically_increasing_id().alias("m")), "page-names")
    sizes = names.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("low"))  # a row per range
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    order = names.join(F.broadcast(sizes.select("part", "low", before.alias("before"))), "part").select("file", (F.col("before") + F.col("m") - F.col("low")).alias("page_ord"))
    return rows.join(order, "file").select("page_id", "title", "content", "page_ord")


def read_page(spark: SparkSession, path: str) -> DataFrame:
    """A single page file, as ``read_pages`` would give it in a folder of its own."""
    return _page_rows(spark, path).select("page_id", "title", "content", F.lit(0).cast("bigint").alias("page_ord"))


def read_queries(spark: SparkSession, path: str, as_set: bool = False) -> DataFrame:
    """Labelled queries from a JSON array; ids as BIGINT. ``as_set`` drops repeated ids."""
    schema = "query_id string, query string, relevant_page_ids array<string>"
    ids = F.transform("relevant_page_ids", T.page_id)
    return spark.read.schema(schema).json(path, multiLine=True).select("query_id", "query", (F.array_distinct(ids) if as_set else ids).alias("relevant_page_ids"))


def write_report(report: DataFrame, path: str) -> None:
    """An error report as CSV with a header, in its order. One row per query: small enough for one file."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_queries(queries: DataFrame, path: str) -> None:
    """Labelled queries as JSON, ids as strings: one array in one file, which ``read_queries`` reads back.

    A labelled set is written by hand or sampled and small; its rows are gathered in one task in the order of their ids.
    """
    ids = F.transform("relevant_page_ids", lambda x: x.cast("string"))
    item = F.struct("query_id", "query", ids.alias("relevant_page_ids"))
    array = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.to_json(x))
    queries.agg(F.concat(F.lit("[\n  "), F.array_join(array, ",\n  "), F.lit("\n]")).alias("value")).write.mode("overwrite").text(path)


def chunk_blocks(chunks: DataFrame) -> DataFrame:
    """(page_id, chunk_id, value): each chunk as a readable block with its number and words."""
    block = F.format_string("### chunk %d  (%d words)\n%s", F.col("chunk_id"), F.col("word_count"), F.col("text"))
    return chunks.select("page_id", "chunk_id", block.alias("value"))


def write_chunk_dump(chunks: DataFrame, path: str) -> None:
    """The blocks of one page (or a few) as text, a blank line between them."""
    chunk_blocks(chunks).orderBy("page_id", "chunk_id").select(F.concat("value", F.lit("\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)

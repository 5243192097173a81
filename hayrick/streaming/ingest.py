"""Pages that arrive as files: a stream of new pages becomes chunk rows of a table, or batches of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hayrick.config import DEFAULT, Settings
from hayrick.operators import chunking, dense
from hayrick.plans import increments

PAGE = "page_id bigint, title string, content string, page_ord bigint"


def chunk_stream(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Chunks of a stream of pages. Chunking is stateless, so every micro-batch is final and nothing is kept."""
    return chunking.chunk_pages(pages, settings)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = DEFAULT) -> StreamingQuery:
    """Appends the chunks of every new Parquet file of pages in ``folder`` to ``out``, each file exactly once."""
    pages = spark.readStream.schema(PAGE).parquet(folder)
    return chunk_stream(pages, settings).withColumn("ingested_at", F.current_timestamp()).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_index(spark: SparkSession, folder: str, path: str, checkpoint: str, settings: Settings = DEFAULT, encoder: dense.Encoder | None = None) -> StreamingQuery:
    """Adds every new Parquet file of pages in ``folder`` to the growing index in ``path`` (``increments.load`` reads it).

    A micro-batch that is replayed after a failure has its old number and changes nothing if it was finished. Numbers
    come from ``checkpoint``, so an index has one checkpoint for good.
    """
    pages = spark.readStream.schema(PAGE).parquet(folder)
    add = lambda rows, batch: increments.add_pages(rows, path, batch, settings, encoder)
    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

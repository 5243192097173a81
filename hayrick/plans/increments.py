"""An index that grows by batches of pages, without a rebuild.

Every table has a folder per batch. Postings keep raw counts, so nothing in them changes when the collection grows:
document frequencies are summed, and IDF and mean length resolved, when the index is loaded. A batch counts once its row
of totals is written, which is last; what a lost job left before is not read, and is overwritten when the batch is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.config import DEFAULT, Settings
from hayrick.operators import chunking, dense, numfilter, sparse
from hayrick.plans.pipeline import Index
from hayrick.session import materialize, path_exists

KEYS = ["page_id", "chunk_id"]
COUNTS = "page_id bigint, chunk_id int, dl bigint, term string, freq bigint, batch bigint, bucket int"
TERMS = "term string, df bigint, batch bigint, bucket int"
TOTALS = "n bigint, tokens bigint, batch bigint"


def _totals(spark: SparkSession, path: str) -> dict[int, tuple[int, int]]:
    """Chunks and tokens of every finished batch (one short row each)."""
    if not path_exists(spark, f"{path}/totals"):
        return {}
    return {r["batch"]: (r["n"], r["tokens"]) for r in spark.read.schema(TOTALS).parquet(f"{path}/totals").collect()}


def _read(spark: SparkSession, path: str, name: str, batches: list[int], schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/{name}").where(F.col("batch").isin(batches)).drop("batch")


def add_pages(pages: DataFrame, path: str, batch: int, settings: Settings = DEFAULT, encoder: dense.Encoder | None = None) -> None:
    """Adds a batch of pages (page_id, title, content, page_ord) to the index in ``path``; see ``add_chunks``."""
    if batch not in _totals(pages.sparkSession, path):
        add_chunks(materialize(chunking.chunk_pages(pages, settings), "batch-chunks"), path, batch, encoder)


def add_chunks(chunks: DataFrame, path: str, batch: int, encoder: dense.Encoder | None = None, vectors: DataFrame | None = None) -> None:
    """Adds a batch of chunks, and either an encoder or their vectors (page_id, page_ord, embedding).

    Defined cases: a batch that was finished before changes nothing, whatever it holds; a page of an earlier batch is left
    out, so the first arrival stays; an empty batch is a batch without chunks. Either all batches have vectors or none has.
    """
    spark = chunks.sparkSession
    totals = _totals(spark, path)
    if batch in totals:
        return
    if totals:
        known = _read(spark, path, "pages", list(totals)).select("page_id")
        again = materialize(known.join(chunks.select("page_id").distinct(), "page_id", "left_semi"), "batch-again")
        chunks = chunks.join(again, "page_id", "left_anti")
        vectors = vectors.join(again, "page_id", "left_anti") if vectors is not None else None
    to = lambda name: f"{path}/{name}/batch={batch}"
    chunks.write.mode("overwrite").parquet(to("chunks"))
    chunks = spark.read.schema(chunks.schema).parquet(to("chunks"))
    counts = materialize(sparse.packed_counts(chunks, KEYS), "batch-counts")
    sparse.save_by_term(sparse.unpack(counts, KEYS), to("postings"))
    sparse.save_by_term(materialize(sparse.frequencies(counts), "batch-terms"), to("terms"))
    chunks.groupBy("page_id").agg(F.min("page_ord").alias("page_ord"), F.count(F.lit(1)).alias("n_chunks")).write.mode("overwrite").parquet(to("pages"))
    numfilter.page_numbers(chunks).write.mode("overwrite").parquet(to("numbers"))
    if encoder is not None:
        vectors = dense.embed(chunks.select(*KEYS, "page_ord", "text"), encoder)
    if vectors is not None:
        dense.pack(vectors).write.mode("overwrite").parquet(to("vectors"))
    tokens = counts.agg(F.sum("tokens")).first()[0] or 0
    spark.range(0, 1, 1, 1).select(F.lit(chunks.count()).cast("bigint").alias("n"), F.lit(tokens).cast("bigint").alias("tokens")).write.mode("overwrite").parquet(to("totals"))


def load(spark: SparkSession, path: str, settings: Settings = DEFAULT, with_vectors: bool = True) -> Index:
    """The index of all finished batches, equal to one that is built from all their pages at once.

    Terms and postings are read for the terms of the queries alone, as with ``Index.load``: the sums by term are
    grouped by the folder too, so a search's filter reaches the files of every batch.
    """
    totals = _totals(spark, path)
    if not totals:
        raise ValueError(f"no finished batch in {path}")
    batches = sorted(totals)
    n, tokens = (sum(x) for x in zip(*totals.values(), strict=True))
    df = _read(spark, path, "terms", batches, TERMS).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
    counts = _read(spark, path, "postings", batches, COUNTS)
    postings = sparse.weights(counts, tokens / n if n else 1.0, settings).select("bucket", "term", *KEYS, "tf_weight")
    vectors = _read(spark, path, "vectors", batches) if with_vectors and path_exists(spark, f"{path}/vectors") else None
    pages, chunks, numbers = (_read(spark, path, name, batches) for name in ("pages", "chunks", "numbers"))
    return Index(chunks, pages, sparse.with_idf(df, n), postings, numbers, vectors, settings)

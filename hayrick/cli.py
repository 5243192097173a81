"""Command line: ``python -m hayrick build|search|evaluate|dense|dump``. Each command is a few calls of the library."""

from __future__ import annotations

import argparse
import importlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.operators import chunking, dense, metrics
from hayrick.plans import pipeline
from hayrick.session import ship
from hayrick.sources import corpus


def _encoder(name: str | None) -> dense.Encoder | None:
    """``package.module:factory`` names a function that makes an encoder."""
    if name is None:
        return None
    module, factory = name.split(":")
    return getattr(importlib.import_module(module), factory)()


def _with_vectors(queries: DataFrame, encoder: dense.Encoder | None) -> DataFrame:
    return queries.withColumn("embedding", F.lit(None).cast("array<float>")) if encoder is None else dense.embed(queries, encoder, "query")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = corpus.read_pages(spark, a.pages)
    if a.subset:
        pages = pipeline.select_subset(pages, pipeline.relevant_pairs(corpus.read_queries(spark, a.queries)), a.subset)
    pipeline.build_index(pages, encoder=_encoder(a.encoder)).save(a.index)


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    encoder = _encoder(a.encoder)
    for ids in pipeline.run(pipeline.Index.load(spark, a.index, with_vectors=encoder is not None), a.query, encoder, a.top_k):
        print(*ids)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    encoder = _encoder(a.encoder)
    index = pipeline.Index.load(spark, a.index, with_vectors=encoder is not None)
    queries = _with_vectors(corpus.read_queries(spark, a.queries), encoder)
    start = time.time()
    pipeline.evaluate_run(queries, lambda q: pipeline.search(index, q), a.top_k).show(truncate=False)
    print(f"{time.time() - start:.1f} s")
    report = metrics.error_report(queries, pipeline.search(index, queries, 100), pipeline.relevant_pairs(queries), a.top_k)
    report.limit(10).show(truncate=60)
    if a.report:
        corpus.write_report(report, a.report)


def dense_ranking(spark: SparkSession, a: argparse.Namespace) -> None:
    asked = dense.embed(spark.createDataFrame(list(enumerate(a.query)), "query_id bigint, query string"), _encoder(a.encoder), "query")
    pipeline.dense_query(pipeline.Index.load(spark, a.index), asked, a.top_k).orderBy("query_id", "rank").select("query_id", "rank", "page_id", "score", "title").show(a.top_k * len(a.query), truncate=60)


def dump(spark: SparkSession, a: argparse.Namespace) -> None:
    corpus.write_chunk_dump(chunking.chunk_pages(corpus.read_page(spark, a.page)), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hayrick")
    commands = top.add_subparsers(required=True)
    for f, words in ((build, "pages index"), (search, "index +query"), (evaluate, "index queries"), (dense_ranking, "index +query"), (dump, "page out")):
        p = commands.add_parser({"dense_ranking": "dense"}.get(f.__name__, f.__name__))
        p.set_defaults(command=f)
        for w in words.split():
            p.add_argument(w.lstrip("+"), nargs="+" if w[0] == "+" else None)
        if f is not dump:
            p.add_argument("--encoder", required=f is dense_ranking)
        if f in (search, evaluate, dense_ranking):
            p.add_argument("-k", "--top-k", type=int, default=10)
        if f is build:
            p.add_argument("--subset", type=int)
            p.add_argument("--queries", help="labelled queries whose pages a subset keeps first")
        if f is evaluate:
            p.add_argument("--report")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("hayrick").getOrCreate()
    ship(spark)
    a.command(spark, a)

"""Chunking, ranking, filtering and metrics on hand-made fixtures, and files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from hayrick.config import Settings
from hayrick.operators import chunking, dense, metrics, numfilter, ranking
from hayrick.plans import pipeline
from hayrick.sources import corpus
from hayrick.streaming import ingest


def page(spark, content, title="T", page_id=1):
    return spark.createDataFrame([(page_id, title, content, page_id)], "page_id bigint, title string, content string, page_ord bigint")


def test_pack(spark):
    got = spark.range(1).select(chunking.pack(F.array(*map(F.lit, [50, 60, 20, 130, 10, 100, 15]))).alias("s")).first()["s"]
    assert got == [0, 0, 1, 2, 3, 3, 4]


def words(n, k):
    return "W" + " ".join([f"w{k}"] * n)[1:] + "."


def test_padding(spark):
    counts = [50, 60, 20, 130, 10, 100, 15]
    text = " ".join(words(n, k) for k, n in enumerate(counts))
    rows = chunking.chunk_pages(page(spark, text)).orderBy("chunk_id").collect()
    own = lambda r: [int(x) for x in dict.fromkeys(w.strip(".")[1:] for w in r["text"].removeprefix("[T] ").split())]
    assert [own(r) for r in rows] == [[0, 1, 2], [1, 2], [3], [3], [4, 5, 6], [5, 6]]
    assert [r["chunk_id"] for r in rows] == list(range(6))


def test_sections(spark):
    row = chunking.with_sentences(page(spark, "A b c was here. Early life.\n\nHe was born.\n\nCareer.\n\nHe was paid.")).first()
    assert [s["text"] for s in row["sents"]] == ["A b c was here.", "He was born.", "He was paid."]
    assert [s["sec"] for s in row["sents"]] == [0, 1, 2]
    assert row["names"] == ["", "Early life", "Career"]
    assert [s["forced"] for s in row["sents"]] == [False, True, True]


def test_title_is_in_text_only(spark):
    row = chunking.chunk_pages(page(spark, "It flew in 1969.", "Apollo 11")).first()
    assert row["text"] == "[Apollo 11] It flew in 1969."
    assert row["numbers"] == ["1969"]
    assert chunking.chunk_pages(page(spark, None, None)).count() == 0


@pytest.mark.parametrize(("alpha", "topn", "n_chunks", "expected"), [(0.0, 2, 3, 3.0), (0.25, 2, 3, 3.25), (0.0, 30, 3, 2.0)])
def test_roll_up_counts_zeros(spark, alpha, topn, n_chunks, expected):
    scored = spark.createDataFrame([(1, 5, 0, 4.0), (1, 5, 1, 2.0)], "query_id int, page_id bigint, chunk_id int, score double")
    pages = spark.createDataFrame([(5, 0, n_chunks)], "page_id bigint, page_ord bigint, n_chunks bigint")
    assert ranking.roll_up(scored, pages, alpha, topn).first()["score"] == expected


def listing(spark, pages):
    return spark.createDataFrame([(1, p, r) for r, p in enumerate(pages, 1)], "query_id int, page_id bigint, rank int")


@pytest.mark.parametrize(("a", "b", "expected"), [([10, 20], [20, 30], [20, 10, 30]), ([10, 20], [20, 10], [10, 20])])
def test_fusion(spark, a, b, expected):
    rows = ranking.fuse(listing(spark, a), listing(spark, b)).orderBy("rank").collect()
    assert [r["page_id"] for r in rows] == expected
    if expected[0] == 20:
        assert rows[0]["score"] == pytest.approx(1 / 30 + 1 / 29)


def test_zero_fill_in_page_order(spark):
    pages = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 2, 1)], "page_id bigint, page_ord bigint, n_chunks bigint")
    scored = spark.createDataFrame([(1, 2, 1, 0.5)], "query_id int, page_id bigint, page_ord bigint, score double")
    queries = spark.createDataFrame([(1,)], "query_id int")
    rows = ranking.rank(ranking.fill_zero(scored, queries, pages, 60), 60).orderBy("rank").collect()
    assert [r["page_id"] for r in rows] == [2, 1, 3]


@pytest.mark.parametrize(("query", "expected"), [("1987", [2]), ("1850", [1, 2, 3]), ("1700", [1, 2, 3]), ("none", [1, 2, 3])])
def test_number_filter(spark, query, expected):
    numbered = spark.createDataFrame([(2, 1, "1987"), (9, 8, "1850")], "page_id bigint, page_ord bigint, number string")
    queries = spark.createDataFrame([(1, query)], "query_id int, query string")
    fused = listing(spark, [1, 2, 3])
    rows = numfilter.prune(fused, numfilter.allowed_pages(queries, numbered)).orderBy("rank").collect()
    assert [r["page_id"] for r in rows] == expected
    assert [r["rank"] for r in rows] == list(range(1, len(expected) + 1))


@pytest.mark.parametrize(
    ("ranked", "relevant", "ndcg", "standard"),
    [([5, 7, 9], [7], 1.0, 0.63093), ([5, 7, 9], [9], 0.63093, 0.5), ([5, 7, 9], [], 0.0, 0.0), ([5, 5, 7], [7], 1.0, 0.5)],
)
def test_ndcg(spark, ranked, relevant, ndcg, standard):
    queries = spark.createDataFrame([(1,)], "query_id int")
    rel = spark.createDataFrame([(1, p) for p in relevant], "query_id int, page_id bigint")
    row = metrics.per_query(queries, listing(spark, ranked), rel).first()
    assert (row["ndcg"], row["ndcg_standard"]) == (pytest.approx(ndcg, abs=1e-5), pytest.approx(standard, abs=1e-5))


def test_page_files_are_ordered_as_strings(spark, tmp_path):
    for name in ("9", "10", "100"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"title": name, "content": "It was here."}))
    rows = corpus.read_pages(spark, str(tmp_path)).orderBy("page_ord").collect()
    assert [r["page_id"] for r in rows] == [10, 100, 9]


def test_index_round_trip_search_and_evaluation(spark, tmp_path):
    pages = spark.createDataFrame(
        [(1, "Cats", "Cats were seen in 1999.", 0), (2, "Dogs", "They said it was 2001 when dogs were running.", 1), (3, "Birds", "Birds were flying. Cats were watching.", 2)], "page_id bigint, title string, content string, page_ord bigint"
    )
    index = pipeline.build_index(pages)
    vectors = dense.hash_embed(index.chunks, ["page_id", "chunk_id", "page_ord"])
    index.vectors = vectors
    index.save(str(tmp_path / "index"))
    loaded = pipeline.Index.load(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([("a", "cats", [1, 3]), ("b", "dogs of 2001", [2])], "query_id string, query string, relevant_page_ids array<bigint>")
    asked = queries.join(dense.hash_embed(queries.withColumnRenamed("query", "text"), ["query_id"]), "query_id")
    found = {r["query_id"]: r["page_ids"] for r in pipeline.ranked_lists(pipeline.search(loaded, asked), asked).collect()}
    assert set(found["a"][:2]) == {1, 3}
    assert found["b"] == [2]
    means = pipeline.evaluate_run(asked, lambda q: pipeline.search(loaded, q)).first()
    assert means["mean_recall"] == 1.0
    assert means["n_queries"] == 2
    for mode in (Settings(filter_mode="pre"), Settings(include_dense=False), Settings(include_sparse=False), Settings(number_filter=False)):
        loaded.settings = mode
        assert pipeline.search(loaded, asked).count() > 0


def test_rank_pages_matches_plain_products(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 8)), rng.normal(size=(4, 8))
    chunks = spark.createDataFrame([(i % 12, i % 12, [float(x) for x in r]) for i, r in enumerate(v)], "page_id bigint, page_ord bigint, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id int, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["page_id"] for r in dense.rank_pages(chunks, asked, 6, alpha=0.25, topn=3).collect()}
    for i, r in enumerate(q):
        s = v @ r
        score = {p: 0.25 * max(s[p::12]) + 0.75 * np.mean(sorted(s[p::12])[-3:]) for p in range(12)}
        assert [got[i, k] for k in range(1, 7)] == sorted(score, key=lambda p: (-round(score[p], 6), p))[:6]


def test_streamed_pages_become_chunks_once(spark, tmp_path):
    page(spark, "It was here. It is gone.").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1

"""Sparse lists in blocks of pages against sums of shuffled hits."""

import random

import pytest
from pyspark.sql import functions as F

from hayrick.config import Settings
from hayrick.operators import blocks, bounded, numfilter, ranking, sparse
from hayrick.plans import pipeline
from hayrick.session import materialize

KEYS = ["page_id", "chunk_id"]


def made(spark, n_pages=120):
    """Pages of one to nine chunks, many of them equal; every seventh names a number."""
    dice = random.Random(3)
    rows = []
    for p in range(n_pages):
        for c in range(1 + p % 9):
            text = " ".join(f"w{min(int(dice.paretovariate(0.6)), 300)}" for _ in range(dice.randint(0, 12))) if p % 5 else "w1 w2 w3"
            rows.append((p * 3 - 100, c, -p, text, ["4"] if p % 7 == 0 else []))
    return materialize(spark.createDataFrame(rows, "page_id bigint, chunk_id int, page_ord bigint, text string, numbers array<string>"), "made")


def asked(spark):
    rows = [(1, "w1 w2 w40"), (2, "w9 w9 w300 and 4"), (3, ""), (4, None), (None, "w5 w6"), (6, "nowhere"), (7, "w12 w2"), (7, "w12 w4"), (8, "w1 w2 w3 w4 w5 w6 w7 of 4")]
    return spark.createDataFrame(rows, "query_id bigint, query string")


def plain(index, queries, allowed):
    s = index.settings
    scored = sparse.scores(queries, index.terms, index.postings, KEYS)
    zero = ranking.zero_pages(queries, index.pages, s.sparse_depth, allowed).select("query_id", "page_id", F.lit(0.0).alias("score"))
    rolled = ranking.roll_up(scored.drop("chunk_id").unionByName(zero), index.pages, s.sparse_alpha, s.sparse_topn)
    return ranking.rank(rolled if allowed is None else numfilter.keep_allowed(rolled, allowed), s.sparse_depth)


def rows(ranked):
    return sorted((str(r["query_id"]), r["rank"], r["page_id"], r["page_ord"], r["score"]) for r in ranked.collect())


@pytest.mark.parametrize("filtered", [False, True])
def test_lists_equal_sums_of_hits_and_no_hit_is_shuffled(spark, monkeypatch, filtered):
    settings = Settings(sparse_depth=5, sparse_topn=3)
    index = pipeline.index_chunks(made(spark), settings)
    allowed = materialize(numfilter.allowed_pages(asked(spark), index.numbers), "allowed") if filtered else None
    want = rows(plain(index, asked(spark), allowed))

    def no_hits(*_):
        raise AssertionError("hits are shuffled")

    monkeypatch.setattr(sparse, "hits", no_hits)
    assert rows(pipeline.sparse_leg(index, asked(spark), allowed)) == want
    # Small slices, and blocks that end within a page.
    for name, value in (("SLICE", 300), ("CELLS", 16), ("HITS", 20)):
        monkeypatch.setattr(blocks, name, value)
    assert rows(pipeline.sparse_leg(index, asked(spark), allowed)) == want


def test_blocks_in_this_process_end_within_a_page():
    """Chunk scores of one page that lie in several blocks meet, its best ones alone in the mean."""
    np = blocks.np
    parts = [(np.array([0, 0]), np.array([[1.0], [5.0]])), (np.array([0]), np.array([[4.0]])), (np.array([0, 2]), np.array([[2.0], [3.0]]))]
    got = [(p.tolist(), s.tolist()) for p, s in blocks._rolled(parts, np.array([9, 1, 4]), 0.25, 2)]
    assert got == [([0, 2], [[0.25 * 5 + 0.75 * 4.5], [0.25 * 3 + 0.75 * 1.5]])]


def test_many_queries_take_the_other_way(spark, monkeypatch):
    index = pipeline.index_chunks(made(spark), Settings(sparse_depth=5, sparse_topn=3))
    want = rows(pipeline.sparse_leg(index, asked(spark)))
    monkeypatch.setattr(blocks, "QUERIES", 2)
    assert rows(pipeline.sparse_leg(index, asked(spark))) == want


def test_terms_are_counted_without_a_shuffle_and_repeated_keys_add_up(spark):
    one = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "B b c")], "k int, text string")
    counts = sparse.term_counts(one, ["k"])
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    want = [(1, 3, "a", 2), (1, 3, "b", 1), (4, 3, "b", 2), (4, 3, "c", 1)]
    assert sorted(map(tuple, counts.collect())) == want
    twice = one.unionByName(one.where("k = 1")).unionByName(spark.createDataFrame([(1, "a")], "k int, text string"))
    assert sorted(map(tuple, sparse.term_counts(twice, ["k"]).collect())) == [(1, 1, "a", 1), (1, 3, "a", 4), (1, 3, "b", 2), *want[2:]]


def test_bounds_are_summed_in_blocks_too(spark, monkeypatch):
    settings = Settings(sparse_depth=3, sparse_topn=3)
    index = pipeline.index_chunks(made(spark, 40), settings)
    want = rows(pipeline.sparse_leg(index, asked(spark)))

    def no_hits(*_):
        raise AssertionError("hits are shuffled")

    monkeypatch.setattr(sparse, "hits", no_hits)
    index.peaks = bounded.page_peaks(index.postings, index.pages)
    assert rows(pipeline.sparse_leg(index, asked(spark))) == want

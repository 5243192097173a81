"""Counts packed by unit, postings packed by slice, and runs of passages found in the pages' rows."""

from pyspark.sql import functions as F

from hayrick.functions import text as T
from hayrick.operators import blocks, ranking, sparse
from hayrick.plans import pipeline
from test_blocks import asked, made, rows


def test_counts_are_written_a_row_for_each_unit_and_shuffled_a_row_for_each_slice(spark, monkeypatch):
    one = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "B Éb? c-c c_1"), (5, "?")], "k int, text string")
    packed = sparse.packed_counts(one, ["k"])
    assert sorted((r["k"], r["dl"], r["tokens"], r["terms"], r["freqs"]) for r in packed.collect()) == [(1, 3, 3, "a b", [2, 1]), (4, 5, 5, "b éb c c_1", [1, 1, 2, 1])]
    terms = one.select("k", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("k", "term").count()
    assert sorted(map(tuple, sparse.unpack(packed, ["k"]).select("k", "term", "freq").collect())) == sorted(map(tuple, terms.collect()))
    twice = sparse.packed_counts(one.unionByName(one), ["k"])
    assert sorted((r["k"], r["dl"], r["tokens"], sum(r["freqs"])) for r in twice.collect()) == [(1, 3, 6, 6), (4, 5, 10, 10)]
    monkeypatch.setattr(sparse, "ROWS", 1)
    assert sorted(map(tuple, sparse.frequencies(packed).collect())) == [("a", 1), ("b", 2), ("c", 1), ("c_1", 1), ("éb", 1)]
    monkeypatch.setattr(blocks, "PACK", 7)
    index = pipeline.index_chunks(made(spark, 40))
    batch = blocks.batch(sparse.ask(asked(spark), index.terms))
    ranked = blocks.best_pages(batch, index.postings, index.pages, 5, 0.25, 3)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow _by_slice" in plan
    want = ranking.roll_up(sparse.scores(asked(spark), index.terms, index.postings, ["page_id", "chunk_id"]), index.pages, 0.25, 3)
    assert rows(ranking.rank(ranked, 5)) == rows(ranking.rank(want, 5))


def test_runs_of_few_passages_are_looked_up_in_the_pages_rows(spark):
    """No run of a page is written, sorted or shuffled unless a passage has it."""
    pages = spark.createDataFrame([(1, "A b c, d e f g! A b c d e"), (2, "a b c d"), (3, None), (4, "x é y z z z z z")], "page_id int, text string")
    runs = spark.createDataFrame([("a b c d e",), ("é y z z z",), ("q q q q q",)], "run string")
    found = pipeline._with_runs(pages, runs)
    assert sorted((r["page_id"], r["run"]) for r in found.collect()) == [(1, "a b c d e"), (4, "é y z z z")]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_packed_counts_rank_as_their_postings_do(spark):
    """ASCII texts take a shorter way to the same terms, and counts are scored without a row for each posting."""
    texts = [(i, c) for i, c in enumerate(["A_b-C 12\x1c\x7f d", "É_b-C 12  d", "ÀÉ i̇ İ x", "", "?!", "one"])]
    units = spark.createDataFrame(texts, "page_id bigint, text string")
    want = {r["page_id"]: r["t"] for r in units.select("page_id", T.tokenize(F.col("text")).alias("t")).collect()}
    assert {r["page_id"]: T.spaced_terms(r["t"]) for r in units.select("page_id", T.spaced_tokens(F.col("text")).alias("t")).collect()} == want
    index = pipeline.index_chunks(made(spark, 40))
    batch = blocks.batch(sparse.ask(asked(spark), index.terms))
    packed = blocks.best_pages(batch, index.packed, index.pages, 5, 0.25, 3)
    assert "Generate" not in packed._jdf.queryExecution().optimizedPlan().toString()
    assert rows(ranking.rank(packed, 5)) == rows(ranking.rank(blocks.best_pages(batch, index.postings, index.pages, 5, 0.25, 3), 5))

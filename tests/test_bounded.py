"""Sparse lists by bounds against the plain way, and what they leave out."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from hayrick import session
from hayrick.config import Settings
from hayrick.operators import bounded, sparse
from hayrick.plans import pipeline
from hayrick.session import materialize

KEYS = ["page_id", "chunk_id"]


def made(spark, n_pages=300, seed=5):
    """Chunks of words of very different frequency; pages of one to four chunks, some of them equal."""
    dice = random.Random(seed)
    rows = []
    for p in range(n_pages):
        for c in range(1 + p % 4):
            n = dice.randint(0, 12)
            text = " ".join(f"w{min(int(dice.paretovariate(0.6)), 400)}" for _ in range(n)) if p % 7 else "w1 w2 w3"
            rows.append((p * 3 - 200, c, p, text))
    return materialize(spark.createDataFrame(rows, "page_id bigint, chunk_id int, page_ord bigint, text string").withColumn("numbers", F.array().cast("array<string>")), "made")


def asked(spark):
    rows = [(i, " ".join(f"w{k}" for k in ks)) for i, ks in enumerate([[1], [1, 2, 300], [40, 50, 1], [7, 7, 8, 9], [399], [1, 2, 3, 4, 5, 6], []])]
    rows += [(20, None), (21, "nowhere"), (22, "w3 w90"), (None, "w5 w60"), (23, "w12 w2"), (23, "w12 w4")]
    return spark.createDataFrame(rows, "query_id bigint, query string")


def lists(index, queries):
    return sorted((str(r["query_id"]), r["rank"], r["page_id"], r["score"]) for r in pipeline.sparse_leg(index, queries).collect())


@pytest.mark.parametrize(("depth", "alpha"), [(3, 0.25), (10, 1.0), (60, 0.0)])
def test_lists_equal_the_plain_way(spark, tmp_path, depth, alpha):
    settings = Settings(sparse_depth=depth, sparse_alpha=alpha, sparse_topn=2)
    index = pipeline.index_chunks(made(spark), settings)
    index.save(str(tmp_path / "index"), with_bounds=True)
    loaded = pipeline.Index.load(spark, str(tmp_path / "index"), settings, with_vectors=False, with_bounds=True)
    assert loaded.peaks is not None
    assert lists(loaded, asked(spark)) == lists(index, asked(spark))


def test_hits_are_left_out_before_they_are_summed(spark, monkeypatch):
    """Of all hits of a batch, those of the first and of the open pages alone reach the roll-up."""
    index = pipeline.index_chunks(made(spark, 600), Settings(sparse_depth=5))
    queries = asked(spark).where("query_id in (1, 2, 3, 22)")
    peaks = bounded.page_peaks(index.postings, index.pages)
    cuts = {}
    real = bounded.materialize
    monkeypatch.setattr(bounded, "materialize", lambda df, name: cuts.setdefault(name, real(df, name)))
    bounded.best_pages(queries, index.terms, index.postings, peaks, index.pages, 5, 0.25, 30)
    pairs = cuts["first-pairs"].unionByName(cuts["open-pairs"])
    assert pairs.count() == pairs.distinct().count()
    found = sparse.hits(sparse.ask(queries, index.terms), index.postings, KEYS)
    assert found.join(pairs, ["query_id", "page_id"], "left_semi").count() < found.count() * 0.3


def test_too_many_pairs_to_send_score_all_hits(spark):
    settings = Settings(sparse_depth=4)
    index = pipeline.index_chunks(made(spark), settings)
    peaks = bounded.page_peaks(index.postings, index.pages)
    best = bounded.best_pages(asked(spark), index.terms, index.postings, peaks, index.pages, 4, 0.25, 30, send=2)
    plain = sparse.scores(asked(spark), index.terms, index.postings, KEYS)
    assert best.count() == plain.select("query_id", "page_id").distinct().count()


def test_chunks_that_repeat_and_empty_tables(spark):
    rows = made(spark, 40)
    twice = rows.unionByName(rows.withColumn("text", F.concat("text", F.lit(" w9 w10"))))
    for chunks in (twice, rows.limit(0)):
        plain = pipeline.index_chunks(chunks, Settings(sparse_depth=3))
        bound = dataclasses.replace(plain, peaks=bounded.page_peaks(plain.postings, plain.pages))
        assert lists(bound, asked(spark)) == lists(plain, asked(spark))


def test_alpha_must_allow_bounds(spark):
    index = pipeline.index_chunks(made(spark, 10))
    with pytest.raises(ValueError, match="alpha"):
        bounded.best_pages(asked(spark), index.terms, index.postings, bounded.page_peaks(index.postings, index.pages), index.pages, 3, 1.5, 30)


def test_packed_peaks_are_no_less_and_nearly_equal(spark):
    rows = made(spark, 120)
    twice = materialize(rows.unionByName(rows.withColumn("text", F.concat("text", F.lit(" w9 w10")))), "made")
    for chunks, exact in ((materialize(rows.coalesce(1).sortWithinPartitions(*KEYS), "made"), True), (twice, False)):
        index = pipeline.index_chunks(chunks)
        want = {(r["term"], r["page_id"]): r for r in bounded.page_peaks(index.postings, index.pages).collect()}
        found = bounded.PagePeaks(bounded.packed_peaks(index.packed)).rows(index.pages)
        got = {(r["term"], r["page_id"]): r for r in found.groupBy("term", "page_id").agg(F.min("n_chunks").alias("n_chunks"), F.sum("peak").alias("peak"), F.sum("total").alias("total")).collect()}
        assert got.keys() == want.keys()
        for key, own in got.items():
            assert own["n_chunks"] == want[key]["n_chunks"]
            assert own["peak"] >= want[key]["peak"] - 1e-12 and own["total"] >= want[key]["total"] - 1e-12
            assert not exact or (own["peak"] < want[key]["peak"] * 1.000001 and own["total"] < want[key]["total"] * 1.000001)


def test_postings_saved_in_passes_and_chunks_written_once(spark, tmp_path, monkeypatch):
    """Several passes, parts and lists a term; the chunk table lies in the saved index alone, and nothing else is left of the build."""
    for name, n in (("PASS", 300), ("PART", 40), ("RUN", 3)):
        monkeypatch.setattr(sparse, name, n)
    pages = made(spark, 150).groupBy("page_id").agg(F.lit("").alias("title"), F.array_join(F.collect_list("text"), " ").alias("content"), F.min("page_ord").alias("page_ord"))
    plain = pipeline.build_index(pages)
    before = set(session._cuts)
    built = pipeline.build_index(pages, path=str(tmp_path / "index"))
    built.save(str(tmp_path / "index"), with_bounds=True)
    built.discard()
    assert not [x for x in session._cuts if x not in before and "asked" not in x]
    loaded = pipeline.Index.load(spark, str(tmp_path / "index"), with_vectors=False, with_bounds=True)
    key = lambda rows: sorted((r["term"], r["page_id"], r["chunk_id"], r["tf_weight"]) for r in rows.collect())
    assert key(loaded.postings) == key(plain.postings)
    words = asked(spark).where("query_id = 22").select(F.explode(F.split("query", " ")).alias("term"))
    assert key(sparse.of_terms(loaded.postings, words)) == key(plain.postings.where("term in ('w3', 'w90')"))
    lists_ = spark.read.parquet(str(tmp_path / "index" / "postings"))
    assert lists_.where(F.size("page_id") > 3).count() == 0 and lists_.where(F.col("shard") != sparse.shard_of(F.col("term"))).count() == 0
    assert lists(loaded, asked(spark)) == lists(plain, asked(spark))

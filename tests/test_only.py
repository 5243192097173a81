"""An index for one batch of queries holds their terms alone and answers as the whole index does."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hayrick.functions import text as T
from hayrick.operators import numfilter, sparse
from hayrick.plans import catalog, pipeline
from test_blocks import rows

SF = "/root/testdata/sf0.001"


def test_texts_are_cut_and_counted_together(spark, monkeypatch):
    texts = ["A b, a_1 é", "", "  ?! ", "ΣΣ µª b B", "b", "—À—b  a", "x y"] + [f"a{chr(c)}B {chr(c)}C{chr(c)}" for c in range(0, 400, 7) if not 0xD800 <= c < 0xE000]
    units = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    want = {}
    for r in units.select("k", T.tokenize(F.col("text")).alias("t")).collect():
        want[r["k"]] = (len(r["t"]), {x: r["t"].count(x) for x in r["t"]})
    whole = {k: v for k, v in want.items() if v[0]}
    of = lambda r: (r["dl"], dict(zip(r["terms"].split(" "), r["freqs"], strict=True)) if r["terms"] is not None else {})
    known = spark.createDataFrame([("b",), ("é",), ("σσ",), ("absent",)], "term string")
    for cut in (1, sparse.CUT):
        monkeypatch.setattr(sparse, "CUT", cut)
        assert {r["k"]: of(r) for r in sparse.packed_counts(units, ["k"]).collect()} == whole
        own = {k: (n, {x: f for x, f in terms.items() if x in ("b", "é", "σσ")}) for k, (n, terms) in whole.items()}
        assert {r["k"]: of(r) for r in sparse.packed_counts(units, ["k"], known=known).collect()} == own
        empty = {k: (n, {}) for k, (n, _) in whole.items()}
        assert {r["k"]: of(r) for r in sparse.packed_counts(units, ["k"], known=known.where("false")).collect()} == empty
    batch = pa.record_batch({"k": pa.array([1, 2]), "_t": pa.array(["", "?"])})
    assert [b.num_rows for b in sparse._packed(iter([batch]))] == [0]


def test_an_index_for_one_batch_ranks_as_the_whole_one(spark, monkeypatch):
    asked = catalog._asked_with_vectors(spark, SF).where("query_id < 20")
    whole, own = catalog._index(spark, SF), catalog._index(spark, SF, only=asked)
    asked_terms = sparse.query_terms(asked).select("term").distinct().count()
    assert 0 < own.terms.count() <= asked_terms < whole.terms.count()
    assert own.packed.counts.agg(F.sum("tokens")).first() == whole.packed.counts.agg(F.sum("tokens")).first()
    assert own.postings.count() == whole.postings.join(own.terms.select("term"), "term", "left_semi").count()
    want = rows(pipeline.sparse_leg(whole, asked))
    assert want and rows(pipeline.sparse_leg(own, asked)) == want
    with pytest.raises(ValueError, match="other queries"):
        pipeline.sparse_leg(own, asked.withColumn("query", F.lit("zzz")))
    with pytest.raises(ValueError, match="one batch"):
        own.save("/tmp/none")
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", 1)
    assert catalog._index(spark, SF, only=asked).only is None


def test_texts_are_searched_for_numbers_only_under_queries_that_name_one(spark, monkeypatch):
    asked = catalog._asked_with_vectors(spark, SF).where("query_id < 3")
    plain = asked.withColumn("query", F.regexp_replace("query", "[0-9]", ""))
    one = plain.withColumn("query", F.when(F.col("query_id") == 1, F.concat(F.lit("of 1 and 2 "), "query")).otherwise(F.col("query")))
    seen = []
    monkeypatch.setattr(numfilter, "page_numbers", lambda r, own=numfilter.page_numbers: seen.append(r) or own(r))
    for queries, listed in ((plain, False), (one, True)):
        index = catalog._index(spark, SF, only=queries)
        assert "numbers" not in index.chunks.columns
        seen.clear()
        found = sorted(map(tuple, pipeline.search(index, queries).collect()))
        assert (seen[0].count() > 0) == listed and seen[0].count() <= 160
        assert found == sorted(map(tuple, pipeline.search(catalog._index(spark, SF), queries).collect()))

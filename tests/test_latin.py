"""An index reads texts where they lie, cuts Latin-1 texts in their task and counts terms in Arrow."""

import pyarrow as pa
from pyspark.sql import functions as F

from hayrick import session
from hayrick.functions import text as T
from hayrick.operators import sparse
from hayrick.plans import catalog

SF = "/root/testdata/sf0.001"


def test_latin_1_texts_go_to_the_task_as_they_are(spark):
    """Every character up to U+00FF, between and beside letters, and texts that hold others too."""
    texts = [f"a{chr(c)}B {chr(c)}C{chr(c)} {chr(c)}" for c in range(256)] + ["İÉ x²", "ΣΣ µª", "—À—b", "Ÿÿ", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = rows.select("k", "text", T.tokenize(F.col("text")).alias("want"), T.spaced_tokens(F.col("text")).alias("sent")).collect()
    assert {r["k"]: T.spaced_terms(r["sent"]) for r in got} == {r["k"]: r["want"] for r in got}
    assert all(r["sent"] == r["text"] for r in got if r["k"] < 256)


def test_units_with_a_term_are_counted_over_batches(monkeypatch):
    batch = lambda *rows: pa.record_batch({"terms": pa.array(rows, pa.string())})
    batches = [batch("a b", "b"), batch(), batch("c a"), batch("é")]
    for rows, parts in ((100, 1), (1, 3)):
        monkeypatch.setattr(sparse, "ROWS", rows)
        found = [(x["term"], x["df"]) for b in sparse._summed(iter(batches)) for x in b.to_pylist()]
        total = {t: sum(n for x, n in found if x == t) for t, _ in found}
        assert total == {"a": 2, "b": 2, "c": 1, "é": 1} and len(found) == (4 if parts == 1 else 5)
    assert list(sparse._summed(iter([]))) == []


def test_an_index_of_documents_writes_no_copy_of_their_texts(spark):
    before = len(session._cuts)
    index = catalog._index(spark, SF)
    made = [path.rpartition("/")[2] for path in session._cuts[before:]]
    assert made and not any(name.startswith("units") for name in made)
    assert index.pages.count() == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()

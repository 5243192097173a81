"""Hashed vectors are summed where a text's terms lie."""

from hayrick.operators import dense


def test_hashed_vectors_shuffle_one_row_a_text(spark, monkeypatch):
    texts = spark.createDataFrame([(i, " ".join(f"t{i * j % 17}" for j in range(i)) or None) for i in range(12)] + [(5, "again t3")], "k int, text string")
    of = lambda df: {r["k"]: [round(x, 9) for x in r["embedding"]] for r in df.collect()}
    sums = dense.hash_embed(texts, ["k"])
    assert sums._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(k") <= 2  # one for the key that repeats
    got = of(sums)
    monkeypatch.setattr(dense, "SUMS", 0)
    assert got == of(dense.hash_embed(texts, ["k"])) and len(got) == 11

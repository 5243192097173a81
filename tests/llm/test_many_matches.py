"""Texts of very many matches, and columns named like the operators' own helpers."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hayrick.llm import pii, stages

HELPERS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _row bigint, _spans string, _text string, _copies bigint, _copy bigint, row bigint, n bigint, spans bigint, copies bigint"


def test_spans_beside_others_equal_brute_force(spark):
    r = random.Random(5)
    rows = []
    for _ in range(200):
        make = lambda n: [(a, a + r.randrange(1, 6), "", "", "") for a in r.sample(range(30), n)]
        rows.append((sorted(make(r.randrange(8))), make(r.randrange(8))))
    kind = pii._SPANS
    got = spark.createDataFrame(rows, f"s {kind}, o {kind}").select("s", "o", pii._beside(F.col("s"), F.col("o"), pii._apart).alias("apart"), pii._beside(F.col("s"), F.col("o"), pii._not_within).alias("out")).collect()
    for x in got:
        assert x["apart"] == [s for s in x["s"] if not any(o["start"] < s["end"] and s["start"] < o["end"] for o in x["o"])]
        assert x["out"] == [s for s in x["s"] if not any(o["start"] <= s["start"] and s["end"] <= o["end"] for o in x["o"])]


@pytest.mark.parametrize(("piece", "kind"), [("4111 1111 1111 1111, a{i}b ", "card"), ("a{i}@b.de ", "email"), ("{i}55512{i} ", None)])
def test_time_follows_the_number_of_matches(spark, piece, kind):
    def run(n):
        text = "".join(piece.format(i=i) for i in range(n))
        began = time.time()
        rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        clean = pii.redact(rows).first()["text"]
        assert kind is None or clean.count(f"[{kind.upper()}]") == n
        return time.time() - began

    run(50)
    few, many = run(2_000), run(20_000)
    assert many < 20 * few + 20


def test_columns_of_any_name_come_back(spark):
    rows = [(i, f"mail me{i}@x.org about the house number {i} in the old street of the town", "en", "s", i, 700 + i, "s", "t", 3, 4, 5, 6, 7, 8) for i in range(6)]
    rows += [(7, "plain words without anything to find stand here in a row of words", "en", "s", 7, 707, "s", "t", 3, 4, 5, 6, 7, 8)]
    for more in ([], [rows[0]], [(None, *rows[1][1:])]):
        docs = spark.createDataFrame(rows + more, HELPERS)
        known = {tuple(x[2:]) for x in rows}
        for stage in (stages.keep_one_of_each_group, stages.hide_private, stages.take_mix):
            out = stage(docs)
            found = out.collect()
            assert out.columns == docs.columns and found
            assert {tuple(x)[2:] for x in found} <= known
        assert not [x for x in stages.hide_private(docs).collect() if "@" in x["text"]]

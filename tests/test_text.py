"""Text functions on hand-made fixtures with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from hayrick.functions import headers as H
from hayrick.functions import text as T


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokenize(spark):
    assert one(spark, T.tokenize, "Hello, WORLD! it's a_b naïve") == ["hello", "world", "it", "s", "a_b", "naïve"]
    assert one(spark, T.tokenize, "") == []


def test_numbers(spark):
    assert one(spark, T.numbers, "1,456,779 people 1820s 007 C3PO 19th") == ["1", "7", "456", "779"]
    assert one(spark, T.numbers, "0 00 " + "9" * 60) == ["0", "9" * 60]


@pytest.mark.parametrize(("text", "years"), [("finals in the 1820s", range(1820, 1830)), ("mid-2000s", range(2000, 2010)), ("80s", []), ("1820S", [])])
def test_query_numbers(spark, text, years):
    assert one(spark, T.query_numbers, text) == [str(y) for y in years]


def test_sentences(spark):
    got = one(spark, T.sentences, 'It won. "Great" he said. (Aside) x. next. D. Smith ran!')
    assert got == ["It won.", '"Great" he said.', "(Aside) x. next.", "D.", "Smith ran!"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("Early life.", True), ("South Korea.", True), ("Awards and honors.", True), ("World War I.", True), ("It was formed.", False), ("This worried Drs.", False), ("D.", False), ("early life.", False), ("Early life?", False)],
)
def test_is_header(spark, text, expected):
    assert one(spark, H.is_header, text) is expected


@pytest.mark.parametrize(("n", "starts"), [(120, [0]), (121, [0, 1]), (200, [0, 80]), (280, [0, 80, 160]), (300, [0, 80, 160, 180])])
def test_sliding_split(spark, n, starts):
    pieces = one(spark, T.sliding_split, " ".join(map(str, range(n))))
    assert [int(p.split()[0]) for p in pieces] == starts
    assert all(len(p.split()) == min(n, 120) for p in pieces)


def test_clean_title(spark):
    assert one(spark, T.clean_title, "Amazon_rain-forest  (Río)") == "amazon rainforest ro"


def test_page_id(spark):
    assert [one(spark, T.page_id, x) for x in ("12", " 12 ")] == [12, 12]
    for bad in ("-5", "1.5", "", None):
        with pytest.raises(Exception, match="Invalid page_id"):
            one(spark, T.page_id, bad)

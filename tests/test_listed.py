"""After fusion the number filter takes the numbers of listed pages alone."""

from hayrick.operators import numfilter, sparse
from hayrick.plans import catalog, pipeline

SF = "/root/testdata/sf0.001"


def test_numbers_are_those_of_listed_pages(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1, ["7", "8"]), (2, 2, []), (3, 3, None), (4, 4, ["7"])], "page_id int, page_ord int, numbers array<string>")
    listed = spark.createDataFrame([(0, 1), (1, 1), (1, 2), (1, None), (1, 9)], "query_id int, page_id int")
    of = lambda r: sorted(map(tuple, numfilter.page_numbers(r).collect()))
    assert of(rows) == [(1, 1, "7"), (1, 1, "8"), (4, 4, "7")]
    few = numfilter.of_listed(rows, listed, 10)
    assert of(few) == [(1, 1, "7"), (1, 1, "8")] and of(numfilter.of_listed(rows, listed, 1)) == of(rows)
    index, asked = catalog._index(spark, SF), catalog._numbered(catalog._asked_with_vectors(spark, SF).where("query_id = 0"))
    seen = []
    monkeypatch.setattr(numfilter, "page_numbers", lambda r, own=numfilter.page_numbers: seen.append(r) or own(r))
    some = sorted(map(tuple, pipeline.search(index, asked).collect()))
    assert len(seen) == 1 and seen[0].count() < index.pages.count()
    monkeypatch.setattr(sparse, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, pipeline.search(index, asked).collect())) == some and some

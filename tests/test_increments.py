"""An index that grows by batches gives what one build gives."""

import pytest
from pyspark.sql import functions as F

from hayrick.plans import increments, pipeline
from hayrick.streaming import ingest

TOPICS = ["engines and rockets", "rivers of 1969", "songs, songs and 12 dances", "old rockets on rivers", "", None]
QUERIES = [(1, "rockets on rivers"), (2, "songs of 1969"), (3, "nothing known"), (4, None)]


def pages(spark, some):
    rows = [(i, f"T{i % 4}", TOPICS[i % 6] and f"The {TOPICS[i % 6]} number {i}. " * (1 + i % 3), i) for i in some]
    return spark.createDataFrame(rows, "page_id bigint, title string, content string, page_ord bigint")


def found(index, spark):
    asked = spark.createDataFrame(QUERIES, "query_id bigint, query string")
    rows = pipeline.search(index, asked).select("query_id", "page_id", "rank", F.round("score", 6)).collect()
    return sorted(tuple(r) for r in rows)


def whole(spark, some=range(40)):
    return found(pipeline.build_index(pages(spark, some)), spark)


def test_three_batches_equal_one_build_and_a_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    for batch, some in enumerate([range(15), range(15, 16), range(16, 40)]):
        increments.add_pages(pages(spark, some), path, batch)
    want = whole(spark)
    assert found(increments.load(spark, path), spark) == want
    increments.add_pages(pages(spark, range(15, 16)), path, 1)
    increments.add_pages(pages(spark, range(50, 60)), path, 2)  # a finished batch stays, whatever comes under its number
    assert found(increments.load(spark, path), spark) == want


def test_pages_of_an_earlier_batch_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "index")
    increments.add_pages(pages(spark, range(20)), path, 0)
    changed = pages(spark, range(10, 20)).withColumn("content", F.lit("Rockets, rockets."))
    increments.add_pages(changed.unionByName(pages(spark, range(20, 40))), path, 1)
    assert found(increments.load(spark, path), spark) == whole(spark)


def test_an_unfinished_batch_is_not_read_and_may_be_run_again(spark, tmp_path):
    path = tmp_path / "index"
    increments.add_pages(pages(spark, range(20)), str(path), 0)
    increments.add_pages(pages(spark, range(30, 40)), str(path), 1)
    (path / "totals" / "batch=1").rename(tmp_path / "lost")
    assert found(increments.load(spark, str(path)), spark) == whole(spark, range(20))
    increments.add_pages(pages(spark, range(20, 40)), str(path), 1)
    assert found(increments.load(spark, str(path)), spark) == whole(spark)


def test_empty_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(ValueError, match="no finished batch"):
        increments.load(spark, path)
    increments.add_pages(pages(spark, range(1)).limit(0), path, 0)
    assert found(increments.load(spark, path), spark) == []
    increments.add_pages(pages(spark, range(40)), path, 1)
    assert found(increments.load(spark, path), spark) == whole(spark)


def test_only_folders_of_asked_terms_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    for batch in range(2):
        increments.add_pages(pages(spark, range(20 * batch, 20 * batch + 20)), path, batch)
    from hayrick.operators import sparse

    index = increments.load(spark, path)
    for rows in (index.terms, index.postings):
        plan = sparse.of_terms(rows, spark.createDataFrame([("rockets",)], "term string"))._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "EqualTo(term,rockets)" in plan


def test_stream_fills_the_index_and_goes_on(spark, tmp_path):
    into, path, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    for some in (range(25), range(25, 40)):
        pages(spark, some).write.mode("append").parquet(into)
        ingest.ingest_index(spark, into, path, state).awaitTermination()
    ingest.ingest_index(spark, into, path, state).awaitTermination()
    assert found(increments.load(spark, path), spark) == whole(spark)

"""The driver contract, and the queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from hayrick.plans import catalog

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(5)
    return sorted(tuple(None if v is None or v != v else v for v in r) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["tokenize_terms", "bm25_topk", "numbers_per_doc", "header_peel", "chunks_padded", "page_rollup_dense", "hybrid_search", "mean_metrics", "stratified_sample"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)

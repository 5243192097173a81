"""Plans, packed vectors, salted scores, files in and out, entry points and checks, on small fixtures."""

import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from hayrick import cli, session
from hayrick.operators import chunking, dense, metrics, numfilter, ranking, sparse
from hayrick.plans import pipeline
from hayrick.sources import corpus


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import a test file


class Letters:
    """An encoder: shares of the letters a to h."""

    width = 8

    def encode(self, texts):
        counts = np.array([[t.lower().count(c) for c in "abcdefgh"] for t in texts], float).reshape(len(texts), 8)
        return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-9)


def letters():
    return Letters()


PAGES = [(1, "Cats", "A bad cab had a gag in 1999. It ran.", 0), (2, "Dogs", "Each deed fed a beech. He was here in 2001.", 1), (3, "Birds", "Gee, high hedges were made.\n\nHe had a bag.", 2), (4, None, None, 3)]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, title string, content string, page_ord bigint")


def test_chunks_are_made_by_one_evaluation(spark):
    plan = chunking.chunk_pages(pages(spark))._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert plan.count("aggregate(") == 4  # two folds, each over blocks
    rows = chunking.with_segments(pages(spark)).select(F.posexplode_outer("segments").alias("i", "s")).where("i is not null")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 4  # noqa: SLF001


def test_scan_gathers_over_many_blocks(spark):
    values = F.sequence(F.lit(1), F.lit(1000))
    got = spark.range(1).select(chunking.scan(values, F.lit(0), lambda s, x: (s + x, s), "int").alias("a"), chunking.scan(F.array().cast("array<int>"), F.lit(0), lambda s, x: (s, x), "int").alias("b")).first()
    assert got["a"] == [i * (i - 1) // 2 for i in range(1, 1001)] and got["b"] == []


def plain_ranking(vectors, queries, alpha, topn, allowed=None):
    out = {}
    for q, x in queries.items():
        score = {}
        for p, chunks in vectors.items():
            if allowed is None or q not in {a for a, _ in allowed} or (q, p) in allowed:
                s = sorted((float(np.dot(x, c)) for c in chunks), reverse=True)
                score[p] = round(alpha * s[0] + (1 - alpha) * sum(s[:topn]) / min(topn, len(s)), 6)
        out[q] = sorted(score, key=lambda p: (-score[p], p))
    return out


@pytest.mark.parametrize("alpha", [0.0, 0.25])
def test_wide_pages_filters_and_nulls(spark, monkeypatch, alpha):
    monkeypatch.setattr(dense, "PAGE_ROWS", 4)
    monkeypatch.setattr(dense, "CHUNKS", 8)
    monkeypatch.setattr(dense, "QUERIES", 2)
    rng = np.random.default_rng(3)
    vectors = {p: rng.normal(size=(n, 5)) for p, n in enumerate([1, 3, 4, 5, 11, 2, 1])}
    rows = [(p, p, [float(x) for x in v]) for p, vs in vectors.items() for v in vs] + [(99, 99, None), (3, 3, None)]
    chunks = spark.createDataFrame(rows, "page_id bigint, page_ord bigint, embedding array<double>").repartition(3)
    queries = {i: rng.normal(size=5) for i in range(5)}
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries.items()] + [(9, None)], "query_id int, embedding array<double>")
    allowed = {(1, 4), (1, 0), (3, 2), (3, 55)}
    limits = spark.createDataFrame(sorted(allowed), "query_id int, page_id bigint")
    for some, only in ((None, None), (limits, allowed)):
        got = {}
        for r in dense.rank_pages(dense.pack(chunks), asked, 4, alpha=alpha, topn=3, allowed=some).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["page_id"])
        want = plain_ranking(vectors, queries, alpha, 3, only)
        assert got == {q: w[:4] for q, w in want.items()}
    assert dense.rank_pages(chunks, asked.where("query_id > 50"), 4).count() == 0
    for bad in ([1.0, 2.0], [1.0, None, 1.0, 1.0, 1.0]):
        with pytest.raises(Exception, match="chunk vector"):
            dense.rank_pages(spark.createDataFrame([(1, 1, bad)], chunks.schema), asked, 4).collect()


def test_salted_scores_equal_broadcast_ones(spark):
    units = spark.createDataFrame([(i, 0, "common " * (1 + i % 3) + f"w{i % 7}") for i in range(60)] + [(60, 0, None), (61, 0, "")], "page_id bigint, chunk_id int, text string")
    terms, postings = sparse.build(units, ["page_id", "chunk_id"])
    queries = spark.createDataFrame([(1, "common common w3"), (2, "w5 nothing"), (3, None), (4, "")], "query_id int, query string")
    few, many = ({(r["query_id"], r["page_id"]): round(r["score"], 9) for r in sparse.scores(queries, terms, postings, ["page_id", "chunk_id"], broadcast_rows=n).collect()} for n in (1000, 0))
    assert few == many and {q for q, _ in few} == {1, 2}
    stats = sparse.length_stats(units).first()
    assert stats["n"] == 62 and terms.count() == 8


def test_passages_of_any_length(spark):
    texts = ["one two three four five six seven eight nine", "xone two three four five six sevenx", "a short one", None, "", "punctuation: two! three? four, five; six."]
    docs = spark.createDataFrame(list(enumerate(texts)), "page_id bigint, text string")
    passages = ["one two three four five six seven", "two three four five", "ne two three four five six seve", "short", "", None, "two! three? four,", "?", "five six seven eight nine ten eleven"]
    asked = spark.createDataFrame(list(enumerate(passages)), "query_id bigint, passage string")
    got = {(r["query_id"], r["page_id"]) for r in pipeline.pages_with_passages(asked, docs).collect()}
    assert got == {(q, p) for q, x in enumerate(passages) for p, t in enumerate(texts) if x is not None and t is not None and x in t}


def test_zero_pages_join_the_roll_up(spark):
    queries = spark.createDataFrame([(1, "w1"), (2, "none")], "query_id int, query string")
    chunks = spark.createDataFrame([(p, c, f"w{p} x" if c == 0 else "y", p, ["5"] if p == 2 else []) for p in range(4) for c in range(2)], "page_id bigint, chunk_id int, text string, page_ord bigint, numbers array<string>")
    index = pipeline.index_chunks(chunks)
    rows = {(r["query_id"], r["rank"]): (r["page_id"], r["score"]) for r in pipeline.sparse_leg(index, queries).collect()}
    assert [rows[1, k][0] for k in range(1, 5)] == [1, 0, 2, 3] and rows[1, 1][1] > 0 and rows[1, 2][1] == 0
    assert [rows[2, k] for k in range(1, 5)] == [(p, 0.0) for p in range(4)]
    allowed = spark.createDataFrame([(1, 3, 3), (1, 2, 2)], "query_id int, page_id bigint, page_ord bigint")
    rows = {(r["query_id"], r["rank"]): r["page_id"] for r in pipeline.sparse_leg(index, queries, allowed).collect()}
    assert [rows.get((1, k)) for k in range(1, 4)] == [2, 3, None] and rows[2, 1] == 0
    none = ranking.roll_up(spark.createDataFrame([], "query_id int, page_id bigint, score double"), index.pages, 0.25, 30)
    assert ranking.fill_zero(none, queries, index.pages, 2).count() == 4


def test_recall_at_depths(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = spark.createDataFrame([(1, p, r) for r, p in enumerate([5, 5, 7, 9], 1)], "query_id int, page_id bigint, rank int")
    relevant = spark.createDataFrame([(1, 9), (1, 5), (1, 8), (1, 5)], "query_id int, page_id bigint")
    got = {(r["query_id"], r["k"]): r["recall"] for r in metrics.recall_at(queries, ranked, relevant, (1, 2, 3)).collect()}
    assert got == {(1, 1): 0.333333, (1, 2): 0.333333, (1, 3): 0.666667, (2, 1): 0.0, (2, 2): 0.0, (2, 3): 0.0}


def test_labelled_queries_go_out_and_in(spark, tmp_path):
    rows = [("q2", "what is \"that\"?", [3, 3, 12]), ("q1", "é\nline", [7]), ("q3", "none", [])]
    queries = spark.createDataFrame(rows, "query_id string, query string, relevant_page_ids array<bigint>")
    corpus.write_queries(queries, str(tmp_path / "set"))
    (file,) = (tmp_path / "set").glob("*.txt")
    assert [x["relevant_page_ids"] for x in json.loads(file.read_text())] == [["7"], ["3", "3", "12"], []]
    back = {r["query_id"]: r for r in corpus.read_queries(spark, str(file)).collect()}
    assert {k: (r["query"], r["relevant_page_ids"]) for k, r in back.items()} == {q: (t, ids) for q, t, ids in rows}
    assert {r["query_id"]: r["relevant_page_ids"] for r in corpus.read_queries(spark, str(file), as_set=True).collect()}["q2"] == [3, 12]
    assert sorted((r["query_id"], r["page_id"]) for r in pipeline.relevant_pairs(corpus.read_queries(spark, str(file))).collect()) == [("q1", 7), ("q2", 3), ("q2", 12)]


def test_reports_and_dumps(spark, tmp_path):
    report = spark.createDataFrame([(1, "a, b", 0.5), (2, "c", 1.0)], "query_id int, query string, ndcg double")
    corpus.write_report(report, str(tmp_path / "report"))
    (file,) = (tmp_path / "report").glob("*.csv")
    assert file.read_text().splitlines() == ["query_id,query,ndcg", '1,"a, b",0.5', "2,c,1.0"]
    corpus.write_chunk_dump(chunking.chunk_pages(pages(spark).where("page_id = 1")), str(tmp_path / "dump"))
    (file,) = (tmp_path / "dump").glob("*.txt")
    assert file.read_text().startswith("### chunk 0  (11 words)\n[Cats] A bad cab")
    (tmp_path / "12.json").write_text(json.dumps({"title": "T", "content": None}))
    assert tuple(corpus.read_page(spark, str(tmp_path / "12.json")).first()) == (12, "T", "", 0)


def test_encoder_index_run_and_checks(spark, tmp_path):
    index = pipeline.build_index(pages(spark), encoder=Letters())
    index.save(str(tmp_path / "index"))
    loaded = pipeline.Index.load(spark, str(tmp_path / "index"))
    assert loaded.vectors.columns == ["page_id", "part", "parts", "page_ord", "n", "v"]
    got = pipeline.run(loaded, ["a bad cab", "high hedges", "deed of 2001"], Letters())
    assert [x[0] for x in got] == [1, 3, 2] and got[2] == [2] and all(len(set(x)) == len(x) for x in got)
    assert pipeline.run(loaded, []) == [] and pipeline.run(loaded, ["beech"])[0][0] == 2
    asked = dense.embed(spark.createDataFrame([(1, "hedge"), (2, None)], "query_id int, query string"), Letters(), "query", batch=1)
    titled = pipeline.dense_query(loaded, asked, 2).where("query_id = 1").orderBy("rank").collect()
    assert (titled[0]["page_id"], titled[0]["title"]) == (3, "Birds")
    assert pipeline.check_index(loaded, 8) == []
    assert any("wrong_width" in x for x in pipeline.check_index(loaded, 9)) and pipeline.check_index(loaded, 8, "double")[0] == "vectors hold float, not double"
    assert "chunks hold less" in " ".join(pipeline.check_index(loaded, 8, least_bytes=1 << 30))
    assert pipeline.check_results(got, 3, least=1) == []
    assert len(pipeline.check_results([[1, 1], ["x"] * 10, [1]], 2)) == 6


def test_small_groups_can_fail_a_sample(spark):
    rows = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1), (None, 2)], "g string, q int")
    assert pipeline.stratified_sample(rows, "g", "q").count() == 7
    with pytest.raises(Exception, match="too few rows in group"):
        pipeline.stratified_sample(rows, "g", "q", strict=True).collect()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "pages").mkdir()
    for i, title, content, _ in PAGES[:3]:
        (tmp_path / "pages" / f"{i}.json").write_text(json.dumps({"title": title, "content": content}))
    (tmp_path / "q.json").write_text(json.dumps([{"query_id": "a", "query": "a bad cab", "relevant_page_ids": ["1"]}, {"query_id": "b", "query": "beech", "relevant_page_ids": [2]}]))
    at, index, q = str(tmp_path / "pages"), str(tmp_path / "index"), str(tmp_path / "q.json")
    cli.main(["build", at, index, "--encoder", "test_engine:letters", "--subset", "3", "--queries", q])
    cli.main(["search", index, "a bad cab", "high hedges", "-k", "1", "--encoder", "test_engine:letters"])
    assert capsys.readouterr().out.split() == ["1", "3"]
    cli.main(["evaluate", index, q, "--report", str(tmp_path / "report")])
    assert "mean_recall" in capsys.readouterr().out and list((tmp_path / "report").glob("*.csv"))
    cli.main(["dense", index, "deed", "--encoder", "test_engine:letters", "-k", "2"])
    assert "Dogs" in capsys.readouterr().out
    cli.main(["dump", str(tmp_path / "pages" / "1.json"), str(tmp_path / "dump")])
    assert list((tmp_path / "dump").glob("*.txt"))


def test_cuts_are_removed_and_a_cluster_needs_a_shared_folder(spark, tmp_path):
    with session.temporary_cuts(spark):
        made = session.materialize(spark.range(5), "gone")
        assert made.count() == 5
        (file, *_) = made.inputFiles()
    with pytest.raises(Exception, match="does not exist|not found|FILE_NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(file).count()

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster)


def test_small_tables_are_dealt_out(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert session.spread(table).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert session.size_in_bytes(table) < 10_000


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_a_saved_index_is_read_for_the_terms_of_the_queries(spark, tmp_path):
    rows = [(i, f"word{i} common other{i % 7}") for i in range(300)]
    units = spark.createDataFrame(rows, "page_id bigint, text string").withColumn("chunk_id", F.lit(0))
    terms, postings = sparse.build(units, ["page_id", "chunk_id"])
    for name, part in (("terms", terms), ("postings", postings)):
        sparse.save_by_term(part, f"file://{tmp_path}/{name}")
    saved = [spark.read.parquet(f"file://{tmp_path}/{name}") for name in ("terms", "postings")]
    queries = spark.createDataFrame([(1, "word5 word6"), (2, "other3 nowhere"), (3, None)], "query_id int, query string")
    asked = sparse.query_terms(queries)
    pruned = sparse.of_terms(saved[1], asked)
    plan = plan_of(pruned)
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan and "In(term" in plan
    assert pruned.count() == 2 + sum(i % 7 == 3 for i in range(300))  # the postings of the four terms, and of none else
    assert len(pruned.inputFiles()) <= len(saved[1].inputFiles())
    keys = ["page_id", "chunk_id"]
    got = [sorted((r["query_id"], r["page_id"], round(r["score"], 9)) for r in sparse.scores(queries, *x, keys).collect()) for x in ((terms, postings), saved)]
    assert got[0] == got[1] and len(got[0]) == pruned.count()
    many = sparse.scores(queries, *saved, keys, broadcast_rows=0)
    assert sorted((r["query_id"], r["page_id"], round(r["score"], 9)) for r in many.collect()) == got[0]
    everything = spark.range(sparse.LITERALS + 1).select(F.col("id").cast("string").alias("term"))
    assert "In(term" not in plan_of(sparse.of_terms(saved[1], everything)) and sparse.of_terms(saved[1], everything).count() == postings.count()


def test_pruning_listed_pages_equals_pruning_by_all_allowed_pages(spark):
    numbered = spark.createDataFrame([(p, p, n) for p, n in [(2, "1987"), (9, "1850"), (3, "1987"), (3, "5"), (7, "5")]], "page_id bigint, page_ord bigint, number string")
    queries = spark.createDataFrame([(1, "in 1987"), (2, "in 1850"), (3, "in 1700"), (4, "no number"), (5, "5 of 1987"), (6, None)], "query_id int, query string")
    fused = spark.createDataFrame([(q, p, 1.0 / r, r) for q in range(1, 7) for r, p in enumerate([1, 2, 3, 7], 1)], "query_id int, page_id bigint, score double, rank int")
    rows = lambda df: sorted((r["query_id"], r["rank"], r["page_id"]) for r in df.collect())
    late = numfilter.prune(fused, numfilter.allowed_of(fused, queries, numbered))
    assert rows(late) == rows(numfilter.prune(fused, numfilter.allowed_pages(queries, numbered)))
    assert [p for q, _, p in rows(late) if q == 1] == [2, 3] and [p for q, _, p in rows(late) if q == 2] == [1, 2, 3, 7]


def test_a_sample_shuffles_the_first_rows_of_each_task_alone(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("q"), F.lit(5).alias("_n"), F.lit(6).alias("_r"), F.lit(7).alias("place"))
    sample = pipeline.stratified_sample(rows, "g", "q")
    plan = plan_of(sample)
    assert plan.index("WindowGroupLimit", plan.index("Final")) < plan.index("Exchange", plan.index("WindowGroupLimit")) < plan.rindex("WindowGroupLimit")
    got = sample.collect()
    assert len(got) == 21 and {(r["_n"], r["_r"], r["place"]) for r in got} == {(5, 6, 7)} and {r["g"] for r in got} == {None, 1, 2}


def test_helpers_do_not_clash_with_columns(spark):
    rows = pages(spark).withColumns({"_gt": F.lit(3), "wanted": F.lit(4), "row": F.lit(5), "key": F.lit(6), "_key": F.lit(7)})
    subset = pipeline.select_subset(rows, spark.createDataFrame([(3,)], "page_id bigint"), 2)
    assert [(r["page_id"], r["_gt"], r["wanted"], r["row"]) for r in subset.collect()] == [(3, 3, 4, 5), (1, 3, 4, 5)]
    asked = spark.createDataFrame([("Cats", "who?", 1, 2, 3)], "title string, question string, _key int, key int, row int")
    assert [tuple(r) for r in pipeline.match_titles(asked, rows).collect()] == [("Cats", "who?", 1, 2, 3, 1)]

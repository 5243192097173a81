"""Offline build and query time: the engine's API over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hayrick.config import DEFAULT, Settings
from hayrick.functions import text as T
from hayrick.operators import blocks, bounded, chunking, dense, metrics, numfilter, ranking, sparse
from hayrick.session import discard, materialize, size_in_bytes, write


@dataclass
class Index:
    """The tables that a search reads. ``vectors`` is absent where no encoder was given."""

    chunks: DataFrame
    pages: DataFrame  # page_id, page_ord, n_chunks
    terms: DataFrame
    postings: DataFrame
    numbers: DataFrame
    vectors: DataFrame | None  # packed by page, see dense.pack
    settings: Settings
    peaks: DataFrame | bounded.PagePeaks | None = None  # bounds of terms in pages; a saved index has them
    packed: sparse.Packed | None = None  # the postings as counts by chunk; an index that was built here has them
    only: DataFrame | None = None  # the terms (term) of the only queries that it can answer
    home: str | None = None  # the folder that has the chunks already

    def save(self, path: str, with_bounds: bool = False) -> None:
        """Parquet tables; terms and postings lie by term, so that a search reads the folders of its terms alone.

        ``with_bounds`` adds the table that ``load(with_bounds=True)`` needs.
        """
        if self.only is not None:
            raise ValueError("an index for one batch of queries is not saved")
        if self.home != path:
            write(self.chunks, f"{path}/chunks", "overwrite")
        write(self.pages, f"{path}/pages", "overwrite")
        sparse.save_by_term(self.terms, f"{path}/terms")
        if self.packed is not None:
            sparse.save_postings(self.packed, self.terms.agg(F.sum("df")).first()[0] or 0, f"{path}/postings")
            if with_bounds:
                write(bounded.packed_peaks(self.packed), f"{path}/peaks", "overwrite")
        else:
            sparse.save_by_term(self.postings, f"{path}/postings")
            if with_bounds:
                sparse.save_by_term(materialize(bounded.page_peaks(self.postings, self.pages), "index-peaks"), f"{path}/peaks")
        write(self.numbers, f"{path}/numbers", "overwrite")
        if self.vectors is not None:
            write(self.vectors, f"{path}/vectors", "overwrite")

    def discard(self) -> None:
        """Removes what was written to build the index and is saved since; only a loaded index can be read then."""
        discard(self.chunks, self.pages, self.terms, *([] if self.packed is None else [self.packed.counts]), *([] if self.vectors is None else [self.vectors]))

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: Settings = DEFAULT, with_vectors: bool = True, with_bounds: bool = False) -> Index:
        """The saved tables. ``with_bounds`` ranks the sparse leg by bounds, which pays for short queries (see README)."""
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        peaks = read("peaks") if with_bounds else None
        if with_bounds and "term" not in peaks.columns:
            peaks = bounded.PagePeaks(peaks)
        return cls(read("chunks"), read("pages"), read("terms"), sparse.saved_postings(read("postings")), read("numbers"), read("vectors") if with_vectors else None, settings, peaks)


def build_index(pages: DataFrame, settings: Settings = DEFAULT, encoder: dense.Encoder | None = None, vectors: DataFrame | None = None, path: str | None = None) -> Index:
    """Chunks, postings, numbers and vectors of pages (page_id, title, content, page_ord).

    The chunk table is written once and read by everything after it: under ``path``, if the index will be saved there.
    """
    chunks = chunking.chunk_pages(pages, settings)
    if path is None:
        return index_chunks(materialize(chunks, "index-chunks"), settings, encoder, vectors)
    write(chunks, f"{path}/chunks", "overwrite")
    index = index_chunks(chunks.sparkSession.read.schema(chunks.schema).parquet(f"{path}/chunks"), settings, encoder, vectors)
    index.home = path
    return index


def index_chunks(chunks: DataFrame, settings: Settings = DEFAULT, encoder: dense.Encoder | None = None, vectors: DataFrame | None = None, only: DataFrame | None = None) -> Index:
    """The index of chunks (page_id, chunk_id, text, page_ord, numbers; without the last, the numbers of the text count).

    ``only`` (query_id, query) makes an index for this one batch of queries: every text is read and counts, but postings of terms
    that no query has, which could not meet any, are neither written nor counted by term. More terms than can be sent to
    the texts give the whole index.
    """
    keys = ["page_id", "chunk_id"]
    known = None if only is None else sparse.few_terms(only)
    terms, packed = sparse.build_packed(chunks, keys, settings=settings, known=known)
    terms = materialize(terms, "index-terms")
    sizes = chunks.groupBy("page_id").agg(F.min("page_ord").alias("page_ord"), F.count(F.lit(1)).alias("n_chunks"))
    if encoder is not None:
        vectors = dense.embed(chunks.select(*keys, "page_ord", "text"), encoder)
    if vectors is not None:
        vectors = materialize(dense.pack(vectors), "index-vectors")
    return Index(chunks, materialize(sizes, "index-pages"), terms, packed.postings(), numfilter.page_numbers(chunks), vectors, settings, packed=packed, only=known)


def sparse_leg(index: Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """The best pages by sparse scores; pages without a match join the roll-up as chunks of score 0.

    Few queries are summed in blocks of pages (``operators/blocks.py``); hits of more are shuffled. An index with bounds
    leaves out the postings that cannot reach a list, unless a filter comes before ranking.
    """
    s = index.settings
    asked = sparse.ask(queries, index.terms)
    if index.only is not None and asked.terms.join(index.only, "term", "left_anti").limit(1).count():
        raise ValueError("the index was made for other queries")
    batch = blocks.batch(asked) if 0.0 <= s.sparse_alpha <= 1.0 else None
    plain = lambda: blocks.best_pages(batch, index.packed or index.postings, index.pages, s.sparse_depth, s.sparse_alpha, s.sparse_topn, allowed)
    best = None
    if index.peaks is not None and allowed is None and 0.0 <= s.sparse_alpha <= 1.0:
        best = bounded.best_pages(queries, index.terms, index.postings, index.peaks, index.pages, s.sparse_depth, s.sparse_alpha, s.sparse_topn, rest=plain if batch is not None else None)
    elif batch is not None:
        best = plain()
    if best is not None:
        return ranking.rank(ranking.fill_zero(best, queries, index.pages, s.sparse_depth, allowed), s.sparse_depth)
    scored = sparse.score(asked, index.postings, ["page_id", "chunk_id"]).drop("chunk_id")
    zero = ranking.zero_pages(queries, index.pages, s.sparse_depth, allowed).select("query_id", "page_id", F.lit(0.0).alias("score"))
    rolled = ranking.roll_up(scored.unionByName(zero), index.pages, s.sparse_alpha, s.sparse_topn)
    if allowed is not None:
        rolled = numfilter.keep_allowed(rolled, allowed)
    return ranking.rank(rolled, s.sparse_depth)


def best_units(queries: DataFrame, terms: DataFrame, postings: DataFrame, pages: DataFrame, depth: int) -> DataFrame:
    """(query_id, page_id, page_ord, score, rank): the best matching pages where each page is one unit of ``postings``."""
    asked = sparse.ask(queries, terms)
    batch = blocks.batch(asked)
    if batch is not None:
        return ranking.rank(blocks.best_pages(batch, postings, pages, depth, 1.0, 1), depth)
    scored = sparse.score(asked, postings, ["page_id"]).withColumn("score", F.round("score", 6))
    return ranking.rank(scored.join(pages.select("page_id", "page_ord"), "page_id"), depth)


def dense_leg(index: Index, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``queries`` carries ``embedding``. Under a filter before ranking, a filtered query meets its allowed pages alone."""
    s = index.settings
    return dense.rank_pages(index.vectors, queries, s.dense_depth, s.dense_alpha, s.dense_topn, allowed=allowed)


def search(index: Index, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """(query_id, page_id, score, rank): the hybrid ranking of each query (query_id, query[, embedding])."""
    s = index.settings
    before = None
    if s.number_filter and s.filter_mode == "pre":
        before = materialize(numfilter.allowed_pages(queries, index.numbers), "search-allowed")
    first = dense_leg(index, queries, before) if s.include_dense and index.vectors is not None else None
    second = sparse_leg(index, queries, before) if s.include_sparse else None
    fused = ranking.fuse(first, second, s)
    if s.number_filter and s.filter_mode == "post":
        fused = materialize(fused, "search-fused")  # at most the depths of both legs a query
        filtered = fused.join(numfilter.asked_numbers(queries).select("query_id").distinct(), "query_id", "left_semi")
        few = lambda rows: numfilter.of_listed(rows, filtered, sparse.BROADCAST_ROWS)
        numbers = few(index.numbers) if index.packed is None else numfilter.page_numbers(few(index.chunks))
        fused = numfilter.prune(fused, numfilter.allowed_of(fused, queries, numbers))
    return fused.where(F.col("rank") <= (s.top_k if top_k is None else top_k))


def ranked_lists(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, page_ids): one list per query, best first; empty where nothing was found."""
    lists = ranked.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page_id"))), lambda s: s["page_id"]).alias("page_ids"))
    return queries.select("query_id").join(lists, "query_id", "left").withColumn("page_ids", F.coalesce("page_ids", F.array().cast("array<bigint>")))


def relevant_pairs(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("relevant_page_ids").alias("page_id")).distinct()


def evaluate_run(queries: DataFrame, run: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
    """Means of the metrics of ``run(queries)`` -> (query_id, page_id, rank), checked for its columns."""
    ranked = run(queries)
    if not {"query_id", "page_id", "rank"} <= set(ranked.columns):
        raise TypeError("run() must return query_id, page_id and rank")
    return metrics.means(metrics.per_query(queries, ranked, relevant_pairs(queries), k))


#: Passages that are compared with every page at a time, and rows of passages that are sent to the pages.
PASSAGES, FEW = 1000, 100_000
#: Terms of a passage that are looked up in pages.
RUN = 5
#: And all of those passages together in bytes.
FEW_BYTES = 64 << 20


def _with_runs(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """(page_id, text, run): pages (page_id, text) with each of few ``runs`` of RUN terms that they have, once each."""
    known = {r["run"] for r in runs.collect()}
    sent = pages.sparkSession.sparkContext.broadcast((known, {r.partition(" ")[0] for r in known}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heads = sent.value
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("_t")):
                terms = T.spaced_terms(text.as_py() or "")
                own = {" ".join(terms[j : j + RUN]) for j, x in enumerate(terms) if x in heads} & known
                at += [i] * len(own)
                found += own
            rows = batch.select(["page_id", "text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.string())], ["page_id", "text", "run"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "text", T.spaced_tokens(F.col("text")).alias("_t")).mapInArrow(find, f"page_id {kind}, text string, run string")


def pages_with_passages(passages: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, page_id): pages (page_id, text) that hold a passage (query_id, passage) letter by letter.

    A passage of seven terms or more has five that are whole terms in any text around it (its second to sixth), so its
    pages share that run of terms. The few shorter passages are compared with every page, in blocks of the query set.

    Defined cases: null passages and null texts match nothing; the empty passage is in every text; passages and pages
    that repeat give a row each.
    """
    run = lambda t, i: F.array_join(F.slice(t, i, F.lit(RUN)), " ")
    asked = passages.where(F.col("passage").isNotNull()).withColumn("_t", T.tokenize(F.col("passage")))
    asked = materialize(asked.select("query_id", "passage", F.when(F.size("_t") >= 7, run(F.col("_t"), F.lit(2))).alias("run")), "passages")
    long = asked.where("run is not null")
    n, size = long.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("passage")), F.lit(0))).first()
    if n <= FEW and size <= FEW_BYTES:
        pairs = _with_runs(pages, long.select("run").distinct()).join(F.broadcast(long), "run")
    else:
        runs = pages.select("page_id", F.explode(T.let(T.tokenize(F.col("text")), lambda t: F.array_distinct(F.transform(t, lambda x, i: run(t, i + 1))))).alias("run"))
        pairs = runs.join(long, "run").join(pages, "page_id")
    found = pairs.where(F.col("text").contains(F.col("passage"))).select("query_id", "page_id")
    short = asked.where("run is null").drop("run")
    blocks = -(-short.count() // PASSAGES)
    for k in range(blocks):
        part = short.where(F.pmod(F.xxhash64("query_id", "passage"), F.lit(blocks)) == k)
        found = found.unionByName(pages.join(F.broadcast(part), F.col("text").contains(F.col("passage"))).select("query_id", "page_id"))
    return found


def with_titles(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """``ranked`` with each page's first title in chunk order; a page without one has the empty title."""
    first = chunks.join(ranked.select("page_id").distinct(), "page_id", "left_semi").groupBy("page_id").agg(F.min_by("title", F.struct("page_ord", "chunk_id")).alias("title"))
    return ranked.join(first, "page_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def dense_query(index: Index, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """(query_id, page_id, page_ord, score, rank, title) by the dense leg alone, without number filter."""
    s = index.settings
    return with_titles(dense.rank_pages(index.vectors, queries, top_k, s.dense_alpha, s.dense_topn), index.chunks)


def select_subset(pages: DataFrame, relevant: DataFrame, n: int) -> DataFrame:
    """``n`` pages for development, relevant ones first, else in page order (relevant pages alone if they fill it)."""
    wanted = relevant.select("page_id").distinct().withColumn("wanted", F.lit(1))
    rows = pages.select("page_id", "page_ord", _whole(pages))
    return rows.join(wanted, "page_id", "left").orderBy(F.col("wanted").desc_nulls_last(), "page_ord").limit(n).select("row.*")


def _whole(rows: DataFrame) -> Column:
    """A row as one column, so that no helper can clash with its columns."""
    return F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")


def match_titles(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(title, question) with the page of the same cleaned title; of several, the last in page order."""
    key = T.clean_title(F.col("title"))
    known = pages.groupBy(key.alias("key")).agg(F.max_by("page_id", "page_ord").alias("page_id"))
    asked = questions.select(key.alias("key"), _whole(questions))
    return asked.join(known, "key").where(F.col("page_id").isNotNull()).select("row.*", "page_id")


def stratified_sample(rows: DataFrame, by: str, of: str, per_group: int = 7, seed: int = 42, strict: bool = False) -> DataFrame:
    """``per_group`` rows of each group, chosen by an MD5 of seed and content.

    Smaller groups are left out or, with ``strict``, fail the query. Null groups and contents count like any other value.
    """
    packed = rows.select(F.col(by).alias("group"), F.col(of).alias("content"), _whole(rows))
    mark = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), F.col("content").cast("string")), "UTF-8"))
    # Only a group's first rows of every task are shuffled: the count is another aggregation, not a window over all rows.
    first = packed.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy(mark, "content"))).where(F.col("place") <= per_group)
    sizes = packed.groupBy(F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    if strict:
        short = F.raise_error(F.concat(F.lit("too few rows in group "), F.coalesce(F.col("g").cast("string"), F.lit("null")))).cast("boolean")
        sizes = sizes.where(F.when(F.col("n") >= per_group, True).otherwise(short))
    large = sizes.where(F.col("n") >= per_group).select("g")
    return first.join(large, F.col("group").eqNullSafe(F.col("g")), "left_semi").select("row.*")


def check_ranking(ranked: DataFrame, queries: DataFrame, least: int = 10) -> DataFrame:
    """(query_id, n, repeated, missing_ids, ok): whether each query has enough ids, all present and distinct."""
    facts = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("d"), F.count(F.when(F.col("page_id").isNull(), 1)).alias("missing_ids"))
    rows = queries.select("query_id").join(facts, "query_id", "left").fillna(0, ["n", "d", "missing_ids"])
    repeated = F.col("n") - F.col("d") - F.col("missing_ids")
    return rows.select("query_id", "n", repeated.alias("repeated"), "missing_ids", ((F.col("n") >= least) & (repeated <= 0) & (F.col("missing_ids") == 0)).alias("ok"))


def check_index(index: Index, width: int, vector_kind: str = "float", least_bytes: int = 500) -> list[str]:
    """What is wrong with a saved index, as sentences; none if it can be submitted.

    Vectors must be arrays of ``vector_kind``, all ``width`` wide, finite and at unit length, one per chunk; every
    table's files must hold at least ``least_bytes``.
    """
    wrong = []
    if index.vectors is None:
        wrong.append("there are no vectors")
    else:
        kind = index.vectors.schema["v"].dataType.elementType.elementType.simpleString()
        if kind != vector_kind:
            wrong.append(f"vectors hold {kind}, not {vector_kind}")
        facts = dense.validate(index.vectors.select(F.explode("v").alias("x")), "x", width).first()
        wrong += [f"{facts[c]} vectors: {c}" for c in ("wrong_width", "non_finite") if facts[c]]
        if facts["max_norm_error"] is not None and facts["max_norm_error"] > 1e-3:
            wrong.append("vectors are not at unit length")
        if facts["n_rows"] != index.chunks.count():
            wrong.append(f"{facts['n_rows']} vectors for {index.chunks.count()} chunks")
    for name in ("chunks", "pages", "terms", "postings", "vectors"):
        found = getattr(index, name)
        if found is not None and size_in_bytes(found) < least_bytes:
            wrong.append(f"{name} hold less than {least_bytes} bytes")
    return wrong


def check_results(results: list[list[int]], n_queries: int, least: int = 10) -> list[str]:
    """What is wrong with the lists that ``run`` returned for ``n_queries`` queries."""
    wrong = [] if len(results) == n_queries else [f"{len(results)} lists for {n_queries} queries"]
    for i, ids in enumerate(results):
        if len(ids) < least:
            wrong.append(f"list {i} has {len(ids)} ids, fewer than {least}")
        if len(set(ids)) < len(ids):
            wrong.append(f"list {i} repeats an id")
        if not all(type(x) is int for x in ids):
            wrong.append(f"list {i} holds what is no whole number")
    return wrong


def run(index: Index, queries: list[str], encoder: dense.Encoder | None = None, top_k: int | None = None) -> list[list[int]]:
    """Page ids for each query text, best first, in the order of ``queries``: the plain entry point.

    The queries are a small list; the ids that come back are at most ``top_k`` a query. Without an encoder the sparse
    leg ranks alone. No queries give no lists.
    """
    if not queries:
        return []
    spark = index.chunks.sparkSession
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query string")
    if encoder is not None:
        asked = dense.embed(asked, encoder, "query")
    elif index.vectors is not None:
        asked = asked.withColumn("embedding", F.lit(None).cast("array<float>"))
    lists = ranked_lists(search(index, asked, top_k), asked.select("query_id")).collect()
    return [r["page_ids"] for r in sorted(lists, key=lambda r: r["query_id"])]

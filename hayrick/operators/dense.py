"""Dense vectors: normalisation, exact inner-product ranking of pages, and encoders."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hayrick.functions import text as T
from hayrick.operators.sparse import term_counts

#: Queries that are sent to the executors at a time; more are handled block by block.
QUERY_BLOCK = 8192
#: Inside a task, this many queries meet this many chunk vectors at a time.
QUERIES, CHUNKS = 512, 2048
#: Chunk vectors of one row of the packed table.
PAGE_ROWS = 4096
#: Hashed vectors up to this width are summed as so many columns.
SUMS = 128


def l2_normalize(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return T.let(wide, lambda v: T.let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def validate(vectors: DataFrame, vector: str, width: int) -> DataFrame:
    """One row of facts about a vector table: rows, wrong_width, non_finite, max_norm_error."""
    v = F.col(vector)
    wide = F.transform(v, lambda x: x.cast("double"))
    bad = F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.coalesce(F.size(v), F.lit(-1)) != width, 1).otherwise(0)).cast("bigint").alias("wrong_width"),
        F.sum(bad.cast("int")).cast("bigint").alias("non_finite"),
        F.round(F.max(F.abs(norm - F.lit(1.0))), 5).alias("max_norm_error"),
    )


def pack(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(page_id, part, parts, page_ord, n, v): the chunk vectors of each page in one row of at most PAGE_ROWS vectors.

    Made once, when the index is built, so that a search shuffles no vectors. A page of more chunks is dealt to several
    parts. Null vectors are left out; n is the number of vectors of the whole page.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select("page_id", "page_ord", F.col(vector).alias("v"), F.monotonically_increasing_id().alias("_m"))
    sizes = rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.min("page_ord").alias("page_ord"))
    dealt = rows.drop("page_ord").join(sizes, "page_id").withColumn("parts", F.ceil(F.col("n") / PAGE_ROWS).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.col("_m"), F.col("parts")).cast("int"))
    return dealt.groupBy("page_id", "part", "parts", "page_ord", "n").agg(F.collect_list("v").alias("v"))


def _page_scores(scores: np.ndarray, first: np.ndarray, alpha: float, topn: int) -> np.ndarray:
    """Score per page and query from (chunks, queries) scores; a page's chunks run from its ``first`` on."""
    size = np.diff(first, append=len(scores))[:, None]
    most = np.maximum.reduceat(scores, first, axis=0)
    total = np.add.reduceat(scores, first, axis=0)
    for p in np.flatnonzero(size[:, 0] > topn):
        own = scores[first[p] : first[p] + size[p, 0]]
        total[p] = -np.partition(-own, topn - 1, axis=0)[:topn].sum(0)
    return alpha * most + (1.0 - alpha) * total / np.minimum(size, topn)


class _Best:
    """The best ``depth`` pages of each query so far, better scores first and ties in page order."""

    def __init__(self, queries: int, depth: int):
        self.depth = depth
        self.score, self.order, self.page = (np.zeros((queries, 0), k) for k in (np.float64, np.int64, np.int64))

    def add(self, score: np.ndarray, order: np.ndarray, page: np.ndarray) -> None:
        """``score`` is (queries, pages); -inf where a page is not to be listed for a query."""
        order, page = np.broadcast_to(order, score.shape), np.broadcast_to(page, score.shape)
        score, order, page = (np.concatenate([old, new], 1) for old, new in ((self.score, score), (self.order, order), (self.page, page)))
        place = np.lexsort((order, -score), axis=1)[:, : self.depth]
        self.score, self.order, self.page = (np.take_along_axis(x, place, 1) for x in (score, order, page))


def _matrix(rows: list, width: int) -> np.ndarray:
    """The vectors of some pages as one matrix; another width, or a null component, fails."""
    if any(len(x) != width for v in rows for x in v):
        raise ValueError(f"a chunk vector is not {width} wide")
    out = np.array([x for v in rows for x in v], np.float64)
    if np.isnan(out).any():
        raise ValueError("a chunk vector has a component that is null or not a number")
    return out


def _search(packed: DataFrame, block: pd.DataFrame, kind: str, depth: int, alpha: float, topn: int, masked: bool) -> DataFrame:
    """Best pages of one block of queries from every task. With ``masked``, rows carry the queries that may list them."""
    sent = packed.sparkSession.sparkContext.broadcast(pickle.dumps((block["query_id"].tolist(), np.array(block["v"].tolist(), dtype=np.float64).reshape(len(block), -1))))

    def slices(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with about CHUNKS vectors at a time."""
        for pdf in it:
            upto = np.cumsum([len(v) for v in pdf["v"]])
            low = 0
            while low < len(pdf):
                high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + CHUNKS, "right")))
                yield pdf.iloc[low:high]
                low = high

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = pickle.loads(sent.value)
        number = {x: i for i, x in enumerate(ids)}
        best = [_Best(min(QUERIES, len(ids) - a), depth) for a in range(0, len(ids), QUERIES)]
        for part in slices(it):
            x = _matrix(part["v"].tolist(), q.shape[1])
            first = np.concatenate([[0], np.cumsum([len(v) for v in part["v"]])[:-1]]).astype(np.int64)
            order, page = part["page_ord"].to_numpy(np.int64), part["page_id"].to_numpy(np.int64)
            if masked:
                rows = np.repeat(np.arange(len(part)), [len(o) for o in part["only"]])
                own = np.array([number.get(y, -1) for o in part["only"] for y in o], np.int64)
            for k, top in enumerate(best):
                a = k * QUERIES
                score = _page_scores(x @ q[a : a + QUERIES].T, first, alpha, topn).round(6)
                if masked:
                    here = (own >= a) & (own < a + QUERIES)
                    open_ = np.zeros(score.shape, bool)
                    open_[rows[here], own[here] - a] = True
                    score = np.where(open_, score, -np.inf)
                top.add(score.T, order, page)
        for k, top in enumerate(best):
            row, col = np.nonzero(top.score > -np.inf)
            yield pd.DataFrame({"query_id": [ids[k * QUERIES + i] for i in row], "page_id": top.page[row, col], "page_ord": top.order[row, col], "score": top.score[row, col]})

    return packed.mapInPandas(run, f"query_id {kind}, page_id bigint, page_ord bigint, score double")


def _wide_pages(packed: DataFrame, block: pd.DataFrame, kind: str, alpha: float, topn: int) -> DataFrame:
    """Scores of pages that lie in several parts: each part gives its ``topn`` best chunk scores, which meet by page."""
    sent = packed.sparkSession.sparkContext.broadcast(pickle.dumps((block["query_id"].tolist(), np.array(block["v"].tolist(), dtype=np.float64).reshape(len(block), -1))))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = pickle.loads(sent.value)
        for pdf in it:
            for page, order, n, v in zip(pdf["page_id"], pdf["page_ord"], pdf["n"], pdf["v"]):
                x = _matrix([v], q.shape[1])
                for a in range(0, len(ids), QUERIES):
                    score = np.sort(x @ q[a : a + QUERIES].T, axis=0)[::-1][:topn].T
                    yield pd.DataFrame({"query_id": ids[a : a + QUERIES], "page_id": page, "page_ord": order, "n": n, "top": list(score)})

    parts = packed.mapInPandas(run, f"query_id {kind}, page_id bigint, page_ord bigint, n bigint, top array<double>")
    every = F.slice(F.sort_array(F.flatten(F.collect_list("top")), asc=False), 1, topn)
    rows = parts.groupBy("query_id", "page_id", "page_ord", "n").agg(every.alias("top"))
    mean = F.aggregate("top", F.lit(0.0), lambda a, x: a + x) / F.least(F.col("n"), F.lit(topn))
    return rows.select("query_id", "page_id", "page_ord", F.round(F.lit(float(alpha)) * F.get("top", F.lit(0)) + F.lit(1.0 - alpha) * mean, 6).alias("score"))


def rank_pages(vectors: DataFrame, queries: DataFrame, depth: int, alpha: float = 0.0, topn: int = 100, vector: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, page_id, page_ord, score, rank): each query's best pages by rolled-up inner products.

    ``vectors`` is the result of ``pack``, or raw rows (page_id, page_ord and a vector per chunk) that are packed here;
    ``queries`` has query_id and the vector. Every task keeps its best ``depth`` pages per query, and only those are
    ranked against each other. With ``allowed`` (query_id, page_id), queries that occur in it list those pages alone,
    and only those are scored for them.

    Defined cases: queries and chunks with a null vector are left out, and so are pages that then have none; a chunk
    vector of another width than the queries', or with a null component, fails; equal scores (rounded to six places,
    so that they are the same in any engine) fall to page_ord; chunks that repeat count each; an empty table gives an
    empty result. Queries go to the executors in blocks of QUERY_BLOCK.
    """
    packed = vectors if {"part", "parts", "v"} <= set(vectors.columns) else pack(vectors, vector)
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("v"))
    groups = [(asked, None)]
    if allowed is not None:
        limits = allowed.select("query_id", "page_id").distinct()
        names = limits.select("query_id").distinct()
        groups = [(asked.join(names, "query_id", "left_anti"), None), (asked.join(names, "query_id", "left_semi"), limits)]
    found = None
    for some, limits in groups:
        total = some.count()
        blocks = -(-total // QUERY_BLOCK)
        for k in range(blocks):
            block = (some.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k) if blocks > 1 else some).toPandas()
            if not len(block):
                continue
            one, many = packed.where("parts = 1"), packed.where("parts > 1")
            if limits is not None:
                here = limits.join(F.broadcast(some.sparkSession.createDataFrame([(x,) for x in block["query_id"].tolist()], f"query_id {kind}")), "query_id")
                one = one.join(here.groupBy("page_id").agg(F.collect_list("query_id").alias("only")), "page_id")
            columns = ["page_id", "page_ord", "v", *(["only"] if limits is not None else [])]
            rows = _search(one.select(*columns), block, kind, depth, alpha, topn, limits is not None)
            wide = _wide_pages(many, block, kind, alpha, topn)
            if limits is not None:
                wide = wide.join(limits, ["query_id", "page_id"], "left_semi")
            rows = rows.unionByName(wide)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"query_id {kind}, page_id bigint, page_ord bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("page_ord"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


class Encoder(Protocol):
    """Anything that turns a batch of texts into a (texts, width) array."""

    width: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


def embed(rows: DataFrame, encoder: Encoder, text: str = "text", batch: int = 1024) -> DataFrame:
    """Adds ``embedding`` by an encoder that each Python worker holds once; texts go to it in batches."""

    @F.pandas_udf(t.ArrayType(t.FloatType()))
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            listed = texts.fillna("").tolist()
            parts = [encoder.encode(listed[i : i + batch]) for i in range(0, len(listed), batch)]
            yield pd.Series([v.astype(np.float32) for p in parts for v in p])

    return rows.withColumn("embedding", run(F.col(text)))


def hash_embed(rows: DataFrame, keys: list[str], width: int = 64, text: str = "text") -> DataFrame:
    """(keys, embedding): signed feature hashing of terms, at unit length. A stand-in for a trained encoder.

    A term's MD5 picks its place (first seven hex digits) and its sign (the last digit's parity). Each distinct term of
    a text is hashed once and counts as often as it occurs.
    """
    digest = F.md5(F.encode("term", "UTF-8"))
    terms = term_counts(rows, keys, text).select(*keys, digest.alias("d"), F.col("freq").cast("double").alias("f"))
    place = F.conv(F.substring("d", 1, 7), 16, 10).cast("bigint") % width
    sign = F.when(F.conv(F.substring("d", 32, 1), 16, 10).cast("int") % 2 == 0, F.col("f")).otherwise(-F.col("f"))
    cells = terms.select(*keys, place.alias("p"), sign.alias("s"))
    if width <= SUMS:
        # A text's terms lie together, so each task shuffles one row of sums for it.
        sums = cells.groupBy(*keys).agg(*[F.sum(F.when(F.col("p") == i, F.col("s"))).alias(f"_x{i}") for i in range(width)])
        dense = F.array(*[F.coalesce(f"_x{i}", F.lit(0.0)) for i in range(width)])
        return sums.select(*keys, dense.alias("_x")).select(*keys, l2_normalize(F.col("_x")).alias("embedding"))
    cells = cells.groupBy(*keys, "p").agg(F.sum("s").alias("x"))
    spread = F.map_from_entries(F.collect_list(F.struct("p", "x")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("bigint")), F.lit(0.0)))
    return cells.groupBy(*keys).agg(spread.alias("m")).select(*keys, l2_normalize(dense).alias("embedding"))

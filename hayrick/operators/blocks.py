"""Sparse page lists in blocks of pages: a page's hits are summed in the task that has its postings, and none is shuffled.

What is shuffled are the postings of the queries' terms, once each, however many queries have a term, and the best pages
of every slice of pages.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from hayrick.operators import sparse

#: Distinct queries up to this number are summed in blocks.
QUERIES = 4096
#: Postings in a slice of pages, on average; a slice is in memory at once.
SLICE = 500_000
#: Postings that a task packs by slice at a time, before they are shuffled.
PACK = 1_000_000
#: Inside a slice, so many pairs of chunk and query, and so many hits, are handled at a time.
CELLS, HITS = 1 << 21, 1 << 21


@dataclass
class Batch:
    """The terms of few queries by number: the queries of term ``t`` are ``query[first[t]:first[t + 1]]``, numbers into ``ids``."""

    ids: pa.Array
    first: np.ndarray
    query: np.ndarray
    idf: np.ndarray
    terms: DataFrame  # term, t
    asked: sparse.Asked
    slices: int

    def numbers(self) -> dict[str, int]:
        return {r["term"]: r["t"] for r in self.terms.collect()}

    def send(self, **more) -> object:
        return self.terms.sparkSession.sparkContext.broadcast(pickle.dumps({"ids": self.ids, "first": self.first, "query": self.query, "idf": self.idf} | more))


def batch(asked: sparse.Asked) -> Batch | None:
    """The batch, or none where its queries or terms are too many to be sent to the postings."""
    if not asked.few or asked.known.select("query_id").distinct().limit(QUERIES + 1).count() > QUERIES:
        return None
    spark, rows = asked.known.sparkSession, asked.known.toArrow()
    query, term = (rows[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("query_id", "term"))
    t = term.indices.to_numpy().astype(np.int64)
    order = np.argsort(t, kind="stable")
    first = np.searchsorted(t[order], np.arange(len(term.dictionary) + 1))
    terms = spark.createDataFrame(pa.table({"term": term.dictionary.cast(pa.string()), "t": pa.array(np.arange(len(term.dictionary), dtype=np.int32))}))
    postings = int(rows["df"].to_numpy()[order][first[:-1]].sum())
    idf = rows["idf"].to_numpy().astype(np.float64)
    return Batch(query.dictionary, first, query.indices.to_numpy().astype(np.int64)[order], idf[order], terms, asked, -(-postings // SLICE) or 1)


def _pages_of(found: pa.Table, pages: pa.Table, sent: dict, weights: list[str]):
    """(pages, chunk scores, ...) by blocks in page order: one matrix of chunks and queries for each of ``weights``, the rows of a
    block belong to ``pages`` (ascending numbers into the slice's pages). A page may go on in the next block."""
    first, query, idf, nq = sent["first"], sent["query"], sent["idf"], len(sent["ids"])
    found = pa.table({c: pc.list_flatten(found[c]) for c in ("page_id", "chunk_id", "t", *weights)})
    page = pc.index_in(found["page_id"], value_set=pages["page_id"].combine_chunks())
    found, page = found.filter(page.is_valid()), page.drop_null().to_numpy().astype(np.int64)
    if not len(page):
        return
    chunk, t = (found[c].to_numpy().astype(np.int64) for c in ("chunk_id", "t"))
    order = np.lexsort((t, chunk, page))
    page, chunk, t = page[order], chunk[order], t[order]
    ws = [found[c].to_numpy()[order] for c in weights]
    new = np.append(True, (page[1:] != page[:-1]) | (chunk[1:] != chunk[:-1]))
    start = np.flatnonzero(new)
    unit = np.cumsum(new) - 1
    n = first[t + 1] - first[t]
    upto = np.cumsum(np.add.reduceat(n, start)) // HITS
    units = np.arange(1, len(start))
    cuts = np.flatnonzero((upto[1:] != upto[:-1]) | (units % max(1, CELLS // nq) == 0)) + 1
    cuts = [0, *cuts.tolist(), len(start)]
    start = np.append(start, len(page))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        rows = slice(start[low], start[high])
        many = n[rows]
        pair = np.repeat(first[t[rows]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell = np.repeat((unit[rows] - low) * nq, many) + query[pair]
        yield page[start[low:high]], *[np.bincount(cell, np.repeat(w[rows], many) * idf[pair], (high - low) * nq).reshape(-1, nq) for w in ws]


def _best_chunks(scores: np.ndarray, topn: int) -> np.ndarray:
    return -np.partition(-scores, topn - 1, axis=0)[:topn] if len(scores) > topn else scores


def _rolled(blocks, n_chunks: np.ndarray, alpha: float, topn: int):
    """(pages, page scores) by blocks; a page that goes on in the next block hands its best chunks over to it."""
    held, blocks = None, iter(blocks)
    block = next(blocks, None)
    while block is not None:
        page, scores = block
        block = next(blocks, None)
        if held is not None:
            page, scores = np.append(np.full(len(held[1]), held[0]), page), np.concatenate([held[1], scores])
            held = None
        if block is not None and block[0][0] == page[-1]:
            last = np.searchsorted(page, page[-1])
            held = page[-1], _best_chunks(scores[last:], topn)
            page, scores = page[:last], scores[:last]
            if not last:
                continue
        start = np.flatnonzero(np.append(True, page[1:] != page[:-1]))
        most, total = np.maximum.reduceat(scores, start, axis=0), np.add.reduceat(scores, start, axis=0)
        for p in np.flatnonzero(np.diff(start, append=len(page)) > topn):
            total[p] = _best_chunks(scores[start[p] : start[p] + np.searchsorted(page[start[p] :], page[start[p]], "right")], topn).sum(0)
        own = page[start]
        score = alpha * most + (1.0 - alpha) * total / np.minimum(n_chunks[own], topn)[:, None]
        yield own, np.where(most > 0, np.floor(score * 1e6 + 0.5) / 1e6, -np.inf)


def _first(score: np.ndarray, page: np.ndarray, query: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Which of these pairs are among the first ``depth`` of their query, ties in page order."""
    place = np.lexsort((order[page], -score, query))
    q = query[place]
    return place[np.arange(len(q)) - np.searchsorted(q, q) < depth]


def _top(blocks, order: np.ndarray, depth: int, only: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, page, query) of the best ``depth`` pages of each query."""
    best = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for page, score in blocks:
        if only is not None:
            score = only(page, score)
        least = np.partition(score, len(score) - depth, axis=0)[len(score) - depth] if len(score) > depth else -np.inf
        row, col = np.nonzero((score >= least) & (score > -np.inf))
        best = tuple(np.concatenate(x) for x in zip(best, (score[row, col], page[row], col), strict=True))
        kept = _first(*best, order, depth)
        best = tuple(x[kept] for x in best)
    return best


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a slice to rows of a slice and lists of all other columns, from about PACK rows at a time."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        of = rows["slice"].to_numpy()
        order = np.argsort(of, kind="stable")
        start = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
        rows = rows.take(pa.array(order)).combine_chunks()
        upto = pa.array(np.append(start, len(of)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(upto, rows[c].combine_chunks()) for c in rows.column_names if c != "slice"]
        return pa.RecordBatch.from_arrays([rows["slice"].combine_chunks().take(pa.array(start)), *lists], ["slice", *[c for c in rows.column_names if c != "slice"]])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACK:
            yield pack(held)
            held, n = [], 0
    if held:
        yield pack(held)


def _slices(batch: Batch, rows: DataFrame | sparse.Packed, keys: list, weights: list[str], pages: DataFrame):
    """Rows of the batch's terms and ``pages``, both grouped by slices of pages. Rows of a slice are packed before they are
    shuffled, so that neither the shuffle nor its sort handles single postings."""
    of = F.pmod(F.xxhash64("page_id"), F.lit(batch.slices)).cast("int").alias("slice")
    pages = pages.where(F.col("page_id").isNotNull()).select(of, *pages.columns)
    if not isinstance(rows, DataFrame):  # packed counts, or packed peaks
        sent = batch.terms.sparkSession.sparkContext.broadcast(batch.numbers())
        found, numbered = rows.of_numbers(lambda: sent.value, [of, F.col("page_id"), *keys])
        found = found.where(F.col("page_id").isNotNull())
        own = [f for f in found.schema if f.name not in rows.reads] + [StructField("t", IntegerType()), *(StructField(c, DoubleType()) for c in rows.gives)]
        packed = found.mapInArrow(lambda it: _by_slice(numbered(it)), _lists(own))
    else:
        own = sparse.of_terms(rows, batch.asked.terms).join(F.broadcast(batch.terms), "term").where(F.col("page_id").isNotNull())
        found = own.select(of, "page_id", *keys, "t", *weights)
        packed = found.mapInArrow(_by_slice, _lists(found.schema))
    return packed.groupBy("slice").cogroup(pages.groupBy("slice"))


def _lists(fields) -> StructType:
    return StructType([StructField(f.name, f.dataType if f.name == "slice" else ArrayType(f.dataType)) for f in fields])


def _kinds(batch: Batch, pages: DataFrame) -> tuple[str, str, str]:
    return batch.asked.known.schema["query_id"].dataType.simpleString(), *(pages.schema[c].dataType.simpleString() for c in ("page_id", "page_ord"))


def best_pages(batch: Batch, postings: DataFrame | sparse.Packed, pages: DataFrame, depth: int, alpha: float, topn: int, allowed: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(query_id, page_id, page_ord, score): page scores that hold each query's best ``depth`` pages with a match.

    ``postings`` is (term, page_id, chunk_id, tf_weight), without chunk_id where a page is one chunk, or the packed counts of the
    same keys; ``pages`` gives page_ord and n_chunks of each page once. Scores are those of ``sparse.scores`` and ``ranking.roll_up``, rounded to six places. Queries that
    ``allowed`` (query_id, page_id) names list those pages alone, and with ``every`` all queries do, the one without an id too.
    """
    query_kind, page_kind, order_kind = _kinds(batch, pages)
    chunk = F.col("chunk_id") if "chunk_id" in (postings.keys if isinstance(postings, sparse.Packed) else postings.columns) else F.lit(0)
    columns, filtered = ["page_id", "page_ord", "n_chunks"], None
    if allowed is not None:
        allowed = allowed if every else allowed.where(F.col("query_id").isNotNull())
        filtered = batch.ids if every else pa.array([r["query_id"] for r in allowed.select("query_id").distinct().collect()], batch.ids.type)
        pages = pages.join(allowed.groupBy("page_id").agg(F.collect_set(F.struct("query_id")).alias("only")), "page_id", "left")
        columns.append("only")
    sent = batch.send(filtered=filtered)

    def run(found: pa.Table, own: pa.Table) -> pa.Table:
        sent_ = pickle.loads(sent.value)
        only = _mask(own, sent_) if sent_["filtered"] is not None else None
        rolled = _rolled(_pages_of(found, own, sent_, ["tf_weight"]), own["n_chunks"].to_numpy(), alpha, topn)
        score, page, query = _top(rolled, _ranks(own["page_ord"]), depth, only)
        return pa.table({"query_id": sent_["ids"].take(pa.array(query)), "page_id": own["page_id"].take(pa.array(page)), "page_ord": own["page_ord"].take(pa.array(page)), "score": pa.array(score)})

    slices = _slices(batch, postings, [chunk.cast("int").alias("chunk_id")], ["tf_weight"], pages.select(*columns))
    return slices.applyInArrow(run, f"query_id {query_kind}, page_id {page_kind}, page_ord {order_kind}, score double")


def _mask(own: pa.Table, sent: dict) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Scores of pages with those left out that a filtered query may not list."""
    ids, lists = sent["ids"], own["only"].combine_chunks()
    free = ~pc.is_in(ids, value_set=sent["filtered"]).to_numpy(zero_copy_only=False)
    query = pc.index_in(lists.flatten().field(0), value_set=ids)
    known = query.is_valid().to_numpy(zero_copy_only=False)
    page = pc.list_parent_indices(lists).to_numpy().astype(np.int64)[known]
    query = query.drop_null().to_numpy()

    def only(rows: np.ndarray, score: np.ndarray) -> np.ndarray:
        open_ = np.repeat(free[None, :], len(rows), 0)
        low, high = np.searchsorted(page, rows[0]), np.searchsorted(page, rows[-1], "right")
        at = np.searchsorted(rows, page[low:high])
        here = rows[at] == page[low:high]
        open_[at[here], query[low:high][here]] = True
        return np.where(open_, score, -np.inf)

    return only


def _bounds(found: pa.Table, own: pa.Table, sent: dict, alpha: float, topn: int):
    """(pages, bounds) by blocks, as ``bounded.page_bounds`` defines them."""
    size = np.minimum(own["n_chunks"].to_numpy(), topn)
    for page, most, total in _pages_of(found, own, sent, ["peak", "total"]):
        mean = np.minimum(most, total / size[page][:, None])
        yield page, np.where(most > 0, alpha * most + (1.0 - alpha) * mean, -np.inf)


def first_pairs(batch: Batch, peaks: DataFrame, pages: DataFrame, depth: int, alpha: float, topn: int) -> DataFrame:
    """(query_id, page_id, bound) that hold the ``depth`` pages of each query's greatest bounds, ties by page_id."""
    query_kind, page_kind, _ = _kinds(batch, pages)
    sent = batch.send()

    def run(found: pa.Table, own: pa.Table) -> pa.Table:
        sent_ = pickle.loads(sent.value)
        bound, page, query = _top(_bounds(found, own, sent_, alpha, topn), _ranks(own["page_id"]), depth)
        return pa.table({"query_id": sent_["ids"].take(pa.array(query)), "page_id": own["page_id"].take(pa.array(page)), "bound": pa.array(bound)})

    slices = _slices(batch, peaks, [F.lit(0).alias("chunk_id")], ["peak", "total"], pages.select("page_id", "n_chunks"))
    return slices.applyInArrow(run, f"query_id {query_kind}, page_id {page_kind}, bound double")


def open_pairs(batch: Batch, peaks: DataFrame, pages: DataFrame, least: DataFrame, alpha: float, topn: int, count: bool) -> DataFrame:
    """(query_id, page_id) whose bound reaches ``least`` (q, least) of their query, or how many they are, slice by slice (n)."""
    query_kind, page_kind, _ = _kinds(batch, pages)
    rows = least.toArrow()
    sent = batch.send(q=rows["q"].combine_chunks(), least=rows["least"].to_numpy())

    def run(found: pa.Table, own: pa.Table) -> pa.Table:
        sent_ = pickle.loads(sent.value)
        at = pc.index_in(sent_["ids"], value_set=sent_["q"])
        known, floor = at.is_valid().to_numpy(zero_copy_only=False), np.full(len(at), -np.inf)
        floor[known] = sent_["least"][at.drop_null().to_numpy()]
        parts = [(page, np.nonzero((bound >= floor) & (bound > -np.inf))) for page, bound in _bounds(found, own, sent_, alpha, topn)]
        if count:
            return pa.table({"n": pa.array([sum(len(row) for _, (row, _) in parts)], pa.int64())})
        page, query = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([p[row] for p, (row, _) in parts], [col for _, (_, col) in parts]))
        return pa.table({"query_id": sent_["ids"].take(pa.array(query)), "page_id": own["page_id"].take(pa.array(page))})

    slices = _slices(batch, peaks, [F.lit(0).alias("chunk_id")], ["peak", "total"], pages.select("page_id", "n_chunks"))
    return slices.applyInArrow(run, "n bigint" if count else f"query_id {query_kind}, page_id {page_kind}")

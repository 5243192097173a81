"""Sparse ranking of pages by bounds: hits that cannot change a list are never summed, and the list is exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.operators import blocks, ranking, sparse
from hayrick.session import freed_shuffles, materialize

KEYS = ["page_id", "chunk_id"]
#: Bounds may fall short of a rounded score by half of its last place, and by the rounding of a sum.
SLACK = 2e-6
#: Pairs of query and page up to this number, with query ids up to so many bytes in all, are sent to the postings; with
#: more, nothing is left out.
SEND = 1_000_000
SEND_BYTES = 64 << 20


def page_peaks(postings: DataFrame, pages: DataFrame) -> DataFrame:
    """(term, page_id, n_chunks, peak, total): the greatest weight of a term in any chunk of a page, and their sum.

    ``postings`` is (term, page_id, chunk_id, tf_weight), ``pages`` gives n_chunks; pages it does not know are left out, as
    a roll-up does. Rows that repeat a term and chunk add up, as they do in a score.
    """
    # Dealt by page once: no grouping or join below shuffles again.
    own = postings.repartition("page_id").groupBy("term", *KEYS).agg(F.sum("tf_weight").alias("w"))
    peaks = own.groupBy("term", "page_id").agg(F.max("w").alias("peak"), F.sum("w").alias("total"))
    return peaks.join(pages.select("page_id", "n_chunks"), "page_id").select("term", "page_id", "n_chunks", "peak", "total")


@dataclass
class PagePeaks:
    """``page_peaks`` with the terms of a page in one row (page_id, terms, peaks, totals), as ``packed_peaks`` makes them. A page
    may have several rows: their peaks and totals add up to bounds as well, if not to the least ones."""

    packed: DataFrame
    reads, gives = ("terms", "peaks", "totals"), ("peak", "total")

    def rows(self, pages: DataFrame) -> DataFrame:
        """(term, page_id, n_chunks, peak, total)."""
        each = self.packed.select("page_id", F.inline(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("peaks").alias("peak"), F.col("totals").alias("total"))))
        wide = each.select("term", "page_id", F.col("peak").cast("double").alias("peak"), F.col("total").cast("double").alias("total"))
        return wide.join(pages.select("page_id", "n_chunks"), "page_id").select("term", "page_id", "n_chunks", "peak", "total")

    def of_numbers(self, number: Callable[[], dict[str, int]], first: list[Column]) -> tuple[DataFrame, Callable]:
        """As ``sparse.Packed.of_numbers``, with peak and total for tf_weight."""
        reads, gives = self.reads, self.gives

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = number()
            terms, of = pa.array(list(numbers), pa.string()), np.fromiter(numbers.values(), np.int32, len(numbers))
            for batch in batches:
                flat = sparse.flat_terms(batch.column("terms"))
                at = pc.index_in(flat, value_set=terms.cast(flat.type))
                known = at.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), batch.column("peaks").value_lengths().to_numpy())[known]
                kept = batch.select([c for c in batch.schema.names if c not in reads]).take(pa.array(row))
                weights = [pa.array(batch.column(c).flatten().to_numpy()[known].astype(np.float64)) for c in ("peaks", "totals")]
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(of[at.drop_null().to_numpy()]), *weights], [*kept.schema.names, "t", *gives])

        return self.packed.select(*first, *self.reads), run


def _up(x: np.ndarray) -> pa.Array:
    """In four bytes, and no less."""
    y = x.astype(np.float32)
    return pa.array(np.where(y < x, np.nextafter(y, np.float32(np.inf)), y))


def packed_peaks(packed: sparse.Packed) -> DataFrame:
    """(page_id, terms, peaks, totals): of each page its terms with spaces between, the greatest weight of each in any chunk, and
    the sum of its weights. Chunks of a page lie side by side where an index was built, so nothing is shuffled; a page that
    goes on in another task has a row in each."""
    k1, b, avgdl = packed.settings.k1, packed.settings.b, packed.avgdl
    kind = packed.counts.schema["page_id"].dataType.simpleString()

    def peaks(rows: pa.RecordBatch) -> pa.RecordBatch:
        page, chunk = (rows.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64) for c in KEYS)
        coded = sparse.flat_terms(rows.column("terms")).dictionary_encode()
        row = np.repeat(np.arange(rows.num_rows), rows.column("freqs").value_lengths().to_numpy())
        f, dl = rows.column("freqs").flatten().to_numpy().astype(np.float64), rows.column("dl").to_numpy().astype(np.float64)
        weight = f * (k1 + 1.0) / (f + k1 * ((1.0 - b) + b * dl / avgdl)[row])
        n, chunks = max(1, len(coded.dictionary)), int(chunk.max()) + 1
        key = (page[row] * n + coded.indices.to_numpy()) * chunks + chunk[row]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        own, key = np.add.reduceat(weight[order], first), key[order][first] // chunks
        first = np.flatnonzero(np.append(True, np.diff(key) != 0))
        at, code = np.divmod(key[first], n)
        begin = np.flatnonzero(np.append(True, np.diff(at) != 0))
        upto = pa.array(np.append(begin, len(at)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(upto, x) for x in (coded.dictionary.take(pa.array(code)).cast(pa.string()), _up(np.maximum.reduceat(own, first)), _up(np.add.reduceat(own, first)))]
        ids = rows.column("page_id").dictionary_encode(null_encoding="encode").dictionary.take(pa.array(at[begin]))
        return pa.RecordBatch.from_arrays([ids, pc.binary_join(lists[0], " "), *lists[1:]], ["page_id", "terms", "peaks", "totals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # of the last page, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            page = batch.column("page_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            last = np.flatnonzero(page != page[-1])
            cut = int(last[-1]) + 1 if len(last) else batch.num_rows
            yield peaks(batch.slice(0, cut))
            held = batch.slice(cut) if cut < batch.num_rows else None
        if held is not None:
            yield peaks(held)

    return packed.counts.select(*KEYS, "dl", "terms", "freqs").mapInArrow(run, f"page_id {kind}, terms string, peaks array<float>, totals array<float>")


def page_bounds(asked: sparse.Asked, peaks: DataFrame, alpha: float, topn: int) -> DataFrame:
    """(query_id, page_id, bound): what no page score exceeds.

    A page's best chunk has at most the sum of its terms' idf * peak. The mean of its best chunks is at most that, and at
    most the sum of idf * total by the number of chunks in the mean: for pages of up to ``topn`` chunks it is just that.
    """
    found = sparse.hits(asked, peaks, ["page_id", "n_chunks", "total"], "peak")
    sums = found.groupBy("query_id", "page_id", "n_chunks").agg(F.sum("part").alias("most"), F.sum(F.col("idf") * F.col("total")).alias("all"))
    mean = F.least(F.col("most"), F.col("all") / F.least(F.lit(topn), F.col("n_chunks")).cast("double"))
    return sums.select("query_id", "page_id", (F.lit(float(alpha)) * F.col("most") + F.lit(1.0 - alpha) * mean).alias("bound"))


def best_pages(queries: DataFrame, terms: DataFrame, postings: DataFrame, peaks: DataFrame | PagePeaks, pages: DataFrame, depth: int, alpha: float, topn: int, send: int = SEND, rest: Callable[[], DataFrame] | None = None) -> DataFrame:
    """(query_id, page_id, page_ord, score): page scores that hold each query's best ``depth`` pages, ties included.

    First the ``depth`` pages of the greatest bounds are scored; the least of these scores is what another page must
    reach, and of the others only those whose bound does are scored. Hits of all other pages are dropped where
    the postings are read, before the shuffle; what is shuffled in their place is a row for each term and page.

    Defined cases are those of ``sparse.scores`` and ``ranking.roll_up``; ``alpha`` lies between 0 and 1. A query with fewer
    than ``depth`` pages keeps all of them. Where pairs of query and page are more than ``send``, all hits are scored,
    or ``rest`` gives the scores. Few queries (see ``blocks.batch``) are bounded and scored in blocks of pages.
    """
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("bounds need an alpha between 0 and 1")
    asked = sparse.ask(queries, terms)
    batch = blocks.batch(asked)
    rest = rest or (lambda: scored(None))

    def scored(chosen: DataFrame | None) -> DataFrame:
        if chosen is not None and batch is not None:
            few = postings.join(F.broadcast(chosen.select("page_id").distinct()), "page_id", "left_semi")
            return blocks.best_pages(batch, few, pages, depth, alpha, topn, chosen, every=True)
        found = sparse.hits(asked, postings, KEYS)
        if chosen is not None:
            found = found.alias("h").join(F.broadcast(chosen).alias("c"), _same("h", "c"), "left_semi")
        return ranking.roll_up(found.groupBy("query_id", *KEYS).agg(F.sum("part").alias("score")), pages, alpha, topn)

    if batch is None:
        rows = peaks.rows(pages) if isinstance(peaks, PagePeaks) else peaks
        bounds = materialize(page_bounds(asked, rows, alpha, topn), "page-bounds")
    else:
        bounds = blocks.first_pairs(batch, peaks, pages, depth, alpha, topn)
    order = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "page_id")
    first = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth).select("query_id", "page_id")
    first = materialize(first, "first-pairs")
    if not _few(first, send):
        return rest()
    early = materialize(scored(first), "first-pages")
    least = ranking.rank(early, depth).where(F.col("rank") == depth).select(F.col("query_id").alias("q"), (F.col("score") - F.lit(SLACK)).alias("least"))
    if batch is None:
        others = bounds.join(F.broadcast(least), F.col("query_id").eqNullSafe(F.col("q")), "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
    else:
        with freed_shuffles(queries.sparkSession):
            n = blocks.open_pairs(batch, peaks, pages, least, alpha, topn, count=True).agg(F.sum("n")).first()[0] or 0
        if n - first.count() > send:
            return rest()
        others = blocks.open_pairs(batch, peaks, pages, least, alpha, topn, count=False)
    others = others.alias("h").join(F.broadcast(first).alias("c"), _same("h", "c"), "left_anti").select("query_id", "page_id")
    others = materialize(others, "open-pairs")
    return early.unionByName(scored(others)) if _few(others, send) else rest()


def _same(a: str, b: str) -> Column:
    """The same query, the one without an id too, and the same page."""
    return F.col(f"{a}.query_id").eqNullSafe(F.col(f"{b}.query_id")) & (F.col(f"{a}.page_id") == F.col(f"{b}.page_id"))


def _few(pairs: DataFrame, send: int) -> bool:
    n, size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("query_id").cast("string"))), F.lit(0))).first()
    return n <= send and size <= SEND_BYTES

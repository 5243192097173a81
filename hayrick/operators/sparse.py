"""BM25 over any table of units: postings with saturated term weights, and scores of queries against them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hayrick.config import DEFAULT, Settings
from hayrick.functions import text as T
from hayrick.session import materialize, write

#: Query terms (rows of query_id and term) up to this number are sent to the postings; a row takes about 100 bytes.
BROADCAST_ROWS = 500_000
#: And their terms together up to so many bytes.
BROADCAST_BYTES = 64 << 20
SALTS = 32
#: Distinct terms that a task counts units of before it hands them over.
ROWS = 200_000
#: Bytes of the texts that are cut into terms together.
CUT = 1 << 20
#: Folders of a saved table of terms, by the term's hash.
BUCKETS = 64
#: Groups of shards that are shuffled together.
GROUPS = 16
#: Postings that a task sorts by term, on average, and the longest list of a term that is written in one row.
PART, RUN = 2_000_000, 10_000
#: Postings that are shuffled at a time when an index is saved.
PASS = 1_000_000_000
#: Distinct query terms up to this number are named in the filter of a saved table, so that other folders are not read.
LITERALS = 10_000


def _terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts of ``spaced_bytes``, one after another, and how many each text has."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    word = data != 32
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, upto = edges[::2], np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - start, out=upto[1:])
    sizes = np.diff(np.searchsorted(start, np.cumsum([0, *[len(x) + 1 for x in texts]])))
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(upto), pa.py_buffer(data[word])]), sizes


def _counted(keys: pa.RecordBatch, texts: list[bytes], known: pa.Array | None) -> pa.RecordBatch:
    flat, sizes = _terms_of(texts)
    row = np.repeat(np.arange(len(texts)), sizes)
    if known is None:
        coded = flat.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy()
    else:
        at = pc.index_in(flat, value_set=known)
        terms, code, row = known, at.drop_null().to_numpy(), row[at.is_valid().to_numpy(zero_copy_only=False)]
    pair = np.sort(row * max(1, len(terms)) + code)
    first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
    freqs = pa.array(np.diff(first, append=len(pair)).astype(np.int32))
    row, code = np.divmod(pair[first], max(1, len(terms)))
    upto = pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32))
    own = pc.binary_join(pa.ListArray.from_arrays(upto, terms.take(pa.array(code))), " ")
    columns = [pa.array(sizes), pa.array(sizes), pc.if_else(pc.not_equal(own, ""), own, pa.scalar(None, pa.string())), pa.ListArray.from_arrays(upto, freqs)]
    every = pa.RecordBatch.from_arrays([*keys.columns, *columns], [*keys.schema.names, "dl", "tokens", "terms", "freqs"])
    return every.filter(pa.array(sizes > 0))


def _packed(batches: Iterator[pa.RecordBatch], known: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (keys, _t), texts for ``spaced_bytes``, to rows (keys, dl, tokens, terms, freqs); texts without terms go. With ``known``
    other terms count for the length alone, and a text that has none of these has null terms. Some texts are cut at a time."""
    for batch in batches:
        keys = batch.select([c for c in batch.schema.names if c != "_t"])
        held, size = [], 0
        for i, text in enumerate(batch.column("_t")):
            held.append(T.spaced_bytes(text.as_py()))
            size += len(held[-1])
            if size >= CUT or i + 1 == batch.num_rows:
                yield _counted(keys.slice(i + 1 - len(held), len(held)), held, known)
                held, size = [], 0


def _rows(units: DataFrame, keys: list[str], text: str, known: DataFrame | None = None) -> DataFrame:
    spaced = units.select(*keys, T.spaced_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    own = t.StructType().add("dl", "long").add("tokens", "long").add("terms", "string").add("freqs", t.ArrayType(t.IntegerType()))
    run = _packed
    if known is not None:
        sent = units.sparkSession.sparkContext.broadcast(known.select("term").toArrow()["term"].combine_chunks().cast(pa.string()))
        run = lambda batches: _packed(batches, sent.value)
    return spaced.mapInArrow(run, t.StructType([*units.select(*keys).schema, *own]))


def _repeat(units: DataFrame, keys: list[str]) -> bool:
    return units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count() > 0


def term_counts(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, dl, term, freq): the terms of every unit. A unit without terms has no rows.

    Terms are counted inside the unit's row, without a shuffle. Only where keys repeat (which is looked up first, in the keys
    alone) rows of the same keys and length are added up.
    """
    rows = unpack(_rows(units, keys, text), keys)
    return rows.groupBy(*keys, "dl", "term").agg(F.sum("freq").alias("freq")) if _repeat(units, keys) else rows


def packed_counts(units: DataFrame, keys: list[str], text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(keys, dl, tokens, terms, freqs): ``term_counts`` with the terms of a unit in one row, with spaces between, and how often
    each occurs. ``tokens`` is the sum of the latter.

    ``known`` (term), few rows, are the terms that anything is asked about: others may be left out of ``terms`` (null where none
    is left) and ``freqs``, and count in ``dl`` and ``tokens`` all the same. Where keys repeat all terms stay.
    """
    if not _repeat(units, keys):
        return _rows(units, keys, text, known)
    own = F.collect_list(F.struct("term", F.col("freq").cast("int").alias("freq"))).alias("_r")
    rows = term_counts(units, keys, text).groupBy(*keys, "dl").agg(F.sum("freq").alias("tokens"), own)
    return rows.select(*keys, "dl", "tokens", F.array_join("_r.term", " ").alias("terms"), F.col("_r.freq").alias("freqs"))


def unpack(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dl, term, freq): a row for each term of ``packed_counts``."""
    rows = packed.select(*keys, "dl", "freqs", F.posexplode(F.split("terms", " ")).alias("_i", "term"))
    return rows.select(*keys, "dl", "term", F.get("freqs", "_i").cast("bigint").alias("freq"))


def flat_terms(terms: pa.Array) -> pa.Array:
    """The terms of all units of ``packed_counts``, one after another."""
    return pc.list_flatten(pc.split_pattern(terms, " "))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (terms) to rows (term, df) that add up to the number of units with each term."""
    held, n = [], 0

    def pack() -> list[pa.RecordBatch]:
        return pa.concat_tables(held).group_by("term").aggregate([("df", "sum")]).select(["term", "df_sum"]).rename_columns(["term", "df"]).to_batches()

    for batch in batches:
        own = pc.value_counts(flat_terms(batch.column(0)))
        held.append(pa.table({"term": own.field(0), "df": own.field(1)}))
        n += len(own)
        if n >= ROWS:
            yield from pack()
            held, n = [], 0
    if held:
        yield from pack()


def frequencies(packed: DataFrame) -> DataFrame:
    """(term, df): how many units of ``packed_counts`` have each term."""
    return packed.select("terms").mapInArrow(_summed, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def length_stats(units: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, avgdl): all units count, also those without terms; an empty table has avgdl 1."""
    dl = F.size(T.tokenize(F.coalesce(F.col(text), F.lit(""))))
    return units.select(dl.alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def with_idf(df: DataFrame, n: int) -> DataFrame:
    """Terms with ``df``, the number of units that have them, and their ``idf`` among ``n`` units."""
    d = F.col("df").cast("double")
    return df.withColumn("idf", F.log((F.lit(float(n)) - d + F.lit(0.5)) / (d + F.lit(0.5)) + F.lit(1.0)))


def weights(counts: DataFrame, avgdl: float, settings: Settings = DEFAULT) -> DataFrame:
    """``counts`` with ``tf_weight``, the saturated term frequency."""
    f, dl = F.col("freq").cast("double"), F.col("dl").cast("double")
    norm = F.lit(settings.k1) * (F.lit(1.0 - settings.b) + F.lit(settings.b) * dl / F.lit(float(avgdl)))
    return counts.withColumn("tf_weight", f * F.lit(settings.k1 + 1.0) / (f + norm))


def _shards(terms: pa.Array) -> np.ndarray:
    """``shard_of`` distinct terms."""
    return np.fromiter((zlib.crc32(x.as_buffer()) % BUCKETS for x in terms), np.int64, len(terms))


@dataclass
class Packed:
    """Written ``packed_counts`` of all units and what their weights take."""

    counts: DataFrame
    keys: list[str]
    avgdl: float
    settings: Settings

    def postings(self) -> DataFrame:
        return weights(unpack(self.counts, self.keys), self.avgdl, self.settings).select("term", *self.keys, "tf_weight")

    def of_numbers(self, number: Callable[[], dict[str, int]], first: list[Column]) -> tuple[DataFrame, Callable]:
        """Columns ``first`` with the counts of each unit, and a function of their Arrow batches: rows of ``first`` with t, the
        number of a term, and its tf_weight, for the terms that ``number`` knows."""
        k1, b, avgdl = self.settings.k1, self.settings.b, self.avgdl

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers = number()
            terms, of = pa.array(list(numbers), pa.string()), np.fromiter(numbers.values(), np.int32, len(numbers))
            for batch in batches:
                flat = flat_terms(batch.column("terms"))
                at = pc.index_in(flat, value_set=terms.cast(flat.type))
                known = at.is_valid().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), batch.column("freqs").value_lengths().to_numpy())[known]
                ts, f = of[at.drop_null().to_numpy()], batch.column("freqs").flatten().to_numpy()[known].astype(np.float64)
                norm = k1 * ((1.0 - b) + b * batch.column("dl").to_numpy().astype(np.float64) / avgdl)
                kept = batch.select([c for c in batch.schema.names if c not in ("dl", "terms", "freqs")])
                kept = kept.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ts), pa.array(f * (k1 + 1.0) / (f + norm[row]))], [*kept.schema.names, "t", "tf_weight"])

        return self.counts.select(*first, "dl", "terms", "freqs"), run

    #: What ``of_numbers`` reads besides the columns ``first``, and what it gives for it besides t.
    reads, gives = ("dl", "terms", "freqs"), ("tf_weight",)

    def by_shard(self, parts: int, passes: int, k: int) -> DataFrame:
        """(cell, terms, at, keys, tf_weight): the postings of a group of shards and a part of the units, those of some thousand
        units in a row, in their order: repeated keys and weights stand side by side and take little when they are shuffled.
        ``at`` counts into ``terms``. Of ``passes`` passes over the groups this is number ``k``."""
        k1, b, avgdl, keys = self.settings.k1, self.settings.b, self.avgdl, self.keys

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = flat_terms(batch.column("terms")).dictionary_encode()
                group = _shards(coded.dictionary) % GROUPS
                code = coded.indices.to_numpy()
                row = np.repeat(np.arange(batch.num_rows), batch.column("freqs").value_lengths().to_numpy())
                f, dl = batch.column("freqs").flatten().to_numpy().astype(np.float64), batch.column("dl").to_numpy().astype(np.float64)
                cell = group[code] * parts + batch.column("part").to_numpy()[row]
                own = np.flatnonzero(group[code] % passes == k)
                order = own[np.argsort(cell[own], kind="stable")]
                cell, code, row = cell[order], code[order], row[order]
                weight = f[order] * (k1 + 1.0) / (f[order] + k1 * ((1.0 - b) + b * dl / avgdl)[row])
                start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
                upto = np.append(start, len(cell)).astype(np.int32)
                found = [np.unique(code[x:y], return_inverse=True) for x, y in zip(upto[:-1], upto[1:], strict=True)]
                ends = np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32)
                names, at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in ([u for u, _ in found], [i for _, i in found]))
                terms = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(names)).cast(pa.string())), " ")
                lists = [pa.ListArray.from_arrays(pa.array(upto), x) for x in [pa.array(at.astype(np.int32)), *(batch.column(c).take(pa.array(row)) for c in keys), pa.array(weight)]]
                yield pa.RecordBatch.from_arrays([pa.array(cell[start].astype(np.int32)), terms, *lists], ["cell", "terms", "at", *keys, "tf_weight"])

        lists = [t.StructField(c, t.ArrayType(kind)) for c, kind in [("at", t.IntegerType()), *self._kinds()]]
        schema = t.StructType([t.StructField("cell", t.IntegerType()), t.StructField("terms", t.StringType()), *lists])
        part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
        return self.counts.select(*keys, "dl", "terms", "freqs", part).mapInArrow(run, schema)

    def by_term(self, parts: int, passes: int, k: int) -> DataFrame:
        """(shard, term, keys, tf_weight): the same, sorted by shard and term, a term's keys and weights in lists of up to RUN."""
        columns = [c for c, _ in self._kinds()]

        def run(rows: pa.Table) -> pa.Table:
            many = pc.list_value_length(pc.split_pattern(rows["terms"], " ")).to_numpy()
            before = np.repeat(np.cumsum(many) - many, pc.list_value_length(rows["at"]).to_numpy())
            coded = pa.concat_arrays(flat_terms(rows["terms"]).chunks).dictionary_encode()
            by_name = pc.sort_indices(coded.dictionary).to_numpy()
            shard = _shards(coded.dictionary)
            by_name = by_name[np.argsort(shard[by_name], kind="stable")]
            place = np.empty(len(by_name), np.int64)
            place[by_name] = np.arange(len(place))
            code = place[coded.indices.to_numpy()][before + pc.list_flatten(rows["at"]).to_numpy()]
            order = np.argsort(code, kind="stable")
            code = code[order]
            fresh = np.append(True, code[1:] != code[:-1])
            since = np.arange(len(code)) - np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))
            start = np.flatnonzero(since % RUN == 0)
            upto = pa.array(np.append(start, len(code)).astype(np.int32))
            names = by_name[code[start]]
            lists = [pa.ListArray.from_arrays(upto, pc.list_flatten(rows[c]).combine_chunks().take(pa.array(order))) for c in columns]
            return pa.table([pa.array(shard[names].astype(np.int32)), coded.dictionary.take(pa.array(names)).cast(pa.string()), *lists], ["shard", "term", *columns])

        schema = t.StructType([t.StructField("shard", t.IntegerType()), t.StructField("term", t.StringType()), *(t.StructField(c, t.ArrayType(kind)) for c, kind in self._kinds())])
        return self.by_shard(parts, passes, k).groupBy("cell").applyInArrow(run, schema)

    def _kinds(self) -> list[tuple[str, t.DataType]]:
        return [*((c, self.counts.schema[c].dataType) for c in self.keys), ("tf_weight", t.DoubleType())]


def build_packed(units: DataFrame, keys: list[str], text: str = "text", settings: Settings = DEFAULT, known: DataFrame | None = None) -> tuple[DataFrame, Packed]:
    """(terms, packed): the sparse index. Texts are tokenised once; the counts are written, a row for each unit, and everything
    else, the mean length included, comes from them. ``units`` is read once more for its number of rows alone. ``known`` is that
    of ``packed_counts``: df, idf and weights of these terms are those of the whole index."""
    counts = materialize(packed_counts(units, keys, text, known), "term-counts")
    n = units.count()
    tokens = counts.agg(F.sum("tokens")).first()[0] or 0
    return with_idf(frequencies(counts), n), Packed(counts, keys, tokens / n if n else 1.0, settings)


def build(units: DataFrame, keys: list[str], text: str = "text", settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(terms, postings): the index of ``build_packed`` with a row for each posting."""
    terms, packed = build_packed(units, keys, text, settings)
    return terms, packed.postings()


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def shard_of(term: Column) -> Column:
    """The folder of a term among those of ``save_postings``, which Python tasks can tell as well."""
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(BUCKETS)).cast("int")


def save_by_term(rows: DataFrame, path: str) -> None:
    """Writes rows with a term in a folder for each bucket, sorted by term.

    Rows are dealt by ranges of bucket, term and all other columns, so a term that many units hold is cut into several
    files, and a task writes few of them.
    """
    rest = [c for c in rows.columns if c != "term"]
    placed = rows.withColumn("bucket", bucket_of(F.col("term")))
    write(placed.repartitionByRange("bucket", "term", *rest).sortWithinPartitions("bucket", "term"), path, "overwrite", ["bucket"])


def save_postings(packed: Packed, total: int, path: str) -> None:
    """Writes ``packed.by_term`` in a folder for each shard, sorted by term; ``total`` is the number of postings.

    Lists are shuffled and written, not single postings. A group's lists are dealt to parts by unit, so a term that many
    units hold is cut into several files. Of more than PASS postings some groups are written at a time, so that what
    lies shuffled on the disks does not grow with the table until each group has its own pass.
    """
    parts, passes = -(-total // (GROUPS * PART)) or 1, min(GROUPS, -(-total // PASS) or 1)
    for k in range(passes):
        write(packed.by_term(parts, passes, k).sortWithinPartitions("shard", "term"), path, "append" if k else "overwrite", ["shard"])


def saved_postings(rows: DataFrame) -> DataFrame:
    """(term, shard, keys, tf_weight): a row for each posting that ``save_postings`` wrote; what ``save_by_term`` wrote stays."""
    lists = [f.name for f in rows.schema if isinstance(f.dataType, t.ArrayType)]
    if not lists:
        return rows
    return rows.select("term", "shard", F.inline(F.arrays_zip(*lists)))


def of_terms(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of a table of terms that can match ``asked`` (term): of a saved table only the folders of those terms are
    read, and in them the row groups that can hold one. More than LITERALS distinct terms touch most of it anyway."""
    folder = next((c for c in ("bucket", "shard") if c in rows.columns), None)
    if folder is None:
        return rows
    own = bucket_of(F.col("term")) if folder == "bucket" else shard_of(F.col("term"))
    found = asked.select("term", own.alias(folder)).distinct().limit(LITERALS + 1).collect()
    if len(found) <= LITERALS:
        rows = rows.where(F.col(folder).isin(sorted({r[folder] for r in found})) & F.col("term").isin([r["term"] for r in found]))
    return rows.drop(folder)


def query_terms(queries: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, term): each query's terms, once each."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokenize(F.coalesce(F.col(text), F.lit(""))))).alias("term"))


def few_terms(queries: DataFrame, text: str = "query") -> DataFrame | None:
    """(term): the distinct terms of queries, written once, or none where they are too many to be sent to the texts."""
    terms = materialize(query_terms(queries, text).select("term").distinct(), "asked-terms")
    n, size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return terms if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else None


@dataclass
class Asked:
    """The terms of a batch of queries: ``terms`` (query_id, term), ``known`` those of them that the index has, with idf and
    df, and whether they are few enough to be sent to the postings."""

    terms: DataFrame
    known: DataFrame
    few: bool


def ask(queries: DataFrame, terms: DataFrame, text: str = "query", broadcast_rows: int = BROADCAST_ROWS) -> Asked:
    """Query terms with their IDF, written once. They count as few by rows (``broadcast_rows``) and by bytes."""
    asked = materialize(query_terms(queries, text), "query-terms")
    n, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    few = n <= broadcast_rows and size <= BROADCAST_BYTES
    known = of_terms(terms, asked).select("term", "idf", "df").join(F.broadcast(asked) if few else asked, "term")
    return Asked(asked, materialize(known, "query-idf"), few)


def hits(asked: Asked, postings: DataFrame, keys: list[str], weight: str = "tf_weight") -> DataFrame:
    """(query_id, keys, idf, part): what each posting (term, keys, weight) of a query's term adds to its score.

    Tables that ``save_by_term`` wrote are read for the terms of the queries alone. Few query terms go to the postings,
    which stay where they lie; more are joined by term and salt, so that a term that a third of all units hold is dealt
    to SALTS tasks.
    """
    postings = of_terms(postings, asked.terms)
    if asked.few:
        found = postings.join(F.broadcast(asked.known), "term")
    else:
        known = asked.known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = postings.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(known, ["term", "_salt"])
    return found.select("query_id", *keys, "idf", (F.col("idf") * F.col(weight)).alias("part"))


def scores(queries: DataFrame, terms: DataFrame, postings: DataFrame, keys: list[str], text: str = "query", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, keys, score) of every unit that shares a term with the query: the sums of its ``hits``.

    Defined cases: a null or empty query, and terms that no unit has, match nothing; a term that a query repeats counts
    once; rows that repeat a query_id add up; an empty index gives an empty result.
    """
    return score(ask(queries, terms, text, broadcast_rows), postings, keys)


def score(asked: Asked, postings: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys, score): the sums of the ``hits`` of a batch."""
    found = hits(asked, postings, keys)
    return found.groupBy("query_id", *keys).agg(F.sum("part").alias("score"))

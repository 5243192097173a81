"""The operators as steps over ``documents``: each takes rows and returns rows with the same columns (but the last)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm import bpe, mixing, neardup, pii, quality_rules
from hayrick.session import materialize


def _ids_tell_rows_apart(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty()


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """(n, the columns, row): a number for every row and the row itself, so that no other column can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return materialize(docs.select(F.monotonically_increasing_id().alias("n"), *columns, whole), "stage-rows")


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that the quality rules keep.

    Defined cases: null and empty texts go; repeated rows are kept or go alike; other columns, whatever their names, pass
    through with their nulls; an empty table stays empty.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))  # no name can clash
    return quality_rules.judge(packed, "_text").where("kept").select("_row.*")


def keep_one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Where ids repeat or are null, rows are told apart by a number: each row is linked by its own text alone, and of a
    group's rows that share the smallest id one stays; null ids come last. Null, empty and blank texts are linked with
    nothing and stay; an empty table stays empty.
    """
    if _ids_tell_rows_apart(docs):
        found = materialize(neardup.near_duplicates(docs, words, percent), "stage-groups")
        gone = found.where("doc_id <> component_id").select("doc_id")
        # The removed ids grow with the corpus, so they are never broadcast.
        return docs.hint("merge").join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = _packed(docs, "doc_id", "text")
    found = neardup.near_duplicates(rows, words, percent, id_col="n").select(F.col("doc_id").alias("n"), "component_id")
    ids = rows.select("n", F.struct(F.col("doc_id").isNull(), "doc_id", "n").alias("first"))
    first = ids.hint("merge").join(found, "n").groupBy("component_id").agg(F.min("first").alias("first"))
    stay = materialize(first.select(F.col("first.n").alias("n")), "stage-groups")
    return rows.hint("merge").join(stay, "n", "left_semi").select("row.*")


def hide_private(docs: DataFrame) -> DataFrame:
    """All documents, personal data and secrets in their texts replaced by the kind in brackets.

    Defined cases: null and empty texts stay as they are; repeated rows are changed alike; other columns pass through, so
    n_chars still tells the length before; an empty table stays empty.
    """
    return pii.redact(docs)


def take_mix(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times); copies are equal rows.

    Defined cases: null and empty texts have no words and are never taken; a null source is a source of its own; rows that
    repeat an id or have none are told apart by a number; an empty table stays empty.
    """
    if _ids_tell_rows_apart(docs):
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = docs.select(F.col("doc_id").alias("n"), "text", "source", whole)
    else:
        rows = _packed(docs, "text", "source")
    mixed = mixing.mix(rows, id_col="n").where("copies > 0").select(F.col("doc_id").alias("n"), "copies")
    taken = rows.join(mixed, "n")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")


def encode(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, ids, ends): token ids of each text with the byte at which each token ends.

    Defined cases: null and empty texts have no tokens; repeated rows are encoded each; null ids stay null; an empty table
    stays empty.
    """
    return bpe.encode(docs, rank_file)

"""Pages to overlapping, section-aware chunks. Everything happens inside a page's row: nothing is shuffled.

The whole way from a page's text to its chunks is one expression whose intermediate arrays are bound with ``let``, and
rows are dropped only after the array is exploded: a filter on a computed array would be pushed below the projection
together with a copy of the expression. Folds gather their results by blocks (``scan``), so a page of very many
sentences costs no quadratic copying.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayrick.config import DEFAULT, Settings
from hayrick.functions import headers as H
from hayrick.functions import text as T

_BLOCK = 256


def scan(values: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """The outputs of a fold over an array: ``step(state, x)`` gives the next state and one output of type ``kind``.

    Outputs are appended within blocks and the blocks to each other, which copies n * sqrt(n) elements at most.
    """

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["s"], x)
        return T.let(F.struct(state.alias("s"), out.alias("o")), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["o"])).alias("out")))

    def block(acc: Column, i: Column) -> Column:
        zero = F.struct(acc["s"].alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
        part = F.aggregate(F.slice(values, i * _BLOCK + 1, F.lit(_BLOCK)), zero, one)
        return T.let(part, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    zero = F.struct(start.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _BLOCK).cast("int"))
    return F.when(F.size(values) > 0, F.aggregate(blocks, zero, block, lambda a: F.flatten(a["out"]))).otherwise(F.array().cast(f"array<{kind}>"))


def sections(content: Column) -> Column:
    """A page's text as a struct: ``sents`` (text, word count, section, starts a paragraph) and ``names`` of sections
    (0 is the lead)."""

    def peel(paragraph: Column) -> Column:
        return T.let(T.sentences(paragraph), lambda parts: F.struct(parts.alias("parts"), H.body_size(parts).alias("n")))

    def assemble(paras: Column) -> Column:
        def place(at: Column) -> Column:
            def body(p: Column, i: Column) -> Column:
                own = F.slice(p["parts"], F.lit(1), p["n"])
                return F.transform(own, lambda s, j: F.struct(s.alias("text"), T.word_count(s).alias("wc"), F.get(at["sec"], i).alias("sec"), ((j == 0) & (i > at["lead"])).alias("forced")))

            heads = lambda p: F.transform(F.slice(p["parts"], p["n"] + 1, F.size(p["parts"]) - p["n"]), H.header_text)
            return F.struct(
                F.flatten(F.transform(paras, body)).alias("sents"),
                F.concat(F.array(F.lit("")), F.flatten(F.transform(paras, heads))).alias("names"),
            )

        sec = scan(paras, F.lit(0), lambda s, p: (s + F.size(p["parts"]) - p["n"], s), "int")
        lead = F.array_min(F.transform(paras, lambda p, i: F.when(p["n"] > 0, i)))
        return T.let(F.struct(sec.alias("sec"), lead.alias("lead")), place)

    paras = F.filter(F.transform(T.paragraphs(F.coalesce(content, F.lit(""))), peel), lambda p: F.size(p["parts"]) > 0)
    return T.let(paras, assemble)


def with_sentences(pages: DataFrame) -> DataFrame:
    """Adds ``sents`` and ``names`` of ``sections``; a page without sentences keeps its row, with empty arrays."""
    rows = pages.withColumn("_sections", sections(F.col("content")))
    return rows.withColumns({"sents": F.col("_sections.sents"), "names": F.col("_sections.names")}).drop("_sections")


def pack(counts: Column, most: int = DEFAULT.max_words) -> Column:
    """Segment number of every sentence: greedy packing up to ``most`` words, a longer sentence standing alone."""

    def step(state: Column, wc: Column) -> tuple[Column, Column]:
        joins = (wc <= most) & state["open"] & (state["w"] + wc <= most)
        seg = F.when(joins, state["seg"]).otherwise(state["seg"] + 1)
        words = F.when(wc > most, F.lit(0)).when(joins, state["w"] + wc).otherwise(wc)
        return F.struct(seg.alias("seg"), words.alias("w"), (wc <= most).alias("open")), seg

    return scan(counts, F.struct(F.lit(-1).alias("seg"), F.lit(0).alias("w"), F.lit(False).alias("open")), step, "int")


def segments(sents: Column, most: int) -> Column:
    """(start, end) of every run of sentences that are packed together."""

    def ends(starts: Column, size: Column) -> Column:
        return F.transform(starts, lambda a, i: F.struct(a.alias("start"), F.coalesce(F.get(starts, i + 1), size).alias("end")))

    def cut(seg: Column) -> Column:
        first = F.transform(seg, lambda s, i: F.when((i == 0) | (s != F.get(seg, i - 1)), i))
        return T.let(F.filter(first, lambda i: i.isNotNull()), lambda starts: ends(starts, F.size(seg)))

    return T.let(T.let(F.transform(sents, lambda s: s["wc"]), lambda counts: pack(counts, most)), cut)


def with_segments(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Adds ``sents``, ``names`` and ``segments``, empty where a page has no sentences."""
    return with_sentences(pages).withColumn("segments", segments(F.col("sents"), settings.max_words))


def chunk_pages(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row per chunk: page_id, chunk_id, text, title, section, section_number, numbers, word_count, page_ord.

    ``pages`` has page_id, title, content and page_ord. Each segment borrows one sentence per side, never across a
    paragraph break and never a long one; pieces of a long sentence stand unpadded.

    Defined cases: a null title counts as empty; null, empty or blank content gives no chunks; pages that repeat an id
    are chunked each; other columns are ignored; an empty table gives an empty result.
    """
    most = settings.max_words
    none = F.array().cast("array<string>")

    def bodies(page: Column, seg: Column) -> Column:
        sents, end = page["sents"], seg["end"]
        first = F.get(sents, seg["start"])
        before, after = F.get(sents, seg["start"] - 1), F.get(sents, end)
        left = F.when((seg["start"] > 0) & ~first["forced"] & (before["wc"] <= most), F.array(before["text"])).otherwise(none)
        right = F.when((end < F.size(sents)) & ~after["forced"] & (after["wc"] <= most), F.array(after["text"])).otherwise(none)
        core = F.transform(F.slice(sents, seg["start"] + 1, end - seg["start"]), lambda s: s["text"])
        whole = F.array(F.array_join(F.concat(left, core, right), " "))
        made = F.when(first["wc"] > most, T.sliding_split(first["text"], most, settings.overlap_words)).otherwise(whole)
        section = F.coalesce(F.get(page["names"], first["sec"]), F.lit(""))
        return F.transform(made, lambda b: F.struct(T.strip(b).alias("body"), first["sec"].alias("sec"), section.alias("section")))

    def chunks(page: Column) -> Column:
        return T.let(segments(page["sents"], most), lambda segs: F.flatten(F.transform(segs, lambda seg: bodies(page, seg))))

    made = T.let(sections(F.col("content")), chunks)
    rows = pages.select("page_id", F.coalesce("title", F.lit("")).alias("title"), "page_ord", made.alias("_chunks"))
    # posexplode_outer: the plain one would have its input tested for emptiness before, by a second evaluation.
    rows = rows.select("page_id", "title", "page_ord", F.posexplode_outer("_chunks").alias("chunk_id", "c")).where("c.body <> ''")
    text = F.concat(F.lit("["), F.col("title"), F.lit("] "), F.col("c.body"))
    return rows.select(
        "page_id",
        F.col("chunk_id").cast("int").alias("chunk_id"),
        text.alias("text"),
        "title",
        F.col("c.section").alias("section"),
        F.col("c.sec").alias("section_number"),
        T.numbers(F.col("c.body")).alias("numbers"),
        T.word_count(text).alias("word_count"),
        "page_ord",
    )

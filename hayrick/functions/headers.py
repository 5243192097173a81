"""Recovery of section headings that were flattened to short sentences at the end of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hayrick.functions import text as T

MAX_WORDS = 6
# Words that may stay lower-case in a title, and words that mark a sentence.
FUNCTION_WORDS = "a an the of and or for in on to at by with as from de la le vs per".split()
AUXILIARIES = "is was were are am be been being has have had do does did will would shall should can could may might must".split()
PRONOUNS = "it its he him his she her they them their we us our you your this that these those who which".split()


def _upper(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}")


def _lower(c: Column) -> Column:
    return c.rlike(r"^\p{Ll}")


def _bare(sentence: Column) -> Column:
    return F.rtrim(sentence, F.lit("."))


def mixed_capitals(sentence: Column) -> Column:
    """A capital inside beside lower-case content words: neither sentence case nor title case."""
    w = T.words(_bare(sentence))
    inner = F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    free = lambda t: F.lower(t).isin(FUNCTION_WORDS)
    capital_inside = F.exists(inner, _upper)
    title = F.forall(w, lambda t: _upper(t) | free(t)) & ~F.exists(inner, lambda t: _lower(t) & ~free(t))
    return (F.size(w) > 1) & capital_inside & ~title


def has_stopword(sentence: Column) -> Column:
    stops = AUXILIARIES + PRONOUNS
    return F.exists(T.words(_bare(sentence)), lambda t: F.btrim(F.lower(t), F.lit("().,")).isin(stops))


def is_header(sentence: Column) -> Column:
    n = T.word_count(sentence)
    return (
        _upper(sentence)
        & sentence.endswith(".")
        & ~sentence.contains('"')
        & (F.length(_bare(sentence)) > 2)
        & n.between(1, MAX_WORDS)
        & ~has_stopword(sentence)
        & ~mixed_capitals(sentence)
    )


def header_text(sentence: Column) -> Column:
    return T.strip(_bare(sentence))


def body_size(parts: Column) -> Column:
    """How many of a paragraph's sentences are left when the headings at its end are peeled off."""
    ends = F.transform(parts, lambda s, i: F.when(is_header(s), F.lit(0)).otherwise(i + 1))
    return F.coalesce(F.array_max(ends), F.lit(0))

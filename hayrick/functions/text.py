r"""Text functions as column expressions.

Character classes are spelled out so that every engine agrees on them: word characters are letters, numbers and the
underscore; white space is the Unicode set with the four ASCII separators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes and splitting patterns.
NOT_WORD = r"[^\p{L}\p{N}_]+"
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
PARAGRAPH = rf"\n{WS}*\n+"
SENTENCE = rf"""(?<=[.!?]){WS}+(?=[A-Z"'(])"""


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once. Inside a lambda a plain column expression would run per element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def not_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def words(text: Column) -> Column:
    """White-space separated words."""
    return not_empty(F.split(text, f"{WS}+"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def raw_tokens(text: Column) -> Column:
    """Runs of word characters, in their own case."""
    return not_empty(F.split(text, NOT_WORD))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of word characters: the terms of the sparse index."""
    return raw_tokens(F.lower(text))


#: What ``tokenize`` makes of Latin-1 characters, byte by byte.
_PLAIN = "".join(c.lower() if c.isalnum() or c == "_" else " " for c in map(chr, range(256))).encode("latin-1")


def spaced_tokens(text: Column) -> Column:
    """A text for ``spaced_terms``: the terms of ``tokenize`` with white space between, or the text itself if it is Latin-1. ASCII
    texts, which have as many bytes as characters, are not searched."""
    return F.when((F.octet_length(text) != F.length(text)) & text.rlike(r"[^\x00-\xff]"), F.regexp_replace(F.lower(text), NOT_WORD, " ")).otherwise(text)


def spaced_bytes(text: str) -> bytes:
    """The terms of ``spaced_terms`` in UTF-8, with spaces and nothing else around them."""
    try:
        return text.encode("latin-1").translate(_PLAIN).decode("latin-1").encode()
    except UnicodeEncodeError:
        return text.encode()


def spaced_terms(text: str) -> list[str]:
    """The terms of ``tokenize`` from a value of ``spaced_tokens``, in a Python task. A value whose terms are Latin-1 already
    stays as it is under the table."""
    try:
        return text.encode("latin-1").translate(_PLAIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return text.split()


def _canonical(digits: Column) -> Column:
    bare = F.ltrim(digits, F.lit("0"))
    return F.when(bare == "", "0").otherwise(bare)


def numbers(text: Column) -> Column:
    """Distinct all-digit tokens as digit strings without leading zeros, in numeric order (any length). A text without a
    digit is not cut into tokens."""
    found = F.array_distinct(F.transform(F.filter(raw_tokens(text), lambda t: t.rlike(r"^\p{Nd}+$")), _canonical))
    sized = F.sort_array(F.transform(found, lambda n: F.struct(F.length(n).alias("size"), n.alias("n"))))
    return F.when(~text.rlike(r"\p{Nd}"), F.array().cast("array<string>")).otherwise(F.transform(sized, lambda s: s["n"]))


def query_numbers(text: Column) -> Column:
    """Numbers of a query; a decade such as 1820s also stands for its ten years."""
    decades = F.filter(raw_tokens(text), lambda t: t.rlike(r"^[0-9]{3,4}0s$"))
    years = F.flatten(F.transform(decades, lambda t: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.rtrim(t, F.lit("s")).cast("bigint") + i).cast("string"))))
    return F.array_union(numbers(text), years)


def paragraphs(text: Column) -> Column:
    return not_empty(F.transform(F.split(text, PARAGRAPH), strip))


def sentences(paragraph: Column) -> Column:
    return not_empty(F.transform(F.split(paragraph, SENTENCE), strip))


def sliding_split(sentence: Column, width: int = 120, overlap: int = 40) -> Column:
    """Windows of ``width`` words over a longer sentence, the last one ending with it; else the sentence itself."""

    def split(w: Column) -> Column:
        n = F.size(w)
        starts = F.concat(F.sequence(F.lit(0), n - width - 1, F.lit(width - overlap)), F.array(n - width))
        return F.when(n > width, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(width)), " "))).otherwise(F.array(sentence))

    return let(words(sentence), split)


def clean_title(title: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(title, "_", " ")), "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(plain, " +", " "))


def page_id(value: Column) -> Column:
    """An id from an integer or a digit string; anything else fails the query."""
    text = strip(value.cast("string"))
    return F.when(text.rlike(r"^[0-9]+$"), text.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("Invalid page_id: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("bigint"))

"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Each row of the table bounds a ratio of two counts of the text, in thousandths, so that every comparison is one of
integers. The counts are array expressions over the words and lines of the whole text; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayrick.llm.common import BLANKS, GAP

# Symbols of the base counts, and frequent function words of the corpus languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that it for was on with as be at by this from or are an not have "
    "de la le les et des en un une du est que pour dans par sur il au qui pas plus avec "
    "der die und den von das mit dem des auf für ist im ein eine nicht zu "
    "el los las y por con para una su al lo como más del se"
)


@dataclass(frozen=True)
class Rule:
    """``low <= 1000 * part / whole <= high`` for texts of at least ``min_words`` words; a missing bound is open."""

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None
    min_words: int = 0


RULES = (
    Rule("word_length", "word_chars", "n_words", 2_000, 14_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("exclamations", "n_exclaims", "n_words", None, 250),
    Rule("stop_words", "n_stop_words", "n_words", 20, None, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 500),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 500),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_stop_words", "n_lines", "n_dup_lines", "n_cut_lines", "n_repeat_words")
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it occurs in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found at least twice in the text (its first place included)."""

    def covered(places: Column) -> Column:
        step = lambda p, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - p, F.lit(window)))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, x: a + x)

    def heavy(grams: Column) -> Column:
        def places(ordered: Column) -> Column:
            twin = lambda e, j: F.when((e["h"] == F.get(ordered, j - 1)["h"]) | (e["h"] == F.get(ordered, j + 1)["h"]), e["i"])
            return F.sort_array(F.filter(F.transform(ordered, twin), lambda i: i.isNotNull()))

        pairs = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return bind(bind(F.sort_array(pairs), places), covered)

    def from_hashes(h: Column) -> Column:
        gram = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])
        starts = F.sequence(F.lit(0), F.size(h) - window)
        some = bind(F.transform(starts, gram), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), heavy(g)).otherwise(F.lit(0)))
        return F.when(F.size(h) > window, some).otherwise(F.lit(0))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _counts(text: Column) -> Column:
    """A struct of every count the rules use."""
    stops = sorted({f for w in STOP_WORDS.split() for f in (w, w.capitalize())})
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of(words: Column) -> Column:
        return bind(
            lines,
            lambda rows: F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                _without(text, BLANKS).cast("bigint").alias("word_chars"),
                (F.length(text) - _without(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
                (F.length(text) - _without(text, "!")).cast("bigint").alias("n_exclaims"),
                F.size(F.filter(words, lambda w: w.isin(stops))).cast("bigint").alias("n_stop_words"),
                F.size(rows).cast("bigint").alias("n_lines"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint").alias("n_dup_lines"),
                F.size(F.filter(rows, lambda r: r.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint").alias("n_cut_lines"),
                repeat_words(words).cast("bigint").alias("n_repeat_words"),
            ),
        )

    return bind(F.filter(F.split(text, GAP), lambda w: w != ""), of)


def _breaks(rule: Rule, c: Column) -> Column:
    part, whole = c[rule.part], c[rule.whole]
    broken = F.lit(False)
    if rule.low is not None:
        broken = broken | (part * 1000 < whole * rule.low)
    if rule.high is not None:
        broken = broken | (part * 1000 > whole * rule.high)
    return (c["n_words"] >= rule.min_words) & broken


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds the counts, ``base_failed``, ``broken`` (names of broken rules) and ``kept`` to every row.

    Input columns with the same names as added ones are replaced. Defined cases: null or empty text has no words
    and fails the base rule; every row is judged by itself, so ties and repeated rows get equal verdicts; texts of
    any length are read whole; an empty table gives an empty result.
    """

    def verdict(c: Column) -> Column:
        base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
        broken = F.filter(F.array(*[F.when(_breaks(r, c), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        counts = [c[n].alias(n) for n in COUNTS]
        return bind(broken, lambda b: F.struct(*counts, base.alias("base_failed"), b.alias("broken"), (~base & (F.size(b) == 0)).alias("kept")))

    # One expression makes counts and verdict, so a filter on the verdict, wherever it is pushed, computes them once.
    judged = docs.withColumn("_judged", bind(_counts(F.coalesce(F.col(text_col), F.lit(""))), verdict))
    return judged.withColumns({n: F.col(f"_judged.{n}") for n in (*COUNTS, "base_failed", "broken", "kept")}).drop("_judged")


def oracle_sql() -> str:
    """The same verdicts in SQL for ``documents``."""
    stops = ", ".join(f"'{f}'" for f in sorted({f for w in STOP_WORDS.split() for f in (w, w.capitalize())}))
    tests = []
    for r in RULES:
        bounds = [f"{r.part} * 1000 < {r.whole} * {r.low}"] * (r.low is not None) + [f"{r.part} * 1000 > {r.whole} * {r.high}"] * (r.high is not None)
        tests.append(f"(n_words >= {r.min_words} AND ({' OR '.join(bounds)}))")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
             generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS pos FROM d),
g AS (SELECT rid, pos, word, lead(word, 1) OVER s AS a, lead(word, 2) OVER s AS b, lead(word, 3) OVER s AS c, lead(word, 4) OVER s AS e
      FROM w WINDOW s AS (PARTITION BY rid ORDER BY pos)),
t AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, a, b, c, e) AS n FROM g WHERE e IS NOT NULL),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2, pos + 3, pos + 4]) AS p FROM t WHERE n > 1) GROUP BY rid),
c AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE word IN ({stops})) AS n_stop_words FROM w GROUP BY rid),
x AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
             count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS n_cut_lines
      FROM x WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaims,
             coalesce(n_stop_words, 0)::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_cut_lines, 0)::BIGINT AS n_cut_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN c USING (rid) LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({' OR '.join(tests)}) AS kept
FROM v
"""

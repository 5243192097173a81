r"""Personal data and secrets: base entities by pattern, then bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) are found by expression in every text. They, and values assigned to a few
telling words (``password=...``), are the seeds; such a value is whole, whatever its characters and length: up to white
space, or up to its closing quote on the line. Matches of a base expression that its check rejects (and that are not part of a longer instance) are known not to be
identifiers: they count against a pattern and are never believed. Every other run of letters and digits, with single
separators inside or an area code in brackets, is an instance.

Each occurrence has lexical patterns: the word before it with a sign (``token=``) or without one, the word after it, its
first letters with its length, its shape, and for unbroken mixtures of letters and digits their class. Patterns and
instances form a bipartite graph that Spark scores in turns: a pattern by the share of believed instances among all
places where it occurs (for a word: among all its occurrences in the corpus), an instance by its best pattern. Scores
never fall from one turn to the next and are rounded to six places, so the turns end where none changes. Instances of
patterns that end above the threshold are reported with kind ``secret``.

A quarter of the assigned values (``HELD``, by a hash of the value) take no part in the graph. How many of them the
trusted patterns find all the same measures the recall of the discovery on every run (``recovery``); as values of a
telling word they are reported in any case.

Only built-in expressions are used. Positions come from splitting a text at its matches: both see the same
leftmost non-overlapping matches, so a match starts where the lengths of all gaps and matches before it end.
The expressions of the contract are written with possessive repeats and a guard that a match starts a run (or
follows a match), which accept the same matches without rescanning long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hayrick.llm.common import small_table
from hayrick.llm.quality_rules import bind
from hayrick.operators.chunking import scan
from hayrick.session import materialize

# The base kinds in their order of report, and their expressions.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A number with its area code in brackets, or a chain of ASCII letter and digit runs with a digit among them.
CANDIDATE = (
    r"\([0-9]{2,5}\)[\x20-]?[0-9]{2,}+(?:[\x20.-][0-9]{2,}+)*+"
    r"|(?<![A-Za-z0-9])(?<![A-Za-z0-9][._/:-])(?=[A-Za-z._/:-]*+[0-9])[A-Za-z0-9]++(?:[._/:-][A-Za-z0-9]++)*+"
)
#: Shorter instances are no identifiers.
SHORTEST = 6
#: Words that, with = or : after them, introduce a seed.
SEED_WORDS = ("password", "passwd", "pwd", "passphrase", "token", "secret", "apikey", "api_key", "access_key", "ssn", "iban", "passport", "credential")
#: A seed word (whole, or after _) with its sign, white space and opening quote, then the value without its closing quote.
_SIGN = r"""["']?[\x20\x09]*+(?::=|=>|[=:])[\x20\x09]*+"""
_OPEN = r"""(?:"{3}|'{3}|["'])"""
_AFTER = r"[,;:.)\]}>]*+(?:\s|\z)"
ASSIGNED = (
    rf"""(?i)(?<![A-Za-z_])(?=[A-Za-z_]++["']?[\x20\x09]*+[=:])(?:[A-Za-z_]*_)?(?:{"|".join(SEED_WORDS)}){_SIGN}"""
    r"""(?:(?:"{3}|"(?!"))[^\r\n]+?(?=(?<!\\)")|(?:'{3}|'(?!'))[^\r\n]+?(?=(?<!\\)')"""
    rf"""|(?!(?:""|''){_AFTER}){_OPEN}?+\S+?(?=["']++{_AFTER}|\s|\z))"""
)
#: Score from which a pattern is trusted.
CONFIDENT = 0.6
#: One assigned value in this many is held back from the graph.
HELD = 4
#: Turns of the scoring between two cuts of the lineage and tests for the end; the end is the same for every number.
TURNS = 3
#: Of the text around a match this many characters are kept; a longer word is known by its nearer end.
AROUND = 64
#: Code points of a block, when a text is cut at many places.
BLOCK = 1024

_SPANS = "array<struct<start:int,end:int,value:string,left:string,right:string>>"


def located(text: Column, expression: str) -> Column:
    """All matches as an array of (start, end, value, left, right): code points, and the characters around the match."""

    def place(matches: Column, gaps: Column) -> Column:
        def step(at: Column, x: Column) -> tuple[Column, Column]:
            return at + x["gap"] + x["value"], at + x["gap"]

        def span(value: Column, start: Column, before: Column, after: Column) -> Column:
            around = F.right(before, F.lit(AROUND)).alias("left"), F.left(after, F.lit(AROUND)).alias("right")
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), *around)

        # Only numbers go through the scan: what it holds is copied at every step.
        lengths = F.transform(matches, lambda m, i: F.struct(F.length(m).alias("value"), F.length(F.get(gaps, i)).alias("gap")))
        starts = bind(lengths, lambda p: scan(p, F.lit(0), step, "int"))
        return bind(starts, lambda at: F.transform(matches, lambda m, i: span(m, F.get(at, i), F.get(gaps, i), F.get(gaps, i + 1))))

    matches = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    return bind(matches, lambda m: F.when(F.size(m) > 0, bind(F.split(text, expression, -1), lambda g: place(m, g))).otherwise(F.array().cast(_SPANS)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return bind(_digits(value), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checked(kind: str, good: bool) -> Column:
    return F.filter(kind, lambda s: _valid(kind, s["value"]) == good)


_HINT = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}


def base_matches(text: Column, kind: str) -> Column:
    """All matches of one base kind, before its check."""
    hint = text.contains("@") if kind == "email" else text.rlike(_HINT[kind])
    return F.when(hint, located(text, EXPRESSIONS[kind])).otherwise(F.array().cast(_SPANS))


def _beside(spans: Column, others: Column, keep: Callable[[Column, Column, Column], Column]) -> Column:
    """The spans, in order, for which ``keep(span, reach, next)`` holds: how far the others that begin no later than the
    span reach at most (-1: none begins), and where the first one that begins later begins.

    Both are sorted together and read once from either side, so a text of many matches takes time by their number.
    """
    none = 2**31 - 1
    point = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("own"), s["end"].alias("end"))

    def ends(at: Column, x: Column) -> tuple[Column, Column]:
        now = F.when(x["own"] == 0, F.greatest(at, x["end"])).otherwise(at)
        return now, F.when(x["own"] == 1, now)

    def starts(at: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x["own"] == 0, x["start"]).otherwise(at), F.when(x["own"] == 1, at)

    def judge(mine: Column) -> Column:
        both = F.sort_array(F.concat(F.transform(others, point(0)), F.transform(mine, point(1))))
        reach = bind(both, lambda u: F.array_compact(scan(u, F.lit(-1), ends, "int")))
        following = bind(F.reverse(both), lambda u: F.reverse(F.array_compact(scan(u, F.lit(none), starts, "int"))))
        near = F.arrays_zip(reach.alias("reach"), following.alias("next"))
        return bind(near, lambda n: F.filter(mine, lambda s, i: bind(F.get(n, i), lambda x: keep(s, x["reach"], x["next"]))))

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), bind(F.sort_array(spans), judge)).otherwise(spans)


def _apart(span: Column, reach: Column, following: Column) -> Column:
    """Whether the span overlaps none."""
    return (reach <= span["start"]) & (following >= span["end"])


def _not_within(span: Column, reach: Column, following: Column) -> Column:
    return reach < span["end"]


def assigned_spans(text: Column) -> Column:
    """All values assigned to seed words; left holds the word and the sign."""

    def value_of(s: Column) -> Column:
        front = F.regexp_extract(s["value"], rf"^[A-Za-z_]+{_SIGN}{_OPEN}?+", 0)
        left = F.concat(F.regexp_extract(s["value"], "^[A-Za-z_]+", 0), F.regexp_extract(s["value"], "[=:]", 0))
        value = F.substring(s["value"], F.length(front) + 1, F.length(s["value"]))
        return F.struct((s["start"] + F.length(front)).alias("start"), s["end"].alias("end"), value.alias("value"), left.alias("left"), s["right"].alias("right"))

    return F.transform(located(text, ASSIGNED), value_of)


def _sign(left: Column) -> Column:
    """The last word before a value with the sign between them, white space and quotes removed."""
    return F.lower(F.regexp_replace(F.regexp_extract(left, r"""([A-Za-z_]*[\x20\x09]*[=:]?[\x20\x09]*["']?)$""", 1), r"""[\x20\x09"']""", ""))


def _patterns(value: Column, left: Column, right: Column) -> Column:
    """The patterns of one occurrence. Those that begin with ``word`` or ``next`` also occur beside ordinary words."""
    run = value.rlike("^[A-Za-z0-9]*[0-9][A-Za-z0-9]*$")
    mixed = run & value.rlike("[A-Za-z]")
    signed = _sign(left).rlike("[a-z_][=:]$")
    before = F.lower(F.regexp_extract(left, r"(?<![\p{L}_])([\p{L}_]{2,}+)[^\p{L}_]*+$", 1))
    after = F.lower(F.regexp_extract(right, r"^[^\p{L}_]*([\p{L}_]{2,})", 1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    named = lambda kind, x: F.concat(F.lit(f"{kind} "), x)
    return F.filter(
        F.array(
            F.when(signed, named("left", _sign(left))),
            F.when(~signed & (before != ""), named("word", before)),
            F.when(after != "", named("next", after)),
            F.when(mixed, named("head", F.concat(F.substring(value, 1, 4), F.lit(" "), F.length(value).cast("string")))),
            F.when(mixed & (F.length(value) >= 16), F.lit("mixed, long")),
            F.when(~mixed, named("shape", shape)),
        ),
        lambda p: p.isNotNull(),
    )


def score_patterns(graph: DataFrame, totals: DataFrame) -> DataFrame:
    """(pattern, score) of the patterns that end above CONFIDENT.

    ``graph`` has one row per (pattern, value) with ``belief``: 1 for a seed, 0 for a known counter-example, null for an
    instance to be judged. ``totals`` (pattern, total) has the places where word patterns occur, if more than their
    instances. A pattern's score is the sum of beliefs over its instances, divided by its places plus 1; an instance to be
    judged is believed as far as its best trusted pattern. Starting from no trusted pattern, the turns end at the least
    fixed point, to six places.

    Patterns that could not reach the threshold were all their instances believed are left out, which changes no
    result; values with equal patterns and belief are scored as one kind.
    """
    counts = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("belief") == 0, 1)).alias("against"))
    counts = counts.join(totals, "pattern", "left").withColumn("places", F.greatest(F.col("n"), F.coalesce("total", F.lit(0))))
    able = materialize(counts.where((F.col("n") - F.col("against")) / (F.col("places") + 1) >= CONFIDENT).select("pattern", "places"), "pii-able")
    sets = graph.join(able.select("pattern"), "pattern").groupBy("value", "belief").agg(F.sort_array(F.collect_set("pattern")).alias("patterns"))
    kinds = materialize(sets.groupBy("patterns", "belief").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.monotonically_increasing_id()), "pii-kinds")
    links = materialize(kinds.select("kind", "belief", "n", F.explode("patterns").alias("pattern")).join(able, "pattern"), "pii-links")
    trusted, before = small_table(graph.sparkSession, [], "pattern string, score double"), None
    while True:
        for _ in range(TURNS):
            best = links.join(trusted, "pattern").groupBy("kind").agg(F.max("score").alias("best"))
            belief = F.coalesce("belief", "best", F.lit(0.0))
            score = F.round(F.sum(F.col("n") * belief) / (F.max("places") + F.lit(1.0)), 6)
            trusted = links.join(best, "kind", "left").groupBy("pattern").agg(score.alias("score")).where(F.col("score") >= CONFIDENT)
        trusted = materialize(trusted, "pii-patterns")
        now = trusted.agg(F.count(F.lit(1)), F.sum(F.round(F.col("score") * 1_000_000).cast("bigint"))).first()
        if now == before:  # no score fell, so none changed
            return trusted
        before = now


def _word_totals(texts: DataFrame) -> DataFrame:
    """(pattern, total): how often each word stands in the corpus, as a pattern of either side."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}_]+")).alias("w")).where(F.length("w") >= 2)
    sums = words.groupBy("w").agg(F.count(F.lit(1)).alias("total"))
    return sums.select(F.explode(F.array(F.concat(F.lit("word "), "w"), F.concat(F.lit("next "), "w"))).alias("pattern"), "total")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, secret, discovered): arrays of (start, end) spans of every row.

    Words are counted over ``corpus`` (with the same text column), where ``docs`` are only some of its rows.
    ``discovered`` has those spans of ``secret`` that patterns found: their values are no seeds.

    Defined cases: null or empty text has no spans; every row is searched by itself, so repeated rows get equal
    spans; other columns are ignored; an empty table gives an empty result. ``row`` numbers the rows of this result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = source.withColumns({k: base_matches(F.col("text"), k) for k in KINDS})
    candidates = F.filter(located(F.col("text"), CANDIDATE), lambda s: F.length(s["value"]) >= SHORTEST)
    rows = rows.withColumn("candidates", F.when(F.col("text").rlike("[0-9]"), candidates).otherwise(F.array().cast(_SPANS)))
    rows = rows.withColumn("assigned", F.when(F.col("text").rlike("[=:]"), assigned_spans(F.col("text"))).otherwise(F.array().cast(_SPANS)))
    rows = materialize(rows.drop("text").withColumn("row", F.monotonically_increasing_id()), "pii-found")
    valid = {k: _checked(k, True) for k in KINDS}
    refused = F.concat(*[_checked(k, False) for k in KINDS])
    every = F.concat(*[F.col(k) for k in KINDS])
    rows = rows.withColumns({**valid, "refused": refused})
    free = bind(_beside(F.col("candidates"), every, _apart), lambda c: _beside(c, F.col("refused"), _not_within))
    rows = rows.withColumns({"candidates": free, "assigned": _beside(F.col("assigned"), every, _not_within)})
    # A refused match inside a longer instance is no counter-example, but a part of that.
    rows = materialize(rows.withColumn("refused", _beside(F.col("refused"), F.concat("candidates", "assigned"), _not_within)), "pii-checked")

    # One row per (pattern, value). A value is a seed if it is one anywhere; held-back values have no rows.
    held = F.pmod(F.xxhash64("value"), F.lit(HELD)) == 0
    words = "|".join(SEED_WORDS)
    told = lambda spans, belief: rows.select(F.explode(spans).alias("s")).select("s.value", "s.left", "s.right", belief.cast("double").alias("belief"))
    others = told(F.col("candidates"), F.lit(None))
    others = others.withColumn("belief", F.when(_sign(F.col("left")).rlike(f"^(.*_)?({words})[=:]$"), 1.0))
    seen = told(every, F.lit(2.0)).unionByName(told(F.col("assigned"), F.lit(1.0))).unionByName(told(F.col("refused"), F.lit(-1.0))).unionByName(others)
    # belief here: 2 a base entity, 1 an assigned value, null an instance, -1 a refused match.
    seen = materialize(seen.withColumn("pattern", F.explode(_patterns(F.col("value"), F.col("left"), F.col("right")))).groupBy("pattern", "value").agg(F.max("belief").alias("belief")), "pii-graph")
    standing = seen.groupBy("value").agg(F.max("belief").alias("standing"))
    graph = seen.select("pattern", "value").join(standing, "value")
    away = F.coalesce((F.col("standing") == 1) & held, F.lit(False))
    belief = F.when(F.col("standing") > 0, 1.0).when(F.col("standing") < 0, 0.0)
    shown = graph.where(~away).select("pattern", "value", belief.alias("belief"))
    everything = source if corpus is None else corpus.select(F.col(text_col).cast("string").alias("text"))
    trusted = materialize(score_patterns(shown, _word_totals(everything)), "pii-trusted")

    reached = graph.join(trusted, "pattern", "left_semi").select("value").distinct().withColumn("reached", F.lit(True))
    known = standing.join(reached, "value", "left").where((F.col("standing") == 1) | ((F.col("standing").isNull()) & F.col("reached")))
    by_pattern = F.coalesce("reached", F.lit(False)) & (F.col("standing").isNull() | held)
    known = materialize(known.select("value", by_pattern.alias("found")), "pii-values")
    free = _beside(F.col("candidates"), F.col("assigned"), _apart)
    spots = rows.select("row", F.explode(F.concat(free, F.col("assigned"))).alias("s"))
    spots = spots.select("row", F.col("s.value").alias("value"), F.struct("s.start", "s.end").alias("span")).join(known, "value")
    secret = spots.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("secret"), F.sort_array(F.collect_list(F.when(F.col("found"), F.col("span")))).alias("discovered"))
    bare = {k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS}
    none = F.array().cast("array<struct<start:int,end:int>>")
    lists = [F.coalesce(c, none).alias(c) for c in ("secret", "discovered")]
    return rows.join(secret, "row", "left").select("row", "doc_id", *[bare[k].alias(k) for k in KINDS], *lists)


def recovery(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts that tell how well patterns find what they were not shown: ``secrets``, ``shown`` (spans of seeds)
    and ``discovered`` (the others, which patterns found), ``missed`` (spans of values held back that no pattern found).

    Defined cases: ids play no part, so they may repeat or be null; null and empty texts hold nothing; repeated rows count
    each; an empty table has counts of 0."""
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("n"), F.col(text_col).alias("text")), "pii-recovery")
    found = find_spans(rows, "n").withColumnRenamed("doc_id", "n")
    value = F.expr("substring(text, s.start + 1, s.end - s.start)")
    spans = found.join(rows, "n").select("text", "discovered", F.explode("secret").alias("s"))
    held = F.pmod(F.xxhash64(value), F.lit(HELD)) == 0
    hit = F.array_contains("discovered", F.col("s"))
    return spans.select(hit.alias("hit"), held.alias("held")).agg(
        F.count(F.lit(1)).alias("secrets"),
        F.count(F.when(~F.col("hit") & ~F.col("held"), 1)).alias("shown"),
        F.count(F.when(F.col("hit"), 1)).alias("discovered"),
        F.count(F.when(~F.col("hit") & F.col("held"), 1)).alias("missed"),
    )


def listed(kinds: tuple[str, ...]) -> Column:
    """All spans of these kinds as ``kind:start:end``, comma-joined."""

    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", F.concat(*[of(k) for k in kinds]))


def blocks_of(text: Column) -> Column:
    """The text in blocks of BLOCK code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def part_of(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive): only the blocks in which they lie are read, so cutting a text into
    many parts takes time by its length and not by its length for each part."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    near = F.concat_ws("", F.slice(blocks, first + 1, last - first + 1))
    return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def _without(blocks: Column, length: Column, spans: Column) -> Column:
    """The text of these blocks with a tag in place of each group of overlapping spans; spans are in order."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        return F.greatest(at, s["end"]), at

    def piece(s: Column, at: Column) -> Column:
        return F.when(s["start"] >= at, F.concat(part_of(blocks, at, s["start"]), s["tag"])).otherwise(F.lit(""))

    ends = F.transform(spans, lambda s: F.struct(s["end"].alias("end")))
    pieces = bind(bind(ends, lambda e: scan(e, F.lit(0), step, "int")), lambda at: F.transform(spans, lambda s, i: piece(s, F.get(at, i))))
    return F.concat(F.concat_ws("", pieces), part_of(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), length))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows with every found span of the text replaced by its kind in brackets.

    Spans of different kinds may overlap; overlapping spans become one, named by the first.
    Other columns are kept, whatever their names. Null and empty texts stay as they are, ids play no part (so they may
    repeat or be null), repeated rows are changed alike, an empty table stays empty. Texts without a digit, @ or assigned value hold nothing to find and pass by; the others
    are written with a row number by which they meet their spans.
    """
    text = F.col(text_col)
    told = text.rlike("[=:]") & text.rlike(ASSIGNED)  # most texts without a sign end at the first
    may_hold = F.coalesce(text.rlike("[0-9@]") | told, F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that no column can clash
    rows = materialize(docs.where(may_hold).select(F.monotonically_increasing_id().alias("n"), text.cast("string").alias("text"), whole), "pii-rows")
    spans = find_spans(rows, "n", "text", corpus=docs.select(text.alias("text")))

    def tag(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag")))

    tagged = F.sort_array(F.concat(*[tag(k) for k in (*KINDS, "secret")]))
    found = spans.select(F.col("doc_id").alias("n"), tagged.alias("spans")).where(F.size("spans") > 0)
    clean = bind(blocks_of(F.col("text")), lambda b: _without(b, F.length("text"), F.col("spans")))
    joined = rows.join(found, "n", "left").withColumn("text", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text")))
    kept = joined.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return kept.unionByName(docs.where(~may_hold))

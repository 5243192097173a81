"""The corpus operators against brute force, other libraries and the defined edge cases, on small fixtures."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hayrick.llm import bpe, langid, mixing, neardup, pieces, pii, quality_model, quality_rules, records, sharding, stages, topk
from hayrick.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = [None, "", " \n\t ", "a", "a b c", "Ünï 漢字 🙂 x", "x " * 3000, "l" * 5000, "the same text again " * 3, "the same text again " * 3]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, node int, copies int"


def edge_docs(spark, more=()):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None, 1, 2, 3) for i, t in enumerate([*EDGES, *more])]
    rows += [rows[5], rows[5], (None, "no id here", "en", "s1", 1, 1, 1, 1)]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- op1


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 6))]
    vectors[40:90] = [vectors[0]] * 50
    rows = [(i, v, "extra") for i, v in enumerate(vectors)]
    rows += [(300, None, ""), (350, [1.0, math.nan] * 3, ""), (301, [1.0, None], ""), (302, [1.0], ""), (None, vectors[1], ""), (7, vectors[7], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * x) for x in v] for i, v in enumerate(vectors)} | {302: [256]}
    for q in range(0, 300, 50):
        score = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        assert got[q] == [(i, score[i]) for i in sorted(score, key=lambda i: (-score[i], i))[:5]]
    assert set(got) == set(range(0, 300, 50))


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


# --- op2


def test_shards(spark):
    rng = random.Random(1)
    docs = edge_docs(spark, [f"text {rng.random()} " * rng.randint(1, 40) for _ in range(400)] + ["hot"] * 200)
    rows = sharding.kd_shards(docs, 8).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(rows) == docs.count()
    total = [0] * 8
    slots = [[] for _ in range(8)]
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(total) - min(total) <= 2 * max(r["size"] for r in rows)
    assert sharding.kd_shards(empty_docs(spark), 8).count() == 0


# --- op3


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components_by_force(texts, k):
    sets, root = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    more = []
    for _ in range(250):  # one group with many members on either side of the threshold
        x = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            x[rng.randrange(100)] = rng.choice(vocabulary)
        more.append(" ".join(x))
    docs = edge_docs(spark, more)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, 4, 80).collect() if r["doc_id"] is not None}
    assert got == components_by_force(dict(enumerate([*EDGES, *more])), 4)
    assert neardup.near_duplicates(empty_docs(spark)).count() == 0


def test_short_texts_alone(spark):
    for k in (4, 5):
        for n in range(k + 1):
            text = " ".join(f"w{i}" for i in range(n))
            assert [len(s) for s in neardup.shingle_sets([text], k)] == [min(n, 1)]
            (alone,) = neardup.shingle_sets([text], k)
            assert alone.tolist() == list(neardup.shingle_sets([text, "many other words stand beside it here"], k))[0].tolist()
    docs = spark.createDataFrame([(3, "two words")], "doc_id bigint, text string")
    assert [tuple(r) for r in neardup.near_duplicates(docs, 4, 80).collect()] == [(3, 1, 3)]


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for own in (20, 200, 600):
        a, b = (np.sort(np.concatenate([shared, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2))
        odd = neardup.odd_sketches(np.array([neardup.samples_of(a), neardup.samples_of(b)])).view(np.uint64)
        differ = int(np.bitwise_count(odd[0] ^ odd[1]).sum())
        estimate = 1 + neardup.BITS / (4 * neardup.SAMPLES) * math.log(1 - 2 * differ / neardup.BITS)
        assert estimate == pytest.approx(900 / (900 + 2 * own), abs=0.12)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# --- op4


def test_records_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    docs = edge_docs(spark, ["It's  <|endoftext|> 'll we've\n\n  "])
    manifest = records.write_records(docs, path, end_id=2)
    rows = records.read_records(manifest).orderBy("start").collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    start = 0
    for (_, text), r in zip(texts, rows, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["start"], list(np.frombuffer(r["ids_le32"], "<u4"))) == (start, ids)
        start += len(ids)
    shuffled = records.read_shuffled(manifest, seed=3, partitions=3).collect()
    assert sorted(bytes(r["ids_le32"]) for r in shuffled) == sorted(bytes(r["ids_le32"]) for r in rows)
    assert records.read_records(records.write_records(empty_docs(spark), path, end_id=2)).count() == 0


def test_damaged_records_are_noticed():
    import io

    good = records.frame(b"payload")
    assert records.unframe(io.BytesIO(good).read) == b"payload"
    for at in range(len(good)):
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :]).read)


# --- op5


def test_quality_counts(spark):
    texts = [*EDGES, "a b c d e f g a b c d e x y z", "x\nx\n \nx\ny", "#*$%&|<> ok!"]
    rows = {r["doc_id"]: r for r in quality_rules.judge(edge_docs(spark, texts[len(EDGES) :])).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(w) < 100 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(rows[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert rows[i]["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert quality_rules.judge(empty_docs(spark)).count() == 0


# --- op6


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    docs = edge_docs(spark, [" ".join(["w"] * rng.randint(1, 60)) for _ in range(900)])
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    by = {}
    for r in rows:
        by.setdefault(sources[r["doc_id"]], []).append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    size = {s: by[s][0]["source_size"] for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, rest = {}, 1.5 * sum(size.values()), set(names)
    while over := [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 2 * size[s]]:
        for s in over:
            target[s] = 2 * size[s]
        left -= sum(target[s] for s in over)
        rest -= set(over)
    target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
    for s in names:
        assert by[s][0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(r["size"] for r in by[s])
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty_docs(spark)).count() == 0


# --- op7


def test_bpe_equals_the_public_library(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    signs = list("ab'srtvelmd  \n\t1.é日½  !S")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["ab" * 900 + "7" * 300, "'s 's's  's"]
    docs = edge_docs(spark, texts)
    rows = bpe.decode(bpe.encode(docs, path), path, keep=("doc_id", "ids", "ends")).collect()
    want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == own.encode_ordinary(want[r["doc_id"]])
        assert bytes(r["decoded"]) == want[r["doc_id"]].encode()
        assert (r["ends"] or [0])[-1] == len(want[r["doc_id"]].encode())
    assert bpe.encode(empty_docs(spark), path).count() == 0


def test_a_shared_hash_does_not_mix_pieces():
    merger = bpe.RankMerger(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    cache = pieces.PieceCache(merger, most=1000)
    cache._hash = lambda data, starts, lengths, pos: np.full(len(starts), 77, np.uint64)  # noqa: SLF001
    for text in ("one two three", "four"):
        ids, _, _, _ = pieces.encode_texts([text], cache)
        plain, _ = merger([text.encode()[a:b] for a, b in {"one two three": [(0, 3), (3, 7), (7, 13)], "four": [(0, 4)]}[text]])
        assert ids.tolist() == plain.tolist()


# --- op8


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_force(text):
    def luhn(d):
        return sum(x - 9 if (x := int(c) * (1 + i % 2)) > 9 else x for i, c in enumerate(reversed(d))) % 10 == 0

    def good(kind, value):
        d = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind != "ip" or all(int(p) < 256 for p in value.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    return {k: [(m.start(), m.end()) for m in re.finditer(x, text) if good(k, m.group())] for k, x in BASE.items()}


def test_personal_data(spark):
    rng = random.Random(3)
    signs = ["a", "b.c", "@", ".", "1", "23", "456", "-", " ", "+1", "(", ")", "%", "4111111111111111", "x@y.zz", "9.8.7.6", "é", "🙂", "\n", "_", "555-1234"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += [f"see password={hashlib.md5(str(i).encode()).hexdigest()} here" for i in range(30)]
    texts += [f"this KEY{i}A9B8C7D6E5F4G3H2 stands alone" for i in range(8)] + ["1." * 2000, "a" * 20000 + "@b.c", "Version 2.0 of 1999"]
    docs = edge_docs(spark, texts)
    rows = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    for i, t in enumerate([*EDGES, *texts]):
        assert {k: [tuple(s) for s in rows[i][k]] for k in BASE} == base_by_force(t or "")
    first = len(EDGES) + 600
    assert all(len(rows[i]["secret"]) == 1 for i in range(first, first + 38))  # assigned ones are seeds, the others are discovered
    assert rows[first + 40]["secret"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[first] == "see password=[SECRET] here"
    assert clean[1] == "" and clean[0] is None
    assert pii.redact(docs).columns == docs.columns
    assert pii.find_spans(empty_docs(spark)).count() == 0


def test_redaction_of_texts_of_many_blocks(spark):
    rng = random.Random(9)
    texts = []
    for size in (0, 1, pii.BLOCK - 1, pii.BLOCK, pii.BLOCK + 1, 5 * pii.BLOCK):
        noise = "".join(rng.choice("a é🙂\nb") for _ in range(size))
        for gap in (0, 1, 700):
            texts.append(noise + " a@b.cc" + " " * gap + "+123456789012 " + noise)
            texts.append(" x@y.zz " * (gap // 7) + noise)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r["doc_id"]: sorted((s["start"], s["end"], k) for k in (*pii.KINDS, "secret") for s in r[k]) for r in pii.find_spans(docs).collect()}
    for r in pii.redact(docs).collect():
        text, out, at = texts[r["doc_id"]], [], 0
        for start, end, kind in spans[r["doc_id"]]:
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        assert r["text"] == "".join(out) + text[at:]


def test_assigned_values_are_whole(spark):
    word = "k" * 70
    values = {
        "see password=CorrectHorse here": "CorrectHorse",
        "pwd=abc1 x": "abc1",
        "user password=ab-cdef12345 x": "ab-cdef12345",
        f"x token: {word}7{word} y": f"{word}7{word}",
        'a secret = "two words, é \\" 🙂 9" end': 'two words, é \\" 🙂 9',
        "{'password': 'p!'}": "p!",
        "🙂 db_password := hunter": "hunter",
        'passwd="unclosed value': "unclosed",
        "(token=abc.def)": "abc.def)",
    }
    none = ["password is CorrectHorse", "password= \n next", 'pwd="" user="x"', "mypassword=CorrectHorse", "secret=a@b.cc"]
    docs = spark.createDataFrame(list(enumerate([*values, *none])), "doc_id bigint, text string")
    found = {r["doc_id"]: [tuple(s) for s in r["secret"]] for r in pii.find_spans(docs).collect()}
    for i, (text, value) in enumerate(values.items()):
        at = text.rindex(value)
        assert found[i] == [(at, at + len(value))], text
    assert all(found[len(values) + i] == [] for i in range(len(none)))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] == "see password=[SECRET] here" and clean[len(values) + 4] == "secret=[EMAIL]"


def test_patterns_are_trusted_until_none_is_new(spark):
    sizes, texts = (240, 100, 40, 16, 6), []
    for k, n in enumerate(sizes):  # the word of each step is trusted through the values it shares with the step before
        front, after = f"{chr(96 + k) * 3}key=" if k else "password=", f"{chr(97 + k) * 3}key="
        values = [f"{k}{i:03d}{hashlib.md5(f'{k} {i}'.encode()).hexdigest()[:5]}a" for i in range(n)]
        texts += [word + v for v in values for word in (front, after)]
    texts.append(f"{chr(96 + len(sizes)) * 3}key=9999lone")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert all(len(r["secret"]) == 1 for r in pii.find_spans(docs).collect())


# --- op9, op10


def test_language_spans(spark):
    rng = random.Random(2)
    spell = {"aa": "kamitore", "bb": "dulsevip", "gg": "αβγδεικλ"}
    word = lambda lang: "".join(rng.choice(spell[lang]) for _ in range(rng.randint(3, 9)))
    text = lambda lang, n: " ".join(word(lang) for _ in range(n))
    train = spark.createDataFrame([(text(x, 40), x) for x in spell for _ in range(30)] + [(None, "aa"), ("", "bb"), ("lone", None)], "text string, lang string")
    model = langid.train(train)
    assert model.languages == ["aa", "bb", "gg"]
    left, right = text("aa", 30), text("bb", 20)
    docs = edge_docs(spark, [left + " " + right, text("gg", 5), "123 !!"])
    rows = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    n = len(EDGES)
    assert rows[n]["lang_pred"] == "aa"
    assert [(s["lang"], s["start"]) for s in rows[n]["spans"]] == [("aa", 0), ("bb", len(left) + 1)]
    assert rows[n + 1]["lang_pred"] == "gg"
    for i in (0, 1, 2, n + 2):
        assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    assert langid.identify(empty_docs(spark), model).count() == 0
    untaught = langid.train(empty_docs(spark))
    assert {r["lang_pred"] for r in langid.identify(docs, untaught).collect()} == {"und"}


def test_viterbi_equals_all_paths():
    import itertools

    rng = np.random.default_rng(1)
    counts = np.array([4, 0, 6, 1])
    score = rng.normal(size=(counts.sum(), 3)) * 4
    got = langid.viterbi(score, counts, switch=3.0)
    at = 0
    for n in counts:
        part = score[at : at + n]
        value = lambda p: sum(part[k, x] for k, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        if n:
            assert value(tuple(got[at : at + n])) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))
        at += n


def test_positive_unlabelled_learning(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 60))) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "$$$", "NOW###", "win&&&"]) for _ in range(rng.randint(20, 60)))
    texts = [good() if i % 4 else bad() for i in range(800)]
    docs = edge_docs(spark, texts)
    first = len(EDGES)
    trusted = spark.createDataFrame([(first + i,) for i in range(400) if i % 4], "doc_id bigint")
    model = quality_model.train(docs, trusted)
    assert 0.6 < model.prior < 0.9
    score = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model).collect()}
    assert sum((score[first + i] >= 0.5) == bool(i % 4) for i in range(400, 800)) >= 390
    assert all(0 <= s <= 1 for s in score.values())
    assert quality_model.score(empty_docs(spark), model).count() == 0
    assert quality_model.train(docs, spark.createDataFrame([], "doc_id bigint")).prior == 0.5


# --- pipeline


def test_every_stage_takes_edge_cases(spark):
    import corpus_pipeline

    rng = random.Random(9)
    prose = [" ".join(rng.choice(["the", "of", "and", "river", "stone", "walked", f"w{rng.randint(0, 999)}"]) for _ in range(60)) for _ in range(60)]
    docs = edge_docs(spark, [*prose, prose[0], "Mail a.b@c.de " + prose[1], "### $$$ &&& " * 20])
    n = len(EDGES)
    kept = stages.keep_good(docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(range(n, n + 60)) <= set(ids) and n + 62 not in ids
    one = stages.keep_one_of_each_group(kept)
    ids = sorted(r["doc_id"] for r in one.collect())
    assert n in ids and n + 60 not in ids and len(ids) == len(set(ids))
    mixed = stages.take_mix(one)
    assert mixed.columns == docs.columns == one.columns == kept.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs(spark), "").count() == 0, name
    told = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] for r in told.collect()}
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    assert ids(stage["quality rules"](spark, told, "")) == sorted(i for i, t in text.items() if kept_by_force(t))
    assert ids(stage["near-duplicates"](spark, told, "")) == sorted(i for i, (_, c) in components_by_force(text, 5).items() if i == c)
    hidden = {r["doc_id"]: r["text"] for r in stage["personal data"](spark, told, "").collect()}
    assert hidden == {i: hidden_by_force(t) for i, t in text.items()}
    mixed = [r["doc_id"] for r in stage["mixing"](spark, told, "").collect()]
    assert {i: mixed.count(i) for i in text} == {r["doc_id"]: r["copies"] for r in mixing.mix(told).collect()}
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in stage["byte-level BPE"](spark, told, "").collect()} == {i: own.encode_ordinary(t or "") for i, t in text.items()}


def kept_by_force(text):
    """The quality rules by plain counting."""
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    stops = {f for x in quality_rules.STOP_WORDS.split() for f in (x, x.capitalize())}
    n = {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_exclaims": text.count("!"), "n_stop_words": sum(x in stops for x in w),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_cut_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0D]*$", x)) for x in lines),
    }
    if len(w) < 10 or 100 * len({k + j for k, g in enumerate(grams) if g in often for j in range(5)}) > 20 * len(w):
        return False
    for r in quality_rules.RULES:
        part, whole = 1000 * n[r.part], n[r.whole]
        if len(w) >= r.min_words and ((r.low is not None and part < whole * r.low) or (r.high is not None and part > whole * r.high)):
            return False
    return True


def hidden_by_force(text):
    """A text without assigned values, its base entities replaced; overlapping ones become one, named by the first."""
    spans = sorted((a, b, f"[{k.upper()}]") for k, found in base_by_force(text or "").items() for a, b in found)
    out, at = [], 0
    for a, b, tag in spans:
        if a >= at:
            out += [text[at:a], tag]
        at = max(at, b)
    return text if not spans else "".join(out) + text[at:]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(12)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(4))
    rows = [(7, a), (7, b), (7, a + " end"), (3, b), (9, a), (None, c), (None, c + " end"), (None, d), (5, d), (8, None), (8, ""), (1, "alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r["doc_id"], r["text"]) for r in stages.keep_one_of_each_group(docs).collect()]
    groups = {t: [i for i, x in kept if x is not None and x.removesuffix(" end") == t] for t in (a, b, c, d, "alone")}
    assert groups == {a: [7], b: [3], c: [None], d: [5], "alone": [1]}
    assert len(kept) == 7


# --- caches smaller than a text, special strings, indexes


def test_a_text_of_more_pieces_than_the_cache_holds(spark, monkeypatch):
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(8)
    text = " ".join(f"w{rng.randint(0, 99999)}é" for _ in range(3000))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids, counts, _, _ = pieces.encode_texts([text, "short", text], pieces.PieceCache(bpe.RankMerger(bpe.read_ranks(path)), most=100))
    assert ids.tolist() == own.encode_ordinary(text) + own.encode_ordinary("short") + own.encode_ordinary(text)
    assert counts.tolist() == [len(own.encode_ordinary(t)) for t in (text, "short", text)]
    monkeypatch.setattr(records, "CACHED", 100)
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache, _ = records._cache.__wrapped__(path, "text")  # noqa: SLF001
    ids, _ = pieces.encode_around([text], cache, {})
    assert ids.tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("specials", ["text", "ids"])
def test_special_strings(spark, specials):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)  # as loaded, a special token's string is its id
    plain.encode_special_tokens = specials == "text"
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>c", "<|endoftext|", "it's <|endoftext|>'s  \n", "", None, "none here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = records.read_records(records.write_records(docs, path, end_id=2, specials=specials)).orderBy("start").collect()
    assert [list(np.frombuffer(r["ids_le32"], "<u4")) for r in rows] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_indexes_and_orphans(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 7)) for i in range(60)], "doc_id bigint, text string").repartition(3)
    manifest = records.write_records(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, uri=f"file://{tmp_path}/set")
    rows = {r["doc_id"]: (r["start"], bytes(r["ids_le32"])) for r in records.read_records(manifest).collect()}
    assert {r["doc_id"]: (r["start"], bytes(r["ids_le32"])) for r in records.read_shuffled(manifest, seed=1, partitions=2).collect()} == rows
    assert list(rows) == sorted(rows) or len(rows) == 60
    (tmp_path / "set" / "part-00000-dead.rec").write_bytes(b"half")
    assert records.remove_orphans(manifest) == 1
    assert records.read_records(manifest).count() == 60
    index = next((tmp_path / "set").glob("*.idx"))
    good = index.read_bytes()
    for bad in (good[:-8], good[:16] + bytes([good[16] ^ 1]) + good[17:], good[:24] + bytes([good[24] ^ 1]) + good[25:]):
        index.write_bytes(bad)
        with pytest.raises(Exception, match="index|damaged"):
            records.read_records(manifest).collect()
    index.unlink()
    with pytest.raises(Exception, match=index.name):
        records.read_records(manifest).collect()


# --- shards: groups and cuts


def test_equal_texts_stay_together_where_a_shard_has_room(spark):
    rng = random.Random(11)
    texts = [f"text {rng.random()} " * rng.randint(1, 9) for _ in range(600)]
    texts += ["heavy but whole " * 10] * 40 + ["half a shard " * 20] * 12 + ["more than a shard " * 8] * 90 + ["few copies"] * 5
    rows = [(i, t, rng.choice(["english", "englisch", None]), rng.choice(["source of texts a", "source of texts b"])) for i, t in enumerate(texts)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 8).collect()
    share, total, shards = sum(r["size"] for r in got) / 8, [0] * 8, {}
    for r in got:
        total[r["shard"]] += r["size"]
        shards.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    for t, where in shards.items():
        assert len(where) == 1 or texts.count(t) * (len(t) + 1) > share, t[:20]
    assert len(shards["more than a shard " * 8]) > 1 and len(shards["few copies"]) == 1
    assert max(total) - min(total) <= 0.02 * share + max(r["size"] for r in got)


def test_cuts_follow_the_widest_dimension(spark):
    rng = random.Random(12)
    sizes = rng.sample(range(10, 4000), 500)
    rows = [(i, "x" * n, "en", "s") for i, n in enumerate(sizes)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 4).collect()
    by = [sorted(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert all(a[-1] < b[0] for a, b in zip(by, by[1:]))  # intervals of one dimension, in order
    order, upto = sorted(n + 1 for n in sizes), 0
    for s in range(3):  # each cut is the weighted quantile, up to one row
        upto += sum(by[s])
        assert abs(upto - sum(order) * (s + 1) / 4) <= order[-1]
    rows = [(i, f"{i:04d}", "en", f"one long common prefix {i % 40:02d}") for i in range(400)]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 4).collect()
    names = [{rows[r["doc_id"]][3] for r in got if r["shard"] == s} for s in range(4)]
    assert [len(x) for x in names] == [10, 10, 10, 10] and all(max(a) < min(b) for a, b in zip(names, names[1:]))


# --- top-k over many cells and blocks


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_top_k_over_many_cells(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 8))
    own = np.concatenate([rng.integers(0, 9, 700), np.zeros(500, np.int64)])  # one cell with many blocks
    vectors = centres[own] * 4 + spread * rng.normal(size=(1200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v], i, "clash") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>, cell int, block string")
    seen = {}
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 5 == 0, block=64, query_block=8, most_pivots=12, seen=seen).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    whole = np.floor(256 * vectors).astype(np.int64)
    scores = whole @ whole.T
    for q in range(0, 1200, 5):
        order = [i for i in sorted(range(1200), key=lambda i: (-scores[q, i], i)) if i != q][:5]
        assert got[q] == [(i, scores[q, i]) for i in order]
    assert (seen["pivots"], seen["pairs"]) == (12, 240 * 1200) and seen["query_blocks"] > 12
    if spread < 1:
        assert seen["open_pairs"] < 0.5 * seen["pairs"]


def test_query_blocks():
    assert topk.query_blocks([(3, 5), (1, 4), (0, 30), (2, 2), (7, 8), (5, 10)], 10) == {3: (0, 1), 1: (0, 1), 0: (1, 3), 2: (4, 1), 7: (4, 1), 5: (5, 1)}


# --- language: no letters


def test_marks_alone_are_no_letters(spark):
    train = spark.createDataFrame([("kamitore", "aa"), ("dulsevip", "bb")], "text string, lang string")
    docs = spark.createDataFrame([(1, "́́ 12 ́"), (2, "é kami ́́ tore")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in langid.identify(docs, langid.train(train)).collect()}
    assert (rows[1]["lang_pred"], rows[1]["score"], rows[1]["spans"]) == ("und", 0.0, [])
    assert rows[2]["lang_pred"] == "aa"


# --- mixing: refined edges


def test_edges_are_refined_to_few_documents(spark):
    rng = random.Random(3)
    rows = [("a", int(rng.betavariate(0.02, 5) * 2**52), 700.0, 1 + rng.randint(0, 9)) for _ in range(900)]  # ranks crowd near 0
    rows += [("b", 77, 55.0, 2) for _ in range(100)] + [("c", rng.randint(0, 2**52), 1e9, 3) for _ in range(20)]
    edges = {r["skey"]: r for r in mixing.find_edges(spark.createDataFrame(rows, "skey string, rank bigint, residual double, size bigint"), edge=5).collect()}
    for key, residual in (("a", 700), ("b", 55), ("c", 1e9)):
        own, e = sorted((r, n) for k, r, _, n in rows if k == key), edges[key]
        assert e["words_in"] == sum(n for r, n in own if r < e["low"]) <= residual
        inside = [n for r, n in own if e["low"] <= r < e["high"]]
        assert len(inside) <= 5 or len({r for r, _ in own if e["low"] <= r < e["high"]}) == 1
        assert key == "c" or e["words_in"] + sum(inside) > residual


# --- the pattern graph and the risk by plain computation


def test_pattern_scores_equal_plain_iteration(spark):
    rng = random.Random(5)
    values = {f"v{i}": rng.choice([1.0, 1.0, None, None, 0.0]) for i in range(60)}
    rows = [(p, v, b) for v, b in values.items() for p in rng.sample([f"p{i}" for i in range(14)], rng.randint(1, 3)) if b != 0.0 or rng.random() < 0.3]
    totals = {"p3": 40, "p5": 9, "nowhere": 5}
    got = {
        r["pattern"]: r["score"]
        for r in pii.score_patterns(spark.createDataFrame(rows, "pattern string, value string, belief double"), spark.createDataFrame(list(totals.items()), "pattern string, total bigint")).collect()
    }
    trusted = {}
    for _ in range(200):
        belief = {v: b if b is not None else max((trusted.get(p, 0.0) for p, x, _ in rows if x == v), default=0.0) for v, b in values.items()}
        score = {}
        for p in {p for p, _, _ in rows}:
            own = [v for q, v, _ in rows if q == p]
            score[p] = round(sum(belief[v] for v in own) / (max(len(own), totals.get(p, 0)) + 1), 6)
        trusted = {p: x for p, x in score.items() if x >= pii.CONFIDENT}
    assert got == pytest.approx(trusted, abs=2e-6) and got


def test_patterns_find_what_they_were_not_shown(spark):
    rng = random.Random(6)
    key = lambda: "".join(rng.choice("abcdefghjkmnp23456789") for _ in range(11)) + "7q"
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    texts = [f"{word()} secret: {key()} {word()}" for _ in range(60)]
    texts += [f"{word()} badge {rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)} {word()}" for _ in range(30)]  # no seed shares their form
    texts += [f"{word()} reach (0{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)} {word()}" for _ in range(5)]
    texts += [f"{word()} {word()} 4000-{i}-77 is a part" for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts = pii.recovery(docs).first().asDict()
    assert counts["secrets"] == 60 and counts["missed"] == 0 and 5 <= counts["discovered"] <= 30 and counts["shown"] == 60 - counts["discovered"]
    rows = {r["doc_id"]: r for r in pii.find_spans(docs).collect()}
    assert all(rows[i]["secret"] == [] for i in range(60, len(texts)))


def test_risk_gradient_equals_differences():
    rng = np.random.default_rng(4)
    p, u = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (90, 5))
    for scale, prior in ((0.1, 0.3), (3.0, 0.9)):
        w = rng.normal(size=5) * scale
        good, bad = quality_model.pu_risk(w, p, u, prior)
        target = lambda x: sum(quality_model.pu_risk(x, p, u, prior)) if bad >= 0 else -quality_model.pu_risk(x, p, u, prior)[1]  # noqa: B023, E731
        steps = np.eye(5) * 1e-6
        assert quality_model.pu_gradient(w, p, u, prior) == pytest.approx(np.array([(target(w + s) - target(w - s)) / 2e-6 for s in steps]), abs=1e-4)
    scores, prior = np.concatenate([rng.normal(3, 1, 3000), rng.normal(-3, 1, 7000)]), 0.3
    assert quality_model.estimate_prior(rng.normal(3, 1, 3000), scores) == pytest.approx(prior, abs=0.03)


# --- the registered queries against their contracts

SF = "/root/testdata/sf0.001"
has_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def registered(spark, name):
    from hayrick.llm import registry

    df = registry.queries()[name](spark, SF)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return dict(df.dtypes), {r["doc_id"]: r for r in df.collect()}, docs


def leaves_one(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@has_tables
def test_registered_sharding(spark):
    kinds, rows, docs = registered(spark, "op2_kd_sharding")
    assert kinds == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        raw = (docs[i]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    for s in range(8):
        assert sorted(r["slot"] for r in rows.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows.values())))
    total = Counter()
    for r in rows.values():
        total[r["shard"]] += r["size"]
    assert max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in rows.values())


@has_tables
def test_registered_records(spark):
    from tokenizers import Tokenizer

    kinds, rows, docs = registered(spark, "op4_binary_records")
    assert kinds == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@has_tables
def test_registered_mixing(spark):
    kinds, rows, docs = registered(spark, "op6_pareto_mixing")
    assert kinds == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
    assert all(r["size"] == len(WORD.findall(docs[i]["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"] for i, r in rows.items())
    by = {}
    for i, r in rows.items():
        by.setdefault(docs[i]["source"], []).append(r)
    assert sum(x[0]["target"] for x in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows.values()))
    for x in by.values():
        assert x[0]["source_size"] == sum(r["size"] for r in x) and abs(sum(r["taken"] for r in x) - x[0]["target"]) <= max(r["size"] for r in x)


@has_tables
def test_registered_bpe(spark):
    import tiktoken

    kinds, rows, docs = registered(spark, "op7_byte_bpe")
    assert {c: kinds[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")} == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    for i, d in docs.items():
        ids = own.encode_ordinary(d["text"] or "")
        assert tuple(rows[i])[1:4] == (len(ids), digest(",".join(map(str, ids)).encode()), digest((d["text"] or "").encode()))


@has_tables
def test_registered_personal_data(spark):
    kinds, rows, docs = registered(spark, "op8_pii")
    assert {c: kinds[c] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")} == {**dict.fromkeys(("n_email", "n_ip", "n_card", "n_phone"), "bigint"), "base_sha256": "string", "spans": "string"}
    for i, d in docs.items():
        found = base_by_force(d["text"] or "")
        listed = [f"{k}:{a}:{b}" for k in BASE for a, b in found[k]]
        assert [rows[i][f"n_{k}"] for k in BASE] == [len(found[k]) for k in BASE]
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert rows[i]["spans"].split(",")[: len(listed)] == (listed or rows[i]["spans"].split(",")[:0])
        spans = [s for s in rows[i]["spans"].split(",") if s]
        assert (rows[i]["n_private"], rows[i]["n_secret"]) == (len(spans), len(spans) - len(listed))


@has_tables
def test_registered_models(spark):
    kinds, rows, docs = registered(spark, "op9_language_id")
    assert {c: kinds[c] for c in ("doc_id", "held_out", "lang_pred", "score")} == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert all(r["held_out"] == leaves_one(i) and 0 <= r["score"] <= 1 for i, r in rows.items())
    judged = [r["lang_pred"] == docs[i]["lang"] for i, r in rows.items() if r["held_out"] and docs[i]["lang"] and docs[i]["text"]]
    assert sum(judged) >= 0.9 * len(judged) > 0
    kinds, rows, docs = registered(spark, "op10_quality_model")
    assert {c: kinds[c] for c in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert rows.keys() == docs.keys()
    assert all(r["held_out"] == leaves_one(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [rows[i]["predicted"] == q for i, q in labels.items() if i in rows and rows[i]["held_out"] and q is not None]
    assert sum(judged) >= 0.8 * len(judged) > 0

"""Importance resampling, the filter audit and the Jaccard join against brute force and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hayrick import session
from hayrick.llm import filter_audit, importance, jaccard_join, neardup, tiles

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EDGES = [None, "", " \n\t ", "a", "a b", "a b c", "Ünï 漢字 🙂 x9", "x " * 3000, "l" * 5000, "the same text again " * 9, "the same text again " * 9]
KIND = "doc_id bigint, text string, source string, score long, rank int, part int, mask int, n int, hub int, need int, able int, m int"


def rows_of(texts):
    """Documents with ids, a null id, repeated rows, null sources and columns named like the operators' own."""
    rows = [(i, t, None if i % 4 == 0 else f"s{i % 3}", *range(9)) for i, t in enumerate(texts)]
    return [*rows, rows[-1], rows[-1], (None, "no id here", "", *[None] * 9)]


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# --- op11


def crcs(t):
    w = RUNS.findall(lowered(t))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


@pytest.mark.parametrize("window", [64, 700, 1 << 22])
def test_checksums_of_runs_equal_the_library(window, monkeypatch):
    monkeypatch.setattr(importance, "WINDOW", window)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcXYZ0é") for _ in range(r.randrange(1, 700)))
    texts = [*EDGES, "x" * 256 + " " + "y" * 257 + " z", "q" * 9000 + " r " + "s" * 1000, "a\x00b\x7fc\x80d"]
    texts += [" ".join(word() for _ in range(r.randrange(9))) for _ in range(30)]
    for t in texts:
        parts = list(importance.features([t]))
        assert (sorted(int(c) for p in parts for c in p[0]), sum(int(p[2][0]) for p in parts)) == (sorted(crcs(t)[0]), crcs(t)[1])
    together = list(importance.features(texts))
    assert [sorted(together[0][0][together[0][1] == i].tolist()) for i in range(len(texts))] == [sorted(crcs(t)[0]) for t in texts]


def test_resampling_equals_brute_force(spark):
    r = random.Random(2)
    texts = [*EDGES, *(" ".join(r.choice("alpha beta gamma delta Epsilon zeta eta theta".split()) for _ in range(r.randrange(60))) for _ in range(120))]
    rows, target, n = rows_of(texts), ["alpha beta gamma zeta", None, "theta eta alpha"], 50
    bucketed = lambda t: [c % n for c in crcs(t)[0]]
    s, t = Counter(b for row in rows for b in bucketed(row[1])), Counter(b for x in target for b in bucketed(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in range(n)]
    want = []
    for row in rows:
        h = int(hashlib.sha256(f"42:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bucketed(row[1]))
        want.append([row[0], len(bucketed(row[1])), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, crcs(row[1])[1] >= 20])
    able = sorted((w for w in want if w[5]), key=lambda w: (-w[3], w[0] is None, w[0] or 0))
    for i, w in enumerate(able[: 20 * len(able) // 100]):
        w[4] = i + 1
    docs = spark.createDataFrame(rows, KIND).repartition(5)
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent=20, buckets=n)
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted((tuple(x) for x in got.collect()), key=order) == sorted((tuple(w[:5]) for w in want), key=order)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame(rows_of(EDGES), KIND)
    assert importance.resample(none, some).count() == 0
    assert importance.resample(some, none).count() == len(EDGES) + 3


# --- op12


def test_intervals_cover_each_order_once():
    for k in (1, 2, 3, 5):
        orders = list(permutations(range(k)))
        removed = filter_audit.interval_ends(k).reshape(1 << k, -1, k).cumsum(1)[:, :-1]
        for mask in range(1 << k):
            for i, order in enumerate(orders):
                first = next((j for j, f in enumerate(order) if mask >> f & 1), None)
                assert removed[mask, i].tolist() == [int(j == first) for j in range(k)]
        assert [filter_audit.rank_of(o, k) for o in orders] == list(range(len(orders)))


def test_audit_equals_applying_every_order(spark):
    r = random.Random(3)
    words = ["one", "two", "SHOUT", "cash$", "three", "four", *(f"w{i}" for i in range(60))]
    texts = [*EDGES, *(" ".join(r.choices(words[: r.choice([6, 66])], k=r.choice([20, 70, 90]))) for _ in range(40))]
    texts += r.choices(texts, k=15)
    rows = rows_of(texts)
    marks = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, len(texts), 2)] + [(4, 1, 1), (None, 1, 1)]
    good, toxic = {i for i, q, _ in marks if q == 1 and i is not None}, {i for i, _, t in marks if t == 1 and i is not None}
    first = {}
    for row in rows:
        t, i = row[1] or "", row[0]
        first[t] = min((x for x in (first.get(t), i) if x is not None), default=None)
    failing = []
    for row in rows:
        t = row[1] or ""
        w = SPACED.findall(t)
        copy = first[t] is not None and row[0] != first[t]
        tests = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        failing.append((row[2] or "", row[0], {x for x, bad in tests.items() if bad}))
    want = {}
    for part in {p for p, _, _ in failing}:
        own, shapley = [(i, f) for p, i, f in failing if p == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), counts in want.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    docs, labels = spark.createDataFrame(rows, KIND).repartition(3), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in filter_audit.COUNTS] for x in filter_audit.audit_documents(docs, labels).collect()}
    assert got == want
    assert filter_audit.audit_documents(spark.createDataFrame([], KIND), labels).count() == 0


# --- op13


def components(rows, words, percent):
    sets = []
    for row in rows:
        w = SPACED.findall(lowered(row[1]))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = {row[0]: row[0] for row in rows if row[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if None not in (rows[a][0], rows[b][0]) and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return Counter((row[0], len(s), None if row[0] is None else find(row[0])) for row, s in zip(rows, sets, strict=True))


def crowded(seed):
    """Near copies around several thresholds, passages that many texts share, and texts of frequent words alone."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(EDGES)
    for _ in range(3):
        base = r.choices(vocabulary, k=r.choice([30, 90]))
        for _ in range(25):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    passage = " ".join(r.choices(vocabulary, k=60))
    texts += [passage + " " + " ".join(r.choices(vocabulary, k=r.randrange(12))) for _ in range(30)]
    texts += [" ".join(r.choices(vocabulary[:3], k=r.randrange(1, 40))) for _ in range(20)]
    return rows_of(texts)


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (2, 60)])
def test_join_equals_brute_force(spark, words, percent):
    rows = crowded(words)
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    want = components(rows, words, percent)
    assert Counter(tuple(x) for x in jaccard_join.jaccard_components(docs, words, percent).collect()) == want
    assert Counter(tuple(x) for x in neardup.near_duplicates(docs, words, percent).collect()) == want or percent < 80  # bands suit 80 % and more


def test_join_in_small_tiles_with_shared_and_changed_ids(spark, monkeypatch):
    """Tiles of few documents, one class for all shingles, and two texts under one id."""
    monkeypatch.setattr(tiles, "OUTSIDERS", 3)
    monkeypatch.setattr(tiles, "TILE", 4)
    rows = [row for row in crowded(9) if row[0] is None or row[0] % 2 == 0 or row[0] < 40]
    rows += [(12, rows[40][1], "", *[None] * 9), (60, rows[30][1], "", *[None] * 9)]
    docs = spark.createDataFrame(rows, KIND)
    assert Counter(tuple(x) for x in jaccard_join.jaccard_components(docs, 4, 85).collect()) == components(rows, 4, 85)


def test_ids_by_bitmap(spark, monkeypatch):
    """More ids than are sent: a bitmap settles most rows, the others are joined."""
    docs = spark.range(-500, 2000).withColumnRenamed("id", "doc_id").unionByName(spark.createDataFrame([(None,)], "doc_id bigint"))
    ids = docs.where("doc_id % 7 = 0")
    monkeypatch.setattr(neardup, "BIT_SLOTS", 1)
    for few in (10_000, 3):
        monkeypatch.setattr(neardup, "FEW_IDS", few)
        assert neardup.among(docs, ids).count() == ids.count()
        assert neardup.among(docs, ids, some=False).where("doc_id is null or doc_id % 7 <> 0").count() == 2501 - ids.count()
        assert neardup.among(docs, ids, some=False).count() == 2501 - ids.count()
    rows = crowded(7)
    assert Counter(tuple(x) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, KIND), 4, 85).collect()) == components(rows, 4, 85)


def test_sets_are_moved_once_and_cuts_leave_the_disk(spark, monkeypatch):
    """However many hubs two documents meet by, each is in one group; what is not read again leaves the shared folder."""
    cuts = {}
    real = tiles.materialize
    monkeypatch.setattr(tiles, "materialize", lambda df, name: cuts.setdefault(name, real(df, name)))
    monkeypatch.setattr(tiles, "discard", lambda *cuts: None)
    before = set(session._cuts)
    rows = crowded(2)
    docs = spark.createDataFrame(rows, KIND)
    assert Counter(tuple(x) for x in jaccard_join.jaccard_components(docs, 2, 60).collect()) == components(rows, 2, 60)
    members = cuts["tile-members"]
    assert members.count() == members.select("doc_id").distinct().count() > 5
    left = [x.rpartition("/")[2] for x in session._cuts if x not in before]
    assert not [x for x in left if x.startswith(("join-shared", "join-ties", "join-tested", "join-marks"))]


def test_prefixes_share_what_they_ask_for():
    """Two sets that are similar enough share as many prefix shingles as the smaller need, whatever each one took."""
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 50, jaccard_join.CLASSES)
    excess = np.maximum(counts - 5, 0)
    needs = set()
    for _ in range(400):
        n, d = int(rng.integers(1, 400)), int(rng.integers(0, 40))
        base = np.unique(rng.integers(0, 1 << 63, n + d, dtype=np.uint64) * np.uint64(2))
        a, b = base[: len(base) - d // 2], base[d - d // 2 :]
        if not len(a) or not len(b) or 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)):
            continue
        (x, _, p), (y, _, q) = (jaccard_join.prefix_of(np.sort(s), counts, excess, 85) for s in (a, b))
        needs |= {x + -(-85 * len(a) // 100), y + -(-85 * len(b) // 100)}
        assert len(np.intersect1d(p, q)) >= -(-85 * (len(a) + len(b)) // 185) + min(x, y)
    assert len(needs) > 2


def test_join_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(spark.createDataFrame([], KIND)).count() == 0


# --- the registered queries


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_filter_audit", "op13_jaccard_join"])
def test_registered(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [c for c, kind in got.dtypes if kind not in ("bigint", "int", "string")]
    assert got.where(F.lit(True)).count() == (200 if name != "op12_filter_audit" else 600 * 20)

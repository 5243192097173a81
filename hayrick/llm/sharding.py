"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

A node that still has to give several shards is cut along the dimension in which it is widest (relative to the
whole table) so that each side's bytes match the number of shards on that side. The cut is found without sorting:
a histogram of bytes over the dimension is summed by Spark and refined inside the bin where the cut falls. The
driver sees at most BINS rows per open node.

Equal texts are one point. Groups of them that weigh enough to upset a cut are placed first, the heaviest first, each
whole into the shard with the most room, and the cuts of the tree deal the rest into the room that is left. Only a
group that no shard has room for (one heavier than a shard's share, as a rule) is divided.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.llm.common import few, ranks, small_table
from hayrick.session import materialize

BIN_BITS = 11
BINS = 1 << BIN_BITS
#: A cut may be off by this part of its node's bytes before the histogram is refined again.
SLACK = 0.0005
#: Groups of two or more equal texts heavier than this part of a shard are placed before the cuts; there are at most shards / WEIGHTY.
WEIGHTY = 0.005
_VALUE_BITS, _TIE_BITS = 30, 32


def _place(groups: list[tuple[int, int]], share: float, shards: int) -> tuple[list[int | None], list[float]]:
    """The shard of every group (None: divided) and the bytes placed in each shard. Groups are (key, bytes)."""
    load, where = [0.0] * shards, {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        shard = min(range(shards), key=lambda i: (load[i], i))
        if load[shard] + size <= share:
            load[shard] += size
            where[key] = shard
    return [where.get(key) for key, _ in groups], load


def _points(docs: DataFrame, id_col: str, text_col: str, dims: list[str], shards: int) -> tuple[DataFrame, DataFrame, list[float]]:
    """(points to be dealt by the tree, rows whose shard is settled, bytes settled in each shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
        *[F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(dims)],
    )
    rows = materialize(rows, "shard-rows")
    for i in range(len(dims)):  # values by their rank among all distinct values; null is below them
        order = ranks(rows, f"m{i}")
        order = F.broadcast(order) if few(order, f"m{i}") else order
        rows = rows.join(order, f"m{i}", "left").withColumn(f"x{i}", F.coalesce("rank", F.lit(-1.0))).drop(f"m{i}", "rank")
    rows = materialize(rows, "shard-ranked")
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = total / shards
    xs = [f"x{i}" for i in range(len(dims))]
    groups = materialize(rows.groupBy("text_key", "text_crc32").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("copies"), *[F.min(x).alias(x) for x in xs]), "shard-groups")
    weighty = groups.where((F.col("copies") > 1) & (F.col("group_size") > F.lit(WEIGHTY * share))).select("text_key", "text_crc32", "group_size", *xs).collect()  # at most shards / WEIGHTY
    where, load = _place([((r["text_key"], r["text_crc32"]), r["group_size"]) for r in weighty], share, shards)
    settled = small_table(
        docs.sparkSession,
        [(r["text_key"], r["text_crc32"], s, max(1, math.ceil(r["group_size"] / max(1.0, WEIGHTY * share))), *[r[x] for x in xs]) for r, s in zip(weighty, where, strict=True)],
        ", ".join(["text_key bigint, text_crc32 bigint, shard int, pieces int", *[f"{x} double" for x in xs]]),
    )
    keys = ["text_key", "text_crc32"]
    known = rows.drop(*xs).join(F.broadcast(settled), keys)
    whole = known.where(F.col("shard").isNotNull()).select("doc_id", "size", "text_crc32", "shard")
    piece = F.pmod(F.xxhash64("doc_id", "size"), F.col("pieces"))
    divided = known.where(F.col("shard").isNull()).withColumn("tie", F.xxhash64("text_key", "text_crc32", piece))
    light = rows.drop(*xs).join(F.broadcast(settled.select(*keys)), keys, "left_anti").join(groups.select(*keys, *xs), keys).withColumn("tie", F.xxhash64("text_key", "text_crc32", F.lit(0).cast("bigint")))
    columns = ["doc_id", "size", "text_crc32", *xs, F.log(F.col("size").cast("double")).alias(f"x{len(dims)}"), F.shiftrightunsigned("tie", 64 - _TIE_BITS).alias("tie"), F.lit(0).alias("node")]
    return materialize(light.select(*columns).unionByName(divided.select(*columns)), "shard-points"), materialize(whole, "shard-settled"), load


def _keyed(rows: DataFrame, cuts: list[dict]) -> DataFrame:
    """Each row of a node that is to be cut, with its position along the node's widest dimension."""
    spark = rows.sparkSession
    table = small_table(spark, [(c["node"], c["dim"], c["lo"], c["hi"]) for c in cuts], "node int, dim int, lo double, hi double")
    n = sum(1 for c in rows.columns if c[0] == "x" and c[1:].isdigit())
    value = F.element_at(F.array(*[F.col(f"x{i}") for i in range(n)]), F.col("dim") + 1)
    part = F.when(F.col("hi") > F.col("lo"), (value - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    key = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)) * float((1 << _VALUE_BITS) - 1)).cast("bigint") * F.lit(1 << _TIE_BITS) + F.col("tie")
    return rows.join(F.broadcast(table), "node", "left").withColumn("key", F.when(F.col("dim").isNotNull(), key)).drop("dim", "lo", "hi")


def _find_cuts(rows: DataFrame, cuts: list[dict]) -> None:
    """Sets each cut's ``at``: rows whose key is below it go left. Refines all nodes' histograms together."""
    spark = rows.sparkSession
    keyed = _keyed(rows, cuts).where("key is not null").select("node", "key", "size")
    for c in cuts:
        c |= {"base": 0, "below": 0, "shift": _VALUE_BITS + _TIE_BITS - BIN_BITS, "goal": c["bytes"] * c["part"]}
    open_cuts = list(cuts)
    while open_cuts:
        view = small_table(spark, [(c["node"], c["base"], c["shift"]) for c in open_cuts], "node int, base bigint, shift int")
        offset = F.expr("shiftright(key - base, shift)")
        sums = keyed.join(F.broadcast(view), "node").withColumn("bin", offset).where((F.col("bin") >= 0) & (F.col("bin") < BINS)).groupBy("node", "bin").agg(F.sum("size").alias("bytes")).collect()
        by_node: dict[int, list] = {}
        for r in sums:
            by_node.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        again = []
        for c in open_cuts:
            upto, hit, weight = c["below"], None, 0
            for b, w in sorted(by_node.get(c["node"], [])):
                if upto + w >= c["goal"]:
                    hit, weight = b, w
                    break
                upto += w
            if hit is None:
                c["at"] = c["base"] + (BINS << c["shift"])
                continue
            start = c["base"] + (hit << c["shift"])
            if weight <= SLACK * c["bytes"] or c["shift"] == 0:
                c["at"] = start + (1 << c["shift"]) if upto + weight - c["goal"] < c["goal"] - upto else start
            else:
                finer = max(0, c["shift"] - BIN_BITS)
                c |= {"base": start, "below": upto, "shift": finer}
                again.append(c)
        open_cuts = again


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Deals all rows to ``shards`` shards of near equal bytes: doc_id, size, text_crc32, shard, slot.

    Dimensions are the named metadata columns, each by the rank of its value among the distinct values, and the logarithm
    of the size. Equal texts stay in one shard unless no shard has room for all of them, in which case they are divided
    by a hash of doc_id.

    Defined cases: null text counts as empty (size 1, crc 0); null metadata sorts first; repeated rows are dealt
    like any others; with fewer rows than shards some shards stay empty; an empty table gives an empty result. Slots
    number a shard's rows without gaps from 0.
    """
    rows, whole, load = _points(docs, id_col, text_col, list(dims), shards)
    share = rows.agg(F.sum("size")).first()[0] or 0
    share = (share + sum(load)) / shards
    room = [max(share - x, 0.0) for x in load]
    n = len(dims) + 1
    plan, span = {0: (0, shards)}, None
    while todo := {k: v for k, v in plan.items() if v[1] > 1}:
        stats = rows.where(F.col("node").isin(*todo)).groupBy("node").agg(F.sum("size").alias("bytes"), *[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(n) for f in (F.min, F.max)]).collect()
        if not stats:
            break
        if span is None:
            span = [(stats[0][f"max{i}"] - stats[0][f"min{i}"]) or 1.0 for i in range(n)]
        cuts = []
        for r in stats:
            widest = max(range(n), key=lambda i: ((r[f"max{i}"] - r[f"min{i}"]) / span[i], -i))
            first, count = todo[r["node"]]
            left = count // 2
            part = sum(room[first : first + left]) / (sum(room[first : first + count]) or 1.0)
            cuts.append({"node": r["node"], "dim": widest, "lo": r[f"min{widest}"], "hi": r[f"max{widest}"], "bytes": r["bytes"], "left": left, "part": part})
        _find_cuts(rows, cuts)
        new, moved = dict(plan), []
        for c in cuts:
            first, count = new.pop(c["node"])
            left, right = 2 * c["node"] + 1, 2 * c["node"] + 2
            new[left], new[right] = (first, c["left"]), (first + c["left"], count - c["left"])
            moved.append((c["node"], c["at"], left, right))
        for k in todo.keys() - {c["node"] for c in cuts}:
            new[k] = (plan[k][0], 1)
        table = small_table(rows.sparkSession, moved, "node int, at bigint, l int, r int")
        side = F.when(F.col("at").isNull(), F.col("node")).when(F.col("key") < F.col("at"), F.col("l")).otherwise(F.col("r"))
        rows = _keyed(rows, cuts).join(F.broadcast(table), "node", "left").withColumn("node", side.cast("int")).drop("at", "l", "r", "key")
        rows = materialize(rows, "shard-level")
        plan = new
    leaves = small_table(rows.sparkSession, [(k, v[0]) for k, v in plan.items()], "node int, shard int")
    return with_slots(rows.join(F.broadcast(leaves), "node").select("doc_id", "size", "text_crc32", "shard").unionByName(whole))


def with_slots(rows: DataFrame, per_bucket: int = 10_000) -> DataFrame:
    """Numbers each shard's rows from 0: hash buckets are numbered apart and shifted by the counts before them."""
    rows = materialize(rows, "shard-of-row")
    buckets = max(16, min(1 << 16, -(-rows.count() // (8 * per_bucket))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = materialize(counts.select("shard", "bucket", before.alias("offset")), "shard-offsets")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("number", number)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("number") - 1).cast("bigint").alias("slot"))
    )

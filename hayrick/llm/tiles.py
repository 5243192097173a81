"""Links inside crowds: documents that share a hub, but are not all linked to it.

Members of a hub that are outside its component meet the hub's other members in tiles of bounded size, with their marks
alone (a few numbers a document), which tell who may link to whom. Members that no other one of about their size and of
another component stands beside stay away. Only who is joined by such pairs leaves a tile, not the pairs, so a tile
gives fewer rows than it has documents. Whatever hubs they met by, documents joined in that way form groups, and a
document is in one group alone: its full set is moved once, to the tiles of its group, not to the tiles of every hub.
Only links that join two components leave these. Hubs, and groups, of few members share a tile, in which the
members of different ones do not meet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hayrick.llm.components import connected_components
from hayrick.session import discard, materialize

#: Outsiders and other documents of a hub that meet in one tile.
OUTSIDERS, TILE = 256, 512
#: Members of crowds (of about 100 bytes) that are sent to the marks at most; more are joined by a shuffle.
FEW = 100_000
KEYS = ["crowd", "o", "m"]

#: Takes marks, needs and set sizes of a tile's other documents; the result tells, for those of one, whom it may link to.
Near = Callable[[list[np.ndarray], np.ndarray, np.ndarray], Callable[[np.ndarray, int, int], np.ndarray]]


def sketches_within(limit: int) -> Near:
    """Marks are odd sketches, which differ in at most ``limit`` bits."""

    def of(marks: list[np.ndarray], needs: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray, int, int], np.ndarray]:
        bits = np.stack(marks).view(np.uint64)
        return lambda own, need, n: np.bitwise_count(bits ^ own.view(np.uint64)).sum(1) <= limit

    return of


def prefixes_share(percent: int) -> Near:
    """Marks are prefix tokens, of which two documents share the smaller need more than the overlap of similar sets."""

    def of(marks: list[np.ndarray], needs: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray, int, int], np.ndarray]:
        size = np.array([len(m) for m in marks])
        flat, begin = np.concatenate(marks), np.cumsum(size) - size

        def one(own: np.ndarray, need: int, n: int) -> np.ndarray:
            own = np.sort(own)
            hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            return np.add.reduceat(hit, begin, dtype=np.int64) >= np.minimum(needs, need) - (-percent * (sizes + n) // (100 + percent))

        return one

    return of


def _partners(outs: pd.DataFrame, others: pd.DataFrame, near: Near, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the outsider, numbers of the others that it may link to): of the same hub and another component, and
    neither size, nor the distances to the hub (by the triangle inequality, where both are known), nor the marks rule it
    out."""
    reach = 1 - percent / 100 + 1e-9
    own = outs.groupby("hub", sort=False).indices
    for hub, at in others.groupby("hub", sort=False).indices.items():
        if hub not in own:
            continue
        some = others.iloc[at]
        size, dist, comp = (some[c].to_numpy() for c in ("n", "dist", "c"))
        able = near([np.asarray(m) for m in some["mark"]], some["need"].to_numpy(np.int64), size)
        for i, o in zip(own[hub].tolist(), outs.iloc[own[hub]].itertuples(), strict=True):
            open_ = (comp != o.c) & (100 * np.minimum(size, o.n) >= percent * np.maximum(size, o.n)) & ~(np.abs(dist - o.dist) > reach)
            if open_.any():
                yield i, at[open_ & able(np.asarray(o.mark), o.need, o.n)]


def _alone(outs: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """The outsiders of a tile: of a crowd of one tile they are sent once, among the others."""
    return outs if len(outs) else others[others["out"].astype(bool)]


def _who(near: Near, percent: int):
    """(a, b): documents of a tile that pairs connect, each with one of them."""

    def run(outs: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        outs = _alone(outs, others)
        ids, at = np.unique(np.concatenate([outs["doc_id"].to_numpy(np.int64), others["doc_id"].to_numpy(np.int64)]), return_inverse=True)
        root, mine, theirs = np.arange(len(ids)), at[: len(outs)], at[len(outs) :]
        if len(outs) and len(others):
            for i, found in _partners(outs, others, near, percent):
                joined = np.append(root[theirs[found]], root[mine[i]])
                if joined.min() < joined.max():
                    root[np.isin(root, joined)] = joined.min()
        more = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[more], "b": ids[root[more]]})

    return lambda outs, others: run(outs, others)


def _meet(near: Near, percent: int):
    def run(outs: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found, outs = [], _alone(outs, others)
        if len(outs) and len(others):
            sets, ids = [np.asarray(x) for x in others["shingles"]], others["doc_id"].to_numpy()
            size = np.array([len(x) for x in sets])
            names, group = np.unique(np.concatenate([outs["c"].to_numpy(), others["c"].to_numpy()]), return_inverse=True)
            root = np.arange(len(names))  # components that links of this tile have joined have one root
            mine, theirs = group[: len(outs)], group[len(outs) :]
            for i, at in _partners(outs, others, near, percent):
                at = at[ids[at] < outs["doc_id"].iloc[i]]  # both are on both sides
                own = np.asarray(outs["shingles"].iloc[i])
                for k in range(0, len(at), 64):
                    part = at[k : k + 64]
                    part = part[root[theirs[part]] != root[mine[i]]]
                    if not len(part):
                        continue
                    flat = np.concatenate([sets[j] for j in part])
                    hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    common = np.add.reduceat(hit, np.cumsum(size[part]) - size[part], dtype=np.int64)
                    for j in part[100 * common >= percent * (size[part] + len(own) - common)]:
                        if root[theirs[j]] != root[mine[i]]:
                            root[root == root[theirs[j]]] = root[mine[i]]
                            found.append((outs["doc_id"].iloc[i], ids[j]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return lambda outs, others: run(outs, others)


def outsider_links(stars: DataFrame, labels: DataFrame, marks: DataFrame, sets_of: Callable[[DataFrame], DataFrame], near: Near, percent: int) -> DataFrame:
    """(a, b): links that, with those in ``labels``, connect what is linked among the members of each hub.

    ``stars`` has (hub, doc_id, dist), dist being null where it is not known; ``labels`` (node, component); ``marks``
    (doc_id, n, mark, need) of all members; ``sets_of`` gives (doc_id, shingles) of some.
    """
    own = labels.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    hub = labels.select(F.col("node").alias("hub"), F.col("component").alias("hc"))
    # Rows that repeat an id have several distances and sizes, of which none can rule out a pair.
    once = stars.groupBy("hub", "doc_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("dist")).alias("dist"))
    named = once.join(own, "doc_id", "left").join(hub, "hub", "left")
    named = named.select("hub", "doc_id", "dist", F.coalesce("c", "doc_id").alias("c"), (F.coalesce("c", "doc_id") != F.coalesce("hc", "hub")).alias("out"))
    named = materialize(named, "tile-named")
    met = materialize(_beside(named, marks, percent), "tile-met")
    rows = materialize(_placed(met, marks), "tile-rows")
    discard(named, met)
    outs, others = _tiles(rows)
    who = materialize(outs.groupBy(*KEYS).cogroup(others.groupBy(*KEYS)).applyInPandas(_who(near, percent), "a bigint, b bigint"), "tile-who")
    discard(rows)
    if who.isEmpty():
        return who
    groups = materialize(connected_components(who), "tile-groups")
    discard(who)
    group = groups.select(F.col("component").alias("hub"), F.col("node").alias("doc_id"))
    group = group.join(own, "doc_id", "left").select("hub", "doc_id", F.lit(None).cast("double").alias("dist"), F.coalesce("c", "doc_id").alias("c"), F.lit(True).alias("out"))
    rows = materialize(_placed(materialize(group, "tile-group"), marks), "tile-members")
    sets = sets_of(groups.select(F.col("node").alias("doc_id")))
    few = rows.count() <= FEW
    left, right = ((F.broadcast(side) if few else side).join(sets, "doc_id").withColumn("shingles", F.sort_array("shingles")) for side in _tiles(rows))
    links = materialize(left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInPandas(_meet(near, percent), "a bigint, b bigint"), "tile-links")
    discard(rows, sets)
    return links


def _beside(named: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The rows of ``named`` whose hub has a member of another component and of a size that may be similar: sizes are classed so
    that these lie in the same class or in the next."""
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    sized = named.join(marks.groupBy("doc_id").agg(F.min("n").alias("low"), F.max("n").alias("high")), "doc_id")
    at = lambda n: F.floor(F.log(F.col(n).cast("double")) / step).cast("int")
    sized = sized.select(*named.columns, at("low").alias("low"), at("high").alias("high"))
    near = sized.select("hub", "c", F.explode(F.sequence(F.col("low") - 1, F.col("high") + 1)).alias("size"))
    near = near.groupBy("hub", "size").agg(F.min("c").alias("first"), F.max("c").alias("last")).where("first <> last").select("hub", "size")
    some = sized.select("hub", "doc_id", F.explode(F.sequence("low", "high")).alias("size")).join(near, ["hub", "size"], "left_semi").select("hub", "doc_id").distinct()
    return named.join(some, ["hub", "doc_id"], "left_semi")


def _placed(named: DataFrame, marks: DataFrame) -> DataFrame:
    """``named`` of hubs, or groups, that have outsiders and others, with their number of tiles and the marks."""
    counts = named.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("out").cast("int")).alias("outs")).where("outs > 0 and n > 1")
    counts = counts.select("hub", "n", F.ceil(F.col("outs") / OUTSIDERS).cast("int").alias("ot"), F.ceil(F.col("n") / TILE).cast("int").alias("mt"))
    small = (F.col("ot") == 1) & (F.col("mt") == 1)
    together = -(-(counts.where(small).agg(F.sum("n")).first()[0] or 0) // TILE) or 1
    counts = counts.select("hub", "ot", "mt", F.when(small, F.pmod(F.xxhash64("hub"), F.lit(together)) - together).otherwise(F.xxhash64("hub")).alias("crowd"))
    few = named.count() <= FEW
    named = named.join(counts, "hub")
    return (F.broadcast(named) if few else named).join(marks.select("doc_id", "n", "mark", "need"), "doc_id")


def _tiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The outsiders of crowds of several tiles, and the members of all, once for each tile they are in."""
    place = lambda seed, tiles: F.pmod(F.xxhash64("doc_id", F.lit(seed)), tiles).cast("int")
    every = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
    fields = ["hub", "doc_id", "out", "c", "dist", "n", "mark", "need"]
    outs = rows.where("out and (ot > 1 or mt > 1)").withColumn("o", place(1, F.col("ot"))).withColumn("m", every("mt")).select(*KEYS, *fields)
    others = rows.withColumn("m", place(2, F.col("mt"))).withColumn("o", every("ot")).select(*KEYS, *fields)
    return outs.toDF(*outs.columns), others  # new column identities: both sides stem from one table

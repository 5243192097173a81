"""Exact top-k inner-product search with dual cover trees.

Queries and candidates are indexed together at two levels. Spark assigns every vector to the nearest of a few pivots
(the shared top of the trees, fitted to a bounded sample) and records the covering radius of each pivot's cell for
queries and for candidates. A first pass lets each query meet one block of its own cell, which bounds the worst
k-th score of each query cell; cells of candidates that no bound can reach are dropped for that query cell. The
remaining (query block, candidate block) tiles are joined by key, and inside a tile two cover trees are walked
together: a pair of nodes goes when the largest inner product that its centres and radii allow is below the worst
k-th score of the queries under it.

Blocks have a bounded number of vectors: a cell that holds a third of all rows is dealt to many blocks by hash.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hayrick.llm.common import small_table
from hayrick.session import materialize

#: Vectors of one candidate block and of one query block.
BLOCK, QUERY_BLOCK = 4096, 4096
#: The pivots come from at most SAMPLE vectors, and there are at most PIVOTS of them.
SAMPLE, PIVOTS = 16384, 512
BASE, LEAF, SPREAD = 1.5, 32, 8
#: Points of candidate leaves that are compared with a query leaf at a time.
GATHER = 2048
_SCHEMA = "query_id bigint, vec_id bigint, score bigint"


class CoverTree:
    """Nodes with a centre among their points and a covering radius; children of a node lie BASE times closer.

    Children are found by farthest-point traversal, which keeps them apart by the same distance that covers the
    node's points. Nodes of at most LEAF points, and nodes of equal points, are leaves; so are nodes in which every
    SPREAD-th point or more would found a child of its own, since there distances tell nothing apart.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre, self.radius, self.low, self.high, self.children = [], [], [], [], []
        self._grow(points)

    def _node(self, centre: int, radius: float, low: int, high: int) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.centre) - 1

    def _grow(self, points: np.ndarray) -> None:
        square = (points * points).sum(1)
        first = points[0]
        far = np.sqrt(np.maximum(((points - first) ** 2).sum(1), 0))
        root = self._node(0, float(far.max()), 0, len(points))
        todo = [(root, far)]
        while todo:
            node, dist = todo.pop()
            low, high, radius = self.low[node], self.high[node], self.radius[node]
            if high - low <= LEAF or radius <= 0:
                continue
            members = self.order[low:high]
            near, owner = dist.copy(), np.zeros(len(members), np.int64)
            centres = [self.centre[node]]
            goal, most = radius / BASE, max(LEAF, len(members) // SPREAD)
            while near[top := int(near.argmax())] > goal and len(centres) <= most:
                c = members[top]
                d = np.sqrt(np.maximum(square[members] + square[c] - 2 * (points[members] @ points[c]), 0))
                d[top] = 0
                closer = d < near
                near[closer] = d[closer]
                owner[closer] = len(centres)
                centres.append(int(c))
            if len(centres) > most:
                continue
            place = np.argsort(owner, kind="stable")
            self.order[low:high] = members[place]
            near = near[place]
            at = low
            for c, n in zip(centres, np.bincount(owner, minlength=len(centres)).tolist(), strict=True):
                if n:
                    part = near[at - low : at - low + n]
                    child = self._node(c, float(part.max()), at, at + n)
                    self.children[node].append(child)
                    todo.append((child, part))
                    at += n

    def seal(self) -> CoverTree:
        self.centre, self.low, self.high = np.array(self.centre), np.array(self.low), np.array(self.high)
        # Distances come from rounded sums: a small margin keeps the bounds valid.
        self.radius = np.array(self.radius) * (1 + 1e-9) + 1e-3
        self.norm = np.sqrt((self.points[self.centre] ** 2).sum(1))
        return self


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: through floats where every sum stays below 2^53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**52:
        return np.rint(a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def dual_search(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of each query's k best points other than itself, ties to smaller ids.

    ``floor`` holds k-th scores already known for the queries; worse points may be left out.
    """
    q, r = CoverTree(queries).seal(), CoverTree(points).seal()
    none, far = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best_score, best_id = np.full((len(queries), k), none), np.full((len(queries), k), far)
    worst = floor.astype(np.float64).copy()

    def bounds(node: int, cand: np.ndarray) -> np.ndarray:
        dot = points[r.centre[cand]] @ queries[q.centre[node]]
        return dot + q.norm[node] * r.radius[cand] + q.radius[node] * (r.norm[cand] + r.radius[cand]) + 1e-3

    def base_case(members: np.ndarray, own: np.ndarray) -> None:
        score = _products(queries[members], points[own])
        score[query_ids[members][:, None] == ids[own][None, :]] = none
        scores = np.concatenate([best_score[members], score], 1)
        labels = np.concatenate([best_id[members], np.broadcast_to(ids[own], score.shape)], 1)
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > none))
        s, i = scores[row, col], labels[row, col]
        order = np.lexsort((i, -s, row))
        row, s, i = row[order], s[order], i[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        top = place < k
        best_score[members], best_id[members] = none, far
        best_score[members[row[top]], place[top]] = s[top]
        best_id[members[row[top]], place[top]] = i[top]
        kth = best_score[members, k - 1]
        worst[members] = np.maximum(worst[members], np.where(kth == none, -np.inf, kth.astype(np.float64)))

    todo = [(0, np.array([0]))]
    while todo:
        node, cand = todo.pop()
        members = q.order[q.low[node] : q.high[node]]
        keep = bounds(node, cand) >= worst[members].min()
        cand = cand[keep]
        # Candidates go down one level where they can, then the query node does.
        cand = np.array([c for x in cand.tolist() for c in (r.children[x] or [x])], np.int64)
        if not len(cand):
            continue
        if q.children[node]:
            todo += [(child, cand) for child in q.children[node]]
            continue
        while len(cand):
            bound = bounds(node, cand)
            keep = bound >= worst[members].min()
            cand, bound = cand[keep], bound[keep]
            leaf = np.array([not r.children[x] for x in cand.tolist()], bool)
            place = np.argsort(-bound[leaf], kind="stable")
            leaves, best = cand[leaf][place], bound[leaf][place]
            size = np.cumsum(r.high[leaves] - r.low[leaves])
            at = 0
            while at < len(leaves) and best[at] >= worst[members].min():
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GATHER, "right")))
                base_case(members, np.concatenate([r.order[r.low[x] : r.high[x]] for x in leaves[at:end]]))
                at = end
            inner = cand[~leaf]
            cand = np.array([c for x in inner.tolist() for c in r.children[x]], np.int64)
    row, col = np.nonzero(best_id != far)
    return row, best_id[row, col], best_score[row, col]


def _search_tile(k: int):
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(map(len, [*queries["v"], *points["v"]]))
        queries, points = queries.drop_duplicates("vec_id"), points.sort_values("vec_id")
        a, b = _matrix(queries["v"], width), _matrix(points["v"], width)
        at, ids, score = dual_search(a, queries["vec_id"].to_numpy(), b, points["vec_id"].to_numpy(), k, queries["floor"].to_numpy())
        return pd.DataFrame({"query_id": queries["vec_id"].to_numpy()[at], "vec_id": ids, "score": score})

    return lambda q, p: run(q, p)


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-point traversal of the sample: the top level that both sides share."""
    chosen = [0]
    near = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds each vector's nearest pivot and its distance to it."""
    packed = rows.sparkSession.sparkContext.broadcast(pickle.dumps(pivots))  # at most PIVOTS vectors
    norm = (pivots * pivots).sum(1)

    def run(it):
        centres = pickle.loads(packed.value)
        for pdf in it:
            for a in range(0, len(pdf), 2048):
                part = pdf.iloc[a : a + 2048]
                x = _matrix(part["v"], centres.shape[1])
                d = (x * x).sum(1)[:, None] + norm - 2 * (x @ centres.T)
                cell = d.argmin(1)
                exact = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                yield part.assign(cell=cell.astype("int32"), dist=exact)

    return rows.mapInPandas(run, "vec_id bigint, v array<bigint>, is_query boolean, cell int, dist double")


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): components as floor(scale * x); vectors that are null or hold a null or non-finite component go."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("x", lambda x: F.floor(F.lit(scale) * x).cast("bigint")).alias("v"))


def _tour(points: np.ndarray) -> list[int]:
    """The rows of ``points`` in an order in which neighbours lie near: always on to the nearest one left."""
    left, at = list(range(1, len(points))), [0] if len(points) else []
    while left:
        near = ((points[left] - points[at[-1]]) ** 2).sum(1).argmin()
        at.append(left.pop(int(near)))
    return at


def query_blocks(cells: list[tuple[int, int]], size: int) -> dict[int, tuple[int, int]]:
    """(first block, number of blocks) of every query cell, given cells in order with their numbers of queries.

    A cell of more than ``size`` queries has blocks of its own; smaller ones share a block up to ``size``.
    """
    out, block, fill = {}, -1, size
    for cell, n in cells:
        if n > size:
            out[cell] = (block + 1, -(-n // size))
            block, fill = block + out[cell][1], size
        else:
            if fill + n > size:
                block, fill = block + 1, 0
            fill += n
            out[cell] = (block, 1)
    return out


def open_cells(pivots: np.ndarray, cells: np.ndarray, radius: np.ndarray, asking: np.ndarray, reach: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """(len(asking), len(cells)) of bool: whether a candidate of the cell can reach the query cell's worst k-th score.

    ``radius`` are the covering radii of the candidates of ``cells``, ``reach`` those of the queries of ``asking``.
    """
    norm = np.sqrt((pivots * pivots).sum(1))
    bound = pivots[asking] @ pivots[cells].T + norm[asking][:, None] * radius + reach[:, None] * (norm[cells] + radius) + 1e-3
    return bound >= worst[:, None]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK, query_block: int = QUERY_BLOCK, most_pivots: int = PIVOTS, seen: dict | None = None,
) -> DataFrame:
    """Each query's k best other vectors by integer inner product: query_id, rank (from 1), vec_id, score.

    ``is_query`` is a condition on vec_id. Blocks hold about ``block`` candidates and ``query_block`` queries; there is a
    pivot for every ``block`` vectors, up to ``most_pivots``. ``seen``, if given, takes the numbers of pivots, of query
    blocks and of (query, candidate) pairs in all and in the tiles that were left open.

    Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors are padded
    with zeros; ties go to the smaller vec_id; rows that repeat a vec_id count once, with the best of their scores (a
    query: one of its rows); a query without others has no rows; other columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale).withColumn("is_query", is_query)
    rows = materialize(rows, "topk-vectors")
    total, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(width or 0, 1)
    unit = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(3)), 11).cast("double") / float(1 << 53)
    sample = rows.where(unit < min(1.0, SAMPLE / max(total, 1))).select("v").limit(2 * SAMPLE).toPandas()
    pivots = _pivots(_matrix(sample["v"], width), max(1, min(most_pivots, total // block))) if len(sample) else np.zeros((1, width))

    rows = materialize(_assign(rows, pivots), "topk-cells")
    asks = F.col("is_query")
    by_cell = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r"), F.count(F.when(asks, 1)).alias("nq"), F.max(F.when(asks, F.col("dist"))).alias("rq")).toPandas()  # a row per pivot
    cells, sizes = by_cell["cell"].to_numpy(), by_cell["n"].to_numpy()
    blocks = -(-sizes // block)
    asking = np.flatnonzero(by_cell["nq"].to_numpy() > 0)
    asking = asking[_tour(pivots[cells[asking]])]
    dealt = query_blocks([(int(cells[i]), int(by_cell["nq"][i])) for i in asking], query_block)
    shape = small_table(spark, [(int(c), int(b)) for c, b in zip(cells, blocks, strict=True)], "cell int, blocks int")
    points = rows.join(F.broadcast(shape), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    points = points.select("vec_id", "v", "cell", "block")
    own = small_table(spark, [(c, a, n) for c, (a, n) in dealt.items()], "cell int, first int, parts int")
    queries = rows.where("is_query").join(F.broadcast(own), "cell").withColumn("qblock", (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("parts"))).cast("int"))

    def search(asked_for: DataFrame, among: DataFrame) -> DataFrame:
        keys = ["cell", "block", "qblock"]
        asked_for = asked_for.toDF(*asked_for.columns)  # new column identities: both sides stem from one table
        found = asked_for.groupBy(*keys).cogroup(among.groupBy(*keys)).applyInPandas(_search_tile(k), _SCHEMA)
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def copied(some: DataFrame, to: list[tuple[int, int, int]]) -> DataFrame:
        """Candidates of a cell once for every query block of the ranges (cell, first, parts); at most PIVOTS^2 ranges."""
        table = spark.createDataFrame(pd.DataFrame(to, columns=["cell", "first", "parts"]).astype("int32"), "cell int, first int, parts int")
        spread = F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1))
        return some.join(F.broadcast(table), "cell").select("vec_id", "v", "cell", "block", spread.alias("qblock"))

    # First pass: each query against block 0 of its own cell gives k-th scores to start from.
    near = queries.select("vec_id", "v", "cell", F.lit(0).alias("block"), "qblock", F.lit(-math.inf).alias("floor"))
    first = search(near, copied(points.where("block = 0"), [(c, a, n) for c, (a, n) in dealt.items()]))
    kth = materialize(first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor")), "topk-floor")
    queries = queries.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))
    queries = materialize(queries.dropDuplicates(["vec_id"]), "topk-queries")

    # Cells that a query cell's worst k-th score leaves open.
    worst = {r["cell"]: r["w"] for r in queries.groupBy("cell").agg(F.min("floor").alias("w")).collect()}
    is_open = open_cells(pivots, cells, by_cell["r"].to_numpy(), cells[asking], by_cell["rq"].to_numpy()[asking], np.array([worst[int(c)] for c in cells[asking]]))
    if seen is not None:
        pairs = by_cell["nq"].to_numpy()[asking][:, None] * sizes
        seen |= {"pivots": len(pivots), "query_blocks": sum(n for _, n in set(dealt.values())), "pairs": int(pairs.sum()), "open_pairs": int(pairs[is_open].sum())}
    a, b = np.nonzero(is_open)
    pairs = spark.createDataFrame(pd.DataFrame({"cell": cells[asking[a]], "other": cells[b], "blocks": blocks[b]}).astype("int32"), "cell int, other int, blocks int")
    ranges = {(int(cells[y]), *dealt[int(cells[asking[x]])]) for x, y in zip(a, b, strict=True)}
    wide = queries.join(F.broadcast(pairs), "cell").select("vec_id", "v", F.col("other").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qblock", "floor")
    out = search(wide, copied(points, sorted(ranges)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

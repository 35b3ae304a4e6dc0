"""Approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

Unit vectors are projected by a few normal (2-stable) random directions: the squared projected distance over the squared
distance is chi-square distributed. The top of one kd-tree over all projections is fitted on a bounded sample; every row is
placed in one of its regions, and each region grows the rest of the tree from its own rows. A query visits its own region
first, then the next nearest ones in rounds, each four times as far as the one before, and leaves off as soon as a vector
nearer than the k-th found so far would, with the given confidence, have been projected nearer than the next region or leaf.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import scratch

#: Projected dimensions (even), confidence of the stopping test, points of a leaf.
DIMENSIONS, CONFIDENCE, LEAF = 8, 0.98, 32
#: Rows of a region, about (a larger one is dealt to several tasks), most levels of the top of the tree, rows of its sample: at least, and for each region.
REGION, LEVELS, SAMPLE, EACH = 1 << 14, 15, 1 << 15, 8
#: Differences of scores and of squared distances of unit vectors that rounding may make.
SLACK = 1e-12
#: Queries that are searched at once: with REGION the bound of a task's memory.
ROUND = 256


def _chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function for an even number m of degrees of freedom."""
    half = np.minimum(np.where(np.isfinite(x), x, 1e6), 1e6) / 2
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(m // 2))


def _sure(away: np.ndarray, kth: np.ndarray) -> np.ndarray:
    """Whether nothing at this squared projected distance is nearer than the squared distance kth, with confidence. Distances within rounding are none."""
    away = np.where(away < SLACK, 0.0, away)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(kth > 0, away / kth, np.where(away > 0, np.inf, 0.0))
    return _chi_square(np.where(np.isinf(kth), 0.0, ratio), DIMENSIONS) >= CONFIDENCE


def _even(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component is near one: exact, and norms neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Tree:
    """A complete kd-tree: node n splits at cut[n] of axis[n], its children are 2n + 1 and 2n + 2; low and high bound each node."""

    def __init__(self, points: np.ndarray, depth: int, tight: bool) -> None:
        """tight: nodes are bounded by their points, not by the splits above them (then points placed later are inside too)."""
        self.depth, nodes = depth, (1 << (depth + 1)) - 1
        d = points.shape[1]
        self.axis, self.cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes)
        self.low, self.high = np.full((nodes, d), -np.inf), np.full((nodes, d), np.inf)
        own = {0: np.arange(len(points))}
        self.leaves: list[np.ndarray] = []
        for node in range(nodes):
            rows = own.pop(node)
            p = points[rows]
            if tight and len(rows):
                self.low[node], self.high[node] = p.min(axis=0), p.max(axis=0)
            elif tight:
                self.low[node] = np.inf
            if node >= nodes // 2:
                self.leaves.append(rows)
                continue
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0))) if len(rows) else 0
            half = len(rows) // 2
            by = np.argpartition(p[:, axis], half) if len(rows) else rows  # by rank, so that ties split too
            cut = float(p[by[half], axis]) if len(rows) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            for child in (2 * node + 1, 2 * node + 2):
                self.low[child], self.high[child] = self.low[node], self.high[node]
            self.high[2 * node + 1, axis] = self.low[2 * node + 2, axis] = cut
            own[2 * node + 1], own[2 * node + 2] = rows[by[:half]], rows[by[half:]]

    def place(self, points: np.ndarray) -> np.ndarray:
        """The leaf (from 0) in whose region each point lies."""
        node = np.zeros(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - ((1 << self.depth) - 1)

    def _away(self, points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = np.maximum(0, np.maximum(self.low[nodes] - points, points - self.high[nodes]))
        return (gap**2).sum(axis=-1)

    def within(self, points: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, squared distance) of every leaf that the stopping test leaves to a point, by descent from the root."""
        which, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        away = self._away(points, node)
        for _ in range(self.depth):
            which = np.repeat(which, 2)
            node = (2 * node[:, None] + np.array([1, 2])).reshape(-1)
            away = self._away(points[which], node)
            go = ~_sure(away, kth[which]) & np.isfinite(away)
            which, node, away = which[go], node[go], away[go]
        return which, node - ((1 << self.depth) - 1), away


class Index:
    """The rows of a region: points of equal direction share one, of which the `keep` smallest ids can be in an answer."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray, keep: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], _even(vectors[order])
        _, first, back = np.unique(self.vectors, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(back.reshape(-1), kind="stable")
        starts = np.searchsorted(back.reshape(-1)[by], np.arange(len(first)))
        self.members = [by[a:b][:keep] for a, b in zip(starts, [*starts[1:], len(by)], strict=True)]
        self.unit = _unit(self.vectors[first])
        self.directions = directions
        points = self.unit @ directions
        self.tree = Tree(points, max(0, math.ceil(math.log2(max(1, len(points)) / LEAF))), tight=True)
        self.leaf = np.full((len(self.tree.leaves), max(1, max(map(len, self.tree.leaves)))), -1)
        for k, x in enumerate(self.tree.leaves):
            self.leaf[k, : len(x)] = x

    def search(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        out = []
        for a in range(0, len(ids), ROUND):
            out += self._round(ids[a : a + ROUND], _even(queries[a : a + ROUND]), kth[a : a + ROUND], k)
        return out

    def _visit(self, active: np.ndarray, leaf: np.ndarray, unit: np.ndarray) -> None:
        cand = self.leaf[leaf]
        score = np.einsum("qld,qd->ql", self.unit[cand], unit[active])
        score[cand < 0] = -np.inf
        both, own = np.concatenate([self.best[active], score], axis=1), np.concatenate([self.which[active], cand], axis=1)
        top = np.argsort(-both, axis=1, kind="stable")[:, : self.best.shape[1]]
        self.best[active], self.which[active] = np.take_along_axis(both, top, 1), np.take_along_axis(own, top, 1)

    def _tied(self, unit: np.ndarray, p: np.ndarray, kth: np.ndarray) -> list[np.ndarray]:
        """For each query the points that were kept, and all that score within rounding of the least of them: which of these come first, exact scores and ids decide."""
        last = self.best[:, -1]
        which, leaf, _ = self.tree.within(p, np.minimum(kth, 2 - 2 * last) + SLACK)
        found = [[x[x >= 0]] for x in self.which]
        for a in range(0, len(which), 4 * ROUND):
            own = which[a : a + 4 * ROUND]
            cand = self.leaf[leaf[a : a + 4 * ROUND]]
            near = (np.einsum("qld,qd->ql", self.unit[cand], unit[own]) >= last[own, None] - SLACK) & (cand >= 0)
            for q, at in zip(*np.nonzero(near), strict=True):
                found[own[q]].append(cand[q, at : at + 1])
        return [np.unique(np.concatenate(x)) for x in found]

    def _round(self, ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        unit = _unit(queries)
        p = unit @ self.directions
        want = k + 1  # the query's own point may be among them
        self.best, self.which = np.full((len(ids), want), -np.inf), np.full((len(ids), want), -1)
        home = self.tree.place(p)
        self._visit(np.arange(len(ids)), home, unit)
        bound = lambda rows: np.minimum(kth[rows], 2 - 2 * self.best[rows, -1])  # noqa: E731  the squared distance of unit vectors
        which, leaf, away = self.tree.within(p, bound(np.arange(len(ids))))
        rest = leaf != home[which]
        which, leaf, away = which[rest], leaf[rest], away[rest]
        order = np.lexsort([away, which])
        which, leaf, away = which[order], leaf[order], away[order]
        turn = np.arange(len(which)) - np.searchsorted(which, which)
        by = np.argsort(turn, kind="stable")
        cuts = np.searchsorted(turn[by], np.arange(turn.max(initial=-1) + 2))
        for a, z in zip(cuts, cuts[1:], strict=False):  # the nearest leaf of each query, then the next
            step = by[a:z]
            step = step[~_sure(away[step], bound(which[step]))]
            if len(step):
                self._visit(which[step], leaf[step], unit)
        out = []
        norms = np.linalg.norm(queries, axis=1)
        for q, (qid, found) in enumerate(zip(ids.tolist(), self._tied(unit, p, kth), strict=True)):
            rows = np.concatenate([self.members[x] for x in found]) if len(found) else np.zeros(0, dtype=np.int64)
            rows = rows[self.ids[rows] != qid]
            v = self.vectors[rows]
            exact = (v * queries[q]).sum(axis=1) / (np.linalg.norm(v, axis=1) * norms[q])
            out += [(qid, int(self.ids[r]), float(-x)) for x, r in sorted(zip((-exact).tolist(), rows.tolist(), strict=True))[:k]]
        return out


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of a column, shorter ones with zeros at their end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(column.flatten())
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest cosine found for each row whose vec_id is divisible by `every`.

    All other rows are candidates, nearest first, ties to the smaller vec_id. Rows with a null vec_id, and vectors that are
    null, empty, zero, or hold null or non-finite components, take no part. A shorter vector counts as if it ended in zeros;
    lengths may be as large or small as doubles go. Rows that repeat a vec_id are candidates each, but a query is searched
    once and never finds its own vec_id. Fewer candidates than k are all given; an empty table gives no rows. Scores are
    exact, of the original vectors in double precision; which rows are found is approximate, with a recall of 0.9 or more in
    tests. Columns other than vec_id and embedding are not read.

    The top of the tree has REGION rows a region, about, and LEVELS levels at most; it is fitted on the projections of SAMPLE
    rows, or EACH for a region if that is more (the least by a hash of vec_id), while every row is placed and searched. A query descends it
    to the regions that its stopping test leaves. A region with more rows, as of one vector
    that a third of the rows repeat, is dealt to several tasks by a hash of vec_id. Each round sends a query only to the
    regions that its stopping test leaves, and rows meet queries by region.
    """
    spark = vectors.sparkSession
    clean = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    clean = clean.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    rows, width = clean.agg(F.count("*"), F.max(F.size("embedding"))).first()
    directions = np.random.default_rng(seed).standard_normal((width or 1, DIMENSIONS))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _unit(_even(_matrix(b.column(1), width))) @ directions
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(p), pa.list_(pa.float64()))], ["vec_id", "p"])

    depth = min(LEVELS, max(0, math.ceil(math.log2(max(1, rows) / REGION))))
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, EACH << depth)).mapInArrow(project, "vec_id long, p array<double>").orderBy("vec_id").collect()
    top = Tree(np.array([r.p for r in sample]).reshape(-1, DIMENSIONS), depth, tight=False)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            region = top.place(_unit(_even(_matrix(b.column(1), width))) @ directions)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], ["vec_id", "embedding", "region"])

    placed = scratch.cut(clean.mapInArrow(place, "vec_id long, embedding array<double>, region long"))
    ways = placed.groupBy("region").agg(F.ceil(F.count("*") / (2 * REGION)).cast("int").alias("ways"))  # one row for each region
    dealt = placed.join(F.broadcast(ways), "region").withColumn("way", F.pmod(F.xxhash64("vec_id"), F.col("ways")).cast("int")).drop("ways")
    queries = scratch.cut(placed.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).select("vec_id", "embedding"))

    def route(near: int, far: int):  # noqa: ANN202
        """Each query with its own region (near = 0), or with the near-th to far-th of the others that its stopping test leaves, the nearest first."""

        some = max(1, min(ROUND, (1 << 20) >> depth))  # a query may have to look at every region

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, some):
                    own = b.slice(a, some)
                    p = _unit(_even(_matrix(own.column(1), width))) @ directions
                    home = top.place(p)
                    if near:
                        q, at, away = top.within(p, np.asarray(own.column(2).fill_null(np.inf)))
                        other = at != home[q]
                        q, at, away = q[other], at[other], away[other]
                        order = np.lexsort([at, away, q])
                        q, at = q[order], at[order]
                        turn = np.arange(len(q)) - np.searchsorted(q, q) + 1
                        q, at = q[(turn >= near) & (turn < far)], at[(turn >= near) & (turn < far)]
                    else:
                        q, at = np.arange(len(p)), home
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(q)) for c in own.columns), pa.array(at.astype(np.int64))], ["vec_id", "embedding", "kth", "region"])

        return run

    def search(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if len(own) and len(asked):
            index = Index(own.column("vec_id").to_numpy(), _matrix(own.column("embedding"), width), directions, k + 1)
            kth = asked.column("kth").combine_chunks().fill_null(np.inf)
            found = index.search(asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding"), width), np.asarray(kth), k)
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    near, far = 0, 1
    while near < 1 << depth:
        kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (2 - 2 * F.col("score")).alias("kth"))
        asked = scratch.cut(queries.join(kth, "vec_id", "left").select("vec_id", "embedding", "kth").mapInArrow(route(near, far), "vec_id long, embedding array<double>, kth double, region long"))
        if near and asked.isEmpty():
            break
        asked = asked.join(F.broadcast(ways), "region").withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
        found = dealt.groupBy("region", "way").cogroup(asked.groupBy("region", "way")).applyInArrow(search, "query_id long, vec_id long, score double")
        both = best.select("query_id", "vec_id", "score").unionByName(found)
        best = scratch.cut(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        near, far = far, 4 * far
    return best.select("query_id", "rank", "vec_id", "score")

"""Nearest neighbours by inner product with vantage-point trees per shard.

All vectors are divided by the length of the longest; then x becomes (x, sqrt(1 - x.x)) and a query
(q, 0): the squared distance between them is 1 + q.q - 2 q.x, so the largest inner product is the
smallest distance and the triangle inequality holds. Rows go to shards by the top of a vantage-point
tree that is laid out over a sample; each shard has a tree of its own. A part is left out where `relax`
times its lower bound is beyond the k-th distance known: at 1 nothing that counts is, and the search
is exact. How much larger it may be depends on the vectors' dimensions, so it is tuned on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.llm.common import discard, materialise
from arenalake.llm.pstable import usable

K, EVERY = 20, 20
#: Lower bounds are stretched by one of these before they are compared with the k-th distance; 1 is exact.
#: The first that finds TARGET of the neighbours of TUNE_QUERIES of the first TUNE_ROWS sampled rows is taken.
FACTORS, TARGET, TUNE_ROWS, TUNE_QUERIES = (12.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.6, 1.3, 1.0), 0.98, 4096, 256
#: Rows of a shard: SHARD_LEAST, and 8 sqrt(n) for larger tables, SHARD_MOST at most (its vectors fit a task).
SHARD_LEAST, SHARD_MOST = 2048, 131_072
#: Rows that lay out the top of the tree, those with the smallest hashes; a place of the top holds TOP_LEAST of them or more.
SAMPLE, TOP_LEAST = 16_384, 16
#: Rounding of distances between vectors of length 1 at most, also where they are near 0.
SLACK = 1e-7
#: Vectors of a leaf of a shard's tree; queries that meet a shard in one task.
LEAF, QUERY_BLOCK = 128, 1024


def shard_rows(n: int) -> int:
    return int(min(SHARD_MOST, max(SHARD_LEAST, 8 * n**0.5)))


def lifted(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 at most with the component that makes it 1."""
    rest = np.sqrt(np.maximum(1 - (v * v).sum(axis=1, keepdims=True), 0.0))
    return np.hstack((v, rest))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a (queries) from those of b."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


@dataclass
class Node:
    """A part of the rows: begin..end of the order, and how far the rows of its halves are from the vantage point."""

    begin: int
    end: int
    point: np.ndarray | None = None
    #: Largest distance within the near half and smallest one within the far half; also the outer ends.
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    halves: tuple[int, int] = (-1, -1)


def grow(x: np.ndarray, leaf: int, parts: int | None = None) -> tuple[list[Node], np.ndarray]:
    """Nodes (the first is the root) and order of the rows, so that every node is a slice of it.

    The vantage point is the row farthest from a node's first one. Halves have equal numbers, so
    equal distances, and equal rows, make no node deeper. parts: split the largest node until
    there are so many leaves.
    """
    order = np.arange(len(x))
    nodes = [Node(0, len(x))]
    todo = [0]
    leaves = 1
    while todo:
        at = todo.pop(0)
        node = nodes[at]
        size = node.end - node.begin
        if size <= leaf or parts is not None and leaves >= parts:
            continue
        own = order[node.begin : node.end]
        first = distances(x[own[:1]], x[own])[0]
        point = x[own[int(first.argmax())]]
        d = distances(point[None], x[own])[0]
        by = np.argsort(d, kind="stable")
        half = size // 2
        order[node.begin : node.end], d = own[by], d[by]
        node.point, node.near, node.far = point, (float(d[0]), float(d[half - 1])), (float(d[half]), float(d[-1]))
        node.halves = len(nodes), len(nodes) + 1
        nodes += [Node(node.begin, node.begin + half), Node(node.begin + half, node.end)]
        todo += node.halves
        leaves += 1
    return nodes, order


def beyond(d: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    """Lower bound of the distance to any row that is `ends` from the vantage point, d being the query's: the triangle inequality."""
    return np.maximum(np.maximum(d - ends[1], ends[0] - d), 0.0)


class Shard:
    """A vantage-point tree over the distinct vectors of a shard; a vector holds the k + 1 smallest ids
    that have it, as no query can need more."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, scale: float, k: int):
        by = np.argsort(ids, kind="stable")
        ids, v = ids[by], v[by]
        bits = np.ascontiguousarray(v + 0.0).view(np.dtype((np.void, v.shape[1] * 8))).ravel()
        _, first, which = np.unique(bits, return_index=True, return_inverse=True)
        lists: list[list[int]] = [[] for _ in first]
        for i, c in zip(ids.tolist(), which.tolist(), strict=True):
            if len(lists[c]) <= k:
                lists[c].append(i)
        x = lifted(v[first] / scale)
        self.nodes, order = grow(x, LEAF)
        self.x, self.v = np.ascontiguousarray(x[order]), np.ascontiguousarray(v[first][order])
        self.ids = [lists[i] for i in order.tolist()]
        self.k = k

    def search(self, q: np.ndarray, bar: np.ndarray, relax: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each query (lifted) the rows that may be among its k nearest, and how many distances were taken.

        bar: distances that k other rows are known to be within. Queries first meet the leaf they
        fall into, which lowers their bars; then the tree is walked once with all of them.
        """
        best = np.tile(bar[:, None], (1, self.k + 1))
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        home = np.full(len(q), -1)
        taken = 0

        def meet(at: int, some: np.ndarray) -> None:
            nonlocal taken
            node = self.nodes[at]
            d = distances(q[some], self.x[node.begin : node.end])
            taken += d.size
            i, j = np.nonzero(d <= best[some].max(axis=1)[:, None] + SLACK)
            seen.append((some[i], node.begin + j, d[i, j]))
            best[some] = np.partition(np.hstack((best[some], d)), self.k, axis=1)[:, : self.k + 1]

        def falls(at: int, some: np.ndarray) -> None:
            node = self.nodes[at]
            if node.point is None:
                home[some] = at
                meet(at, some)
                return
            d = distances(q[some], node.point[None])[:, 0]
            inside = beyond(d, node.near) <= beyond(d, node.far)
            for half, those in zip(node.halves, (some[inside], some[~inside]), strict=True):
                if len(those):
                    falls(half, those)

        def walk(at: int, some: np.ndarray, bound: np.ndarray) -> None:
            open_ = relax * bound <= best[some].max(axis=1) + SLACK
            some, bound = some[open_], bound[open_]
            if not len(some):
                return
            node = self.nodes[at]
            if node.point is None:
                other = some[home[some] != at]
                if len(other):
                    meet(at, other)
                return
            d = distances(q[some], node.point[None])[:, 0]
            for half, ends in zip(node.halves, (node.near, node.far), strict=True):
                walk(half, some, np.maximum(bound, beyond(d, ends)))

        if len(self.x) and len(q):
            falls(0, np.arange(len(q)))
            walk(0, np.arange(len(q)), np.zeros(len(q)))
        none = [np.zeros(0, np.int64)]
        who, row, d = (np.concatenate(c) for c in zip(*seen, strict=True)) if seen else (none * 2 + [np.zeros(0)])
        fine = d <= best[who].max(axis=1) + SLACK
        who, row = who[fine], row[fine]
        by = np.argsort(who, kind="stable")
        cut = np.searchsorted(who[by], np.arange(len(q) + 1))
        return [row[by[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)], taken

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, scale: float, relax: float) -> tuple[list[tuple[int, int, float]], int]:
        """(query id, row id, score) of each query's k best rows here; scores are products of the vectors as given."""
        asked = np.hstack((q / scale, np.zeros((len(q), 1))))
        rows, taken = self.search(asked, bar, relax)
        out = []
        for i, own, some in zip(q_ids.tolist(), q, rows, strict=True):
            score = products(self.v[some], own)
            held = [(-s, r) for s, c in zip(score.tolist(), some.tolist(), strict=True) for r in self.ids[c] if r != i]
            out += [(i, r, -s) for s, r in sorted(held)[: self.k]]
        return out, taken


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, so that equal rows have equal products wherever they stand."""
    return (rows * q).sum(axis=1) + 0.0


def tuned(v: np.ndarray, scale: float, k: int) -> float:
    """The largest of FACTORS that finds TARGET of the nearest rows within v; 1 for too few rows to tell."""
    if len(v) < 10 * k:
        return 1.0
    shard, ids = Shard(np.arange(len(v)), v, scale, k), np.arange(len(v))[:TUNE_QUERIES]
    found = lambda factor: {x[:2] for x in shard.nearest(ids, v[ids], np.full(len(ids), np.inf), scale, factor)[0]}
    want = found(1.0)
    return next(f for f in FACTORS if len(found(f) & want) >= TARGET * len(want))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass
class Top:
    """The top of the tree for vectors of one length: nodes, the leaf number of each (-1 inside), the
    length of the longest vector, by which all are divided, and the factor for lower bounds."""

    nodes: list[Node]
    leaf: list[int]
    scale: float
    relax: float

    @classmethod
    def laid_out(cls, v: np.ndarray, scale: float, parts: int, k: int = K, relax: float | None = None) -> Top:
        nodes, _ = grow(lifted(v / scale), 2 * TOP_LEAST, parts)
        number = iter(range(len(nodes)))
        return cls(nodes, [next(number) if n.point is None else -1 for n in nodes], scale, relax or tuned(v[:TUNE_ROWS], scale, k))

    def placed(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each lifted row: near where it is as near as the near half reaches."""
        out = np.zeros(len(x), np.int64)

        def falls(at: int, some: np.ndarray) -> None:
            node = self.nodes[at]
            if node.point is None:
                out[some] = self.leaf[at]
                return
            inside = distances(x[some], node.point[None])[:, 0] <= node.near[1]
            for half, those in zip(node.halves, (some[inside], some[~inside]), strict=True):
                if len(those):
                    falls(half, those)

        falls(0, np.arange(len(x)))
        return out

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds (query x leaf) of the distances of lifted queries from what lies in the leaves."""
        out = np.zeros((len(x), max(self.leaf) + 1))

        def walk(at: int, bound: np.ndarray) -> None:
            node = self.nodes[at]
            if node.point is None:
                out[:, self.leaf[at]] = bound
                return
            d = distances(x, node.point[None])[:, 0]
            walk(node.halves[0], np.maximum(bound, d - node.near[1]))
            walk(node.halves[1], np.maximum(bound, node.near[1] - d))

        walk(0, np.zeros(len(x)))
        return out


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, x (doubles), d: usable vectors, one per vec_id."""
    one = vectors.where(F.col("vec_id").isNotNull() & usable()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return one.select("vec_id", F.transform("embedding", lambda e: e.cast("double")).alias("x"), F.size("embedding").alias("d"))


def _tops(rows: DataFrame, n: int, k: int, relax: float | None) -> dict[int, Top]:
    """Tops by length of vector. What comes to the driver: SAMPLE vectors and two numbers per length."""
    largest = F.array_max(F.transform("x", F.abs))
    about = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(largest).alias("scale"))
    scaled = rows.join(F.broadcast(about), "d").withColumn("unit", F.transform("x", lambda e: e / F.col("scale")))
    square = F.aggregate("unit", F.lit(0.0), lambda a, e: a + e * e)
    about = scaled.groupBy("d").agg(F.max("n").alias("n"), F.max("scale").alias("scale"), F.max(square).alias("square")).collect()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("d", "x").toPandas()
    drawn = {d: _matrix(g["x"]) for d, g in sample.groupby("d")}
    size = shard_rows(n)
    return {r["d"]: Top.laid_out(drawn.get(r["d"], np.zeros((0, r["d"]))), r["scale"] * r["square"] ** 0.5, -(-r["n"] // size), k, relax) for r in about}


def _shards(rows: DataFrame, tops, size: int) -> DataFrame:
    """rows with their shard: a leaf of the top, or a part of one that holds more than `size` rows.

    A leaf is split by hashes of ids, so that many equal vectors are many parts.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby("d"):
                top = tops.value[d]
                yield part.assign(leaf=top.placed(lifted(_matrix(part["x"]) / top.scale)))

    placed = materialise(rows.mapInPandas(place, "vec_id bigint, x array<double>, d int, leaf bigint"), "placed")
    parts = placed.groupBy("d", "leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    return placed.join(F.broadcast(parts), ["d", "leaf"]).withColumn("part", part)  # a row per leaf: SAMPLE / TOP_LEAST, and the lengths


def _meet(asks: DataFrame, rows: DataFrame, tops, k: int) -> DataFrame:
    """query_id, vec_id, score: each ask's k best rows of the shard (d, leaf, part) that it names.

    A shard that more than QUERY_BLOCK asks enter meets them in several tasks.
    """
    shard = ["d", "leaf", "part"]
    many = asks.groupBy(*shard).agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    asked = asks.join(F.broadcast(many), shard).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    held = rows.select(*shard, "vec_id", "x").join(F.broadcast(many), shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def search(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "taken": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "taken": "int64"})
        if not len(asking) or not len(held):
            return none
        top = tops.value[key[0]]
        shard = Shard(held["vec_id"].to_numpy(np.int64), _matrix(held["x"]), top.scale, k)
        asking = asking.sort_values("query_id")
        q = _matrix(asking["x"])
        out, taken = shard.nearest(asking["query_id"].to_numpy(np.int64), q, reach(q, asking["bar"].to_numpy(np.float64), top), top.scale, top.relax)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).assign(taken=taken // len(asking)) if out else none

    pairs = asked.groupBy(*shard, "block").cogroup(held.groupBy(*shard, "block"))
    return pairs.applyInPandas(search, "query_id bigint, vec_id bigint, score double, taken bigint")


def reach(q: np.ndarray, bar: np.ndarray, top: Top) -> np.ndarray:
    """Distances that belong to the scores `bar` (-inf: none is known)."""
    unit = q / top.scale
    return np.sqrt(np.maximum(1 + (unit * unit).sum(axis=1) - 2 * bar / top.scale**2, 0.0))


def search(vectors: DataFrame, every: int = EVERY, k: int = K, relax: float | None = None) -> DataFrame:
    """query_id, vec_id, score, taken (distances per query of the shard): candidates, a query's k nearest found among them.

    1. The top of the tree deals rows to shards.
    2. A query meets the shard it falls into; its k-th score there is its bar.
    3. It enters the other shards whose bound does not rule them out. Only these pairs are shuffled.
    """
    spark = vectors.sparkSession
    rows = materialise(_rows(vectors), "vectors")
    n = rows.count()
    tops = spark.sparkContext.broadcast(_tops(rows, n, k, relax))  # at most SAMPLE / TOP_LEAST vectors
    sharded = materialise(_shards(rows, tops, shard_rows(n)), "shards")
    discard(rows)
    per_leaf = {d: g.groupby("leaf")["parts"].first().to_dict() for d, g in sharded.select("d", "leaf", "parts").distinct().toPandas().groupby("d")}
    parts = spark.sparkContext.broadcast(per_leaf)  # a number per leaf
    asks = sharded.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "x", "d")
    entry = "query_id bigint, x array<double>, d int, leaf bigint, part int, bar double"

    def enter(own: bool):
        def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for d, some in pdf.groupby("d"):
                    top, many = tops.value[d], parts.value[d]
                    q = _matrix(some["x"])
                    x = np.hstack((q / top.scale, np.zeros((len(q), 1))))
                    leaves = np.array(sorted(many))
                    bound = top.bounds(x)[:, leaves]
                    home = leaves[bound.argmin(axis=1)]  # of the leaves that hold rows
                    ids = some["query_id"].to_numpy(np.int64)
                    home_part = np.array([hash(int(i)) % many[h] for i, h in zip(ids.tolist(), home.tolist(), strict=True)], np.int64)
                    if own:
                        yield some.assign(leaf=home, part=home_part, bar=-np.inf)
                        continue
                    bar = some["bar"].to_numpy(np.float64)
                    i, at = np.nonzero(top.relax * bound <= reach(q, bar, top)[:, None] + SLACK)
                    times = np.array([many[h] for h in leaves.tolist()])[at]
                    i, leaf = np.repeat(i, times), np.repeat(leaves[at], times)
                    part = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                    new = (leaf != home[i]) | (part != home_part[i])
                    i, leaf, part = i[new], leaf[new], part[new]
                    for begin in range(0, len(i), 4096):
                        cut = slice(begin, begin + 4096)
                        yield some.iloc[i[cut]].assign(leaf=leaf[cut], part=part[cut])[["query_id", "x", "d", "leaf", "part", "bar"]]

        return entries

    first = materialise(_meet(asks.mapInPandas(enter(True), entry), sharded, tops, k), "home")
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bars = first.withColumn("r", F.row_number().over(ranked)).where(F.col("r") == k).select("query_id", F.col("score").alias("bar"))
    barred = asks.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    others = materialise(barred.mapInPandas(enter(False), entry), "entries")
    return first.unionByName(_meet(others, sharded, tops, k))


def nearest_neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, relax: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found per query, ties to smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows of the query's
    length but its own. Scores are products in double precision of the vectors as given. Vectors
    that are null, empty or zero, or hold null or non-finite components, take no part, nor do rows
    with a null vec_id. Of rows that repeat a vec_id the least vector counts. Extra columns are
    ignored; an empty table gives an empty table. relax = 1 gives the exact result; None tunes it on a sample.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = search(vectors, every, k, relax).drop("taken")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

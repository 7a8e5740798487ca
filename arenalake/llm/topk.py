"""Exact top-k search with multi-resolution segment statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from arenalake.llm.common import discard, materialise

K, SCALE = 10, 1024
#: Segments of the coarsest statistics, by which rows are dealt to blocks and blocks are bounded.
COARSE = 4
#: Rows of a block and queries that meet it in one task; no more blocks than MOST_BLOCKS, as their bounds are broadcast.
ROW_BLOCK, QUERY_BLOCK, MOST_BLOCKS = 8192, 1024, 50_000
#: Integer products below this are exact in double precision, those below the second in 64-bit integers.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, (1 << 63) - 1


def resolutions(d: int) -> list[int]:
    """Numbers of segments of a vector of d components, coarse to fine: pairs of components at last."""
    out, s = [], COARSE
    while s < d // 2:
        out.append(s)
        s *= 4
    return [*out, max(1, d // 2)]


def segment_statistics(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: means and deviations of its segments, each times the root of the segment's length.

    With them, x.y <= sum over segments of (mean.mean + deviation.deviation), by Cauchy and
    Schwarz on what each segment has beyond its mean. As |x-y|^2 = |x|^2 + |y|^2 - 2 x.y, an upper
    bound of the product is a lower bound of the distance.
    """
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    size = np.diff(edges)
    mean = np.add.reduceat(v, edges[:-1], axis=1) / size
    beyond = v - np.repeat(mean, size, axis=1)
    return mean * np.sqrt(size), np.sqrt(np.add.reduceat(beyond * beyond, edges[:-1], axis=1))


def block_bounds(mean: np.ndarray, dev: np.ndarray, low: np.ndarray, high: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """Bounds (query x block) of the products with any row of a block whose means lie in [low, high]
    and whose deviations are `widest` at most."""
    side = np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T
    return side + dev @ widest.T


def exact_products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products of 64-bit rows with q, exact; those beyond 64 bits count as the ends of their range."""
    most = lambda a: max(int(a.max(initial=0)), -int(a.min(initial=0)))
    reach = most(rows) * most(q) * len(q)
    if reach < EXACT_DOUBLE:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if reach <= EXACT_LONG:
        return rows @ q
    wide = rows.astype(object) @ q.astype(object)
    return np.array([min(max(int(x), -EXACT_LONG - 1), EXACT_LONG) for x in wide], np.int64)


def top_of_block(q: np.ndarray, q_ids: np.ndarray, bars: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row id, score) of each query's k best rows, ties to smaller ids, and how many
    rows each query scored exactly. Integer vectors; bars are scores that k rows are known to reach.

    Rows whose bound is under the bar go, resolution by resolution; what survives is scored. ids ascend.
    """
    at_q, at_id, at_score, scored = [], [], [], np.zeros(len(q), np.int64)
    qf, rf = q.astype(np.float64), rows.astype(np.float64)
    slack = 0.5 + 1e-12 * rf.shape[1] * np.sqrt((qf * qf).sum(1)) * np.sqrt((rf * rf).sum(1)).max(initial=0)
    stats = [(np.hstack(segment_statistics(qf, s)), np.hstack(segment_statistics(rf, s))) for s in resolutions(q.shape[1])]
    for i in range(len(q)):
        bar = bars[i] - slack[i]
        left = np.flatnonzero(stats[0][1] @ stats[0][0][i] >= bar)
        for mine, theirs in stats[1:]:
            left = left[theirs[left] @ mine[i] >= bar]
        left = left[ids[left] != q_ids[i]]
        score = exact_products(rows[left], q[i])
        best = np.lexsort((ids[left], ~score))[:k]  # ~ descends and can't overflow
        scored[i] = len(left)
        at_q.append(np.full(len(best), i))
        at_id.append(ids[left][best])
        at_score.append(score[best])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at_q + none), np.concatenate(at_id + none), np.concatenate(at_score + none), scored


def _arrays(pdf: pd.DataFrame, ids: str = "vec_id", values: str = "v") -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(ids, kind="stable")
    return pdf[ids].to_numpy(np.int64), np.stack(pdf[values].to_numpy()).astype(np.int64)


def _whole_vectors(vectors: DataFrame, every: int) -> DataFrame:
    """vec_id, v (integer components), d (their number), ask, and place: where the coarse means lie."""
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    one = vectors.where(F.col("vec_id").isNotNull() & sound).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE).cast("long"))
    one = one.select("vec_id", whole.alias("v"), (F.col("vec_id") % every == 0).alias("ask")).withColumn("d", F.size("v"))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby("d"):
                mean, _ = segment_statistics(np.stack(part["v"].to_numpy()).astype(np.float64), COARSE)
                # Signs and magnitudes of the means, so that rows of like statistics are neighbours in order.
                cell = np.clip(np.round(mean / (np.abs(mean).max(axis=1, keepdims=True) + 1e-9) * 2) + 2, 0, 4).astype(np.int64)
                yield part.assign(place=cell @ (5 ** np.arange(cell.shape[1])[::-1]))

    return one.mapInPandas(placed, "vec_id bigint, v array<bigint>, ask boolean, d int, place bigint")


def _bars(k: int):
    """Of a block: each query's k-th score among the block's rows, and the block's bounds."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = _arrays(pdf)
        asks = pdf.sort_values("vec_id", kind="stable")["ask"].to_numpy(bool)
        mean, dev = segment_statistics(v.astype(np.float64), COARSE)
        bars = []
        for i in np.flatnonzero(asks):
            score = np.sort(np.delete(exact_products(v, v[i]), i))
            bars.append({"vec_id": int(ids[i]), "bar": float(score[-k]) if len(score) >= k else -np.inf})
        return pd.DataFrame({
            "block": [int(pdf["block"].iloc[0])], "d": [v.shape[1]], "low": [mean.min(0).tolist()], "high": [mean.max(0).tolist()],
            "widest": [dev.max(0).tolist()], "longest": [float(np.sqrt((v.astype(np.float64) ** 2).sum(1)).max())], "bars": [bars],
        })

    return settle


def search(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, vec_id, score of each query's k best rows of every block that it had to enter, and
    scored: how many rows of the block it scored exactly. See exact_top_k.

    1. Rows go to blocks of like coarse statistics (range partitions of their place).
    2. A query's k-th score within its own block is its bar everywhere.
    3. A block whose bound is under a query's bar is not entered; only queries that enter meet its rows.
    4. There, rows go by finer and finer statistics, and survivors are scored.
    """
    spark = vectors.sparkSession
    placed = materialise(_whole_vectors(vectors, every), "integers")
    n = placed.count()
    size = max(ROW_BLOCK, -(-n // MOST_BLOCKS))
    # Rows of one place or vector may be many: vec_id splits them, so a block stays near its size.
    dealt = placed.repartitionByRange(max(1, -(-n // size)), "d", "place", "vec_id").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt.select("vec_id", "v", "ask", F.struct("part", "d").alias("b")), "dealt")
    discard(placed)
    dealt = dealt.withColumn("block", F.col("b.part").cast("long") * (1 << 31) + F.col("b.d"))
    about = "block bigint, d int, low array<double>, high array<double>, widest array<double>, longest double, bars array<struct<vec_id:bigint,bar:double>>"
    blocks = materialise(dealt.select("block", "vec_id", "v", "ask").groupBy("block").applyInPandas(_bars(k), about), "blocks")
    bars = blocks.select(F.explode("bars").alias("q")).select("q.*")
    # At most MOST_BLOCKS rows of 12 numbers (and one more block per length of vector).
    bounds = spark.sparkContext.broadcast({d: g for d, g in blocks.drop("bars").toPandas().groupby("d")})

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby(pdf["v"].map(len)):
                there = bounds.value[d]
                q = np.stack(part["v"].to_numpy()).astype(np.float64)
                low, high, widest = (np.stack(there[c].to_numpy()) for c in ("low", "high", "widest"))
                for at in range(0, len(part), 256):
                    some, bar = q[at : at + 256], part["bar"].to_numpy()[at : at + 256]
                    slack = 0.5 + 1e-12 * d * np.sqrt((some * some).sum(1))[:, None] * there["longest"].to_numpy()
                    i, b = np.nonzero(block_bounds(*segment_statistics(some, COARSE), low, high, widest) + slack >= bar[:, None])
                    yield pd.DataFrame({"vec_id": part["vec_id"].to_numpy()[at + i], "bar": bar[i], "block": there["block"].to_numpy()[b]})

    asks = dealt.where("ask").select("vec_id", "v").join(bars, "vec_id")
    entries = materialise(asks.mapInPandas(enter, "vec_id bigint, bar double, block bigint"), "entries")
    # A block that more than QUERY_BLOCK queries enter meets them in several tasks.
    parts = entries.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("parts"))
    queries = entries.join(dealt.where("ask").select("vec_id", "v"), "vec_id").join(F.broadcast(parts), "block")
    queries = queries.select("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v", "bar")
    rows = dealt.join(F.broadcast(parts), "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v")
    rows = rows.toDF("in_block", "in_part", "held_id", "held")

    def best(key: tuple, asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": []}).astype("int64")
        q_ids, q = _arrays(asking)
        bar = asking.sort_values("vec_id", kind="stable")["bar"].to_numpy()
        ids, v = _arrays(held, "held_id", "held")
        i, at, score, scored = top_of_block(q, q_ids, bar, v, ids, k)
        # A query without a row here still reports what it scored: nothing.
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": at, "score": score, "scored": scored[i]})

    pairs = queries.groupBy("block", "part").cogroup(rows.groupBy("in_block", "in_part"))
    return pairs.applyInPandas(best, "query_id bigint, vec_id bigint, score bigint, scored bigint")


def exact_top_k(vectors: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products, ties to smaller vec_id.

    Components become floor(1024 x), held to the range of a long, as are scores: products are exact,
    and those beyond that range count as its ends. Queries are the rows whose vec_id is divisible
    by `every`; candidates are all rows of the query's length but its own. Vectors that are null or
    empty, or hold null or non-finite components, take no part, nor do rows with a null vec_id. Of
    rows that repeat a vec_id the least vector counts. Extra columns are ignored.
    """
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = search(vectors, every, k).drop("scored")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Embedding near-dedup by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalake.llm.common import hot_limit, join_apart, materialise
from arenalake.llm.components import connected_components

THRESHOLD = 0.95
#: Width of a cell; about 2.2 needs the fewest tables for a recall.
WIDTH, SEED = 2.2, 20240517
#: At the threshold a pair meets in some table with at least this probability; closer pairs more often.
RECALL = 0.997
#: Unrelated vectors that a bucket holds, about.
BUCKET = 20
#: Rows of a bucket that are compared in one task; larger buckets are split into pairs of blocks.
BLOCK = 1500
#: Rows of small buckets that share a task's group, about.
GROUP_ROWS = 6000


def agreement(cosine: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two unit vectors of this cosine into one cell."""
    c = math.sqrt(2 - 2 * cosine)
    return math.erf(width / c / math.sqrt(2)) - 2 * c / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-(width**2) / (2 * c * c)))


def hash_plan(n: int) -> tuple[int, int]:
    """(projections, tables) for n vectors: one rule at every size.

    Projections keep the number of unrelated vectors in a bucket at about BUCKET; tables bring the
    recall back that longer keys lose, so they grow with n to the power 0.19.
    """
    projections = max(8, math.ceil(math.log(max(n, 2) / BUCKET) / -math.log(agreement(0.0))))
    return projections, math.ceil(math.log(1 - RECALL) / math.log(1 - agreement(THRESHOLD) ** projections))


def usable(vector: str = "embedding"):
    """Condition: not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


@lru_cache(2)
def _projections(d: int, projections: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.standard_normal((d, tables * projections)), rng.uniform(0, WIDTH, tables * projections)
    return a, b, rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1


def bucket_keys(v: np.ndarray, projections: int, tables: int) -> np.ndarray:
    """Bucket of each normalised row in each table: quantised Gaussian projections, hashed to 64 bits."""
    a, b, mix = _projections(v.shape[1], projections, tables)
    cells = np.floor((v @ a + b) / WIDTH).astype(np.int64).reshape(len(v), tables, projections)
    return (cells * mix).sum(axis=2)


def _normalised(column: pd.Series) -> np.ndarray:
    v = np.stack(column.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares of tiny or huge components stay finite
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of n nodes under links x-y."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            return root


def _meeting(run: np.ndarray, part: np.ndarray, row: np.ndarray, col: np.ndarray):
    """Index pairs (i, j) of rows that share a run, in bounded portions.

    A whole bucket pairs each row with those after it; of a bucket's blocks (row, col) those of
    one block meet those of the other.
    """
    n = len(run)
    last = np.searchsorted(run, run, side="right")
    if (row == col).all():
        for step in range(1, int((last - np.arange(n)).max(initial=1))):
            i = np.flatnonzero(np.arange(n) + step < last)
            for at in range(0, len(i), 100_000):
                yield i[at : at + 100_000], i[at : at + 100_000] + step
    else:
        left, right = np.flatnonzero(part == row), np.flatnonzero(part == col)
        for at in range(0, len(left), 64):
            some = left[at : at + 64]
            yield np.repeat(some, len(right)), np.tile(right, len(some))


def _link_group(pdf: pd.DataFrame, projections: int, tables: int) -> pd.DataFrame:
    """Links within buckets of one table: per vector the vectors that its links lead to, and the smallest
    of its component among these links. A pair counts in the first table where its keys agree, so
    none counts twice; the keys of the tables before are made anew for the vectors of links.
    """
    pdf = pdf.sort_values(["key", "vec_id"])
    ids, t, size = pdf["vec_id"].to_numpy(np.int64), int(pdf["t"].iloc[0]), pdf["size"].to_numpy(np.int64)
    key = pdf["key"].to_numpy(np.int64)
    run = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    v = _normalised(pdf["embedding"])
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in _meeting(run, *(pdf[c].to_numpy() for c in ("part", "row", "col"))):
        ok = np.einsum("nd,nd->n", v[i], v[j]) >= THRESHOLD
        xs.append(i[ok])
        ys.append(j[ok])
    x, y = np.concatenate(xs), np.concatenate(ys)
    if t and len(x):
        linked, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        keys = bucket_keys(v[linked], projections, tables)[:, :t]
        fresh = _differ(keys, at[: len(x)], at[len(x) :])
        x, y = x[fresh], y[fresh]
    names, at = np.unique(ids, return_inverse=True)
    weight = np.zeros(len(names), np.int64)
    weight[at] = size
    x, y = at[x], at[y]
    count = np.zeros(len(names), np.int64)
    np.add.at(count, x, weight[y])
    np.add.at(count, y, weight[x])
    out = pd.DataFrame({"vec_id": names, "n": count, "low": names[_roots(len(names), x, y)]})
    return out[out["n"] > 0]


def _differ(keys: np.ndarray, i: np.ndarray, j: np.ndarray, portion: int = 50_000) -> np.ndarray:
    """Where no key of rows i and j agrees."""
    return np.concatenate([(keys[i[b : b + portion]] != keys[j[b : b + portion]]).all(axis=1) for b in range(0, len(i), portion)])


def embedding_components(vectors: DataFrame, planned: int | None = None) -> DataFrame:
    """One row per vector (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors of cosine 0.95 or more are linked where at least one hash table puts them into one
    bucket; vectors of different lengths never are. Vectors that are null, zero, empty, or hold
    null or non-finite components link with nothing, as do rows with a null vec_id, which all stay.
    Rows that repeat a vec_id count as one vector, the least of them. Equal vectors (by 128 bits of hash)
    are one class with a size, so copies never meet in pairs. Extra columns are ignored. planned:
    the number of vectors that the tables are laid out for, the classes' own if None.
    """
    one = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    one = materialise(one.withColumn("h", F.when(usable(), F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit("second"), "embedding").alias("b")))), "vectors")
    classes = one.where("h is not null").groupBy("h").agg(F.min(F.struct("vec_id", "embedding")).alias("m"), F.count("*").alias("size"))
    classes = materialise(classes.select("h", F.col("m.vec_id").alias("vec_id"), F.col("m.embedding").alias("embedding"), "size", F.size("m.embedding").alias("d")), "classes")
    total = classes.count()
    projections, tables = hash_plan(planned or total)

    def keys(batches):
        for batch in batches:
            for _, b in batch.groupby("d"):
                yield pd.DataFrame({"vec_id": b["vec_id"], "d": b["d"], "keys": list(bucket_keys(_normalised(b["embedding"]), projections, tables))})

    keyed = materialise(classes.select("vec_id", "d", "embedding").mapInPandas(keys, "vec_id bigint, d int, keys array<bigint>"), "keyed")
    cell = keyed.select("vec_id", "d", F.posexplode("keys").alias("t", "key"))
    crowded = cell.groupBy("t", "d", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    part = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = cell.join(crowded, ["t", "d", "key"]).withColumn("blocks", blocks).withColumn("part", part)
    # A row of block p meets every block: as the row side with blocks p.., as the column side with ..p.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "part").alias("row"), F.greatest(o, "part").alias("col")))
    dealt = dealt.select("vec_id", "t", "d", "key", "part", "blocks", F.explode(meets).alias("m")).select("vec_id", "t", "d", "key", "part", "blocks", "m.*")
    # Small buckets share groups of bounded size; each pair of blocks of a large one is a group of its own.
    shared = F.pmod(F.xxhash64("key"), F.lit(max(1, total // GROUP_ROWS)))
    group = F.when(F.col("blocks") == 1, F.struct("t", "d", shared.alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("c"))).otherwise(F.struct("t", "d", F.col("key").alias("a"), F.col("row").alias("b"), F.col("col").alias("c")))
    rows = dealt.withColumn("g", group).drop("blocks", "d").join(classes.select("vec_id", "embedding", "size"), "vec_id")
    found = rows.groupBy("g").applyInPandas(lambda pdf: _link_group(pdf, projections, tables), "vec_id bigint, n bigint, low bigint")
    found = materialise(found, "embedding-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("others"))
    comps = connected_components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "vec_id")
    of_class = (
        classes.select("h", "vec_id", "size").join(counts, "vec_id", "left").join(comps, "vec_id", "left")
        .select("h", F.col("size").alias("n"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    known = one.where("h is not null").select("vec_id", "h")
    linked = join_apart(known, of_class, ["h"], "n", hot_limit(total)).select("vec_id", "n_links", "component_id")
    alone = one.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    nameless = vectors.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).unionByName(nameless).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

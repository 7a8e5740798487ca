"""Embedding whitening: distributed covariance, eigenvectors by Householder, Sturm and inverse iteration, broadcast projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalake.llm.common import materialise

#: Components become floor(SCALE x) + SHIFT.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Whole components are held to this range, where doubles are exact.
REACH = 1 << 52
#: Numbers of a matrix that are summed up in one group, about.
BAND = 8192
#: Bytes of models that are broadcast at once; vectors of further lengths take further passes.
BROADCAST = 64 << 20
LONGEST = (1 << 63) - 1
EPS = np.finfo(np.float64).eps


# Eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors: H_n..H_1 a H_1..H_n is tridiagonal, H_i = I - 2 v v'."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for i in range(n - 2):
        x = a[i + 1 :, i].copy()
        largest = np.abs(x).max()
        v = np.zeros(n)
        if np.abs(x[1:]).max() > 0:
            x /= largest
            x[0] += np.copysign(np.sqrt(x @ x), x[0])
            v[i + 1 :] = x / np.sqrt(x @ x)
            p = a @ v
            w = 2 * (p - (v @ p) * v)
            a -= np.outer(v, w) + np.outer(w, v)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are below each value of `at`."""
    tiny = np.finfo(np.float64).tiny / EPS
    q = d[0] - at
    count = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - at - e[i - 1] * e[i - 1] / q
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection down to neighbouring doubles."""
    n = len(d)
    side = np.concatenate(([0.0], np.abs(e))) + np.concatenate((np.abs(e), [0.0]))
    low, high = np.full(k, (d - side).min()), np.full(k, (d + side).max())
    spread = max(abs(low[0]), abs(high[0])) * EPS + np.finfo(np.float64).tiny
    low, high = low - spread, high + spread
    want = n - np.arange(1, k + 1)  # the j-th largest has n - j below it
    for _ in range(1100):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        over = below(d, e, mid) > want
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    return high


def _solved(d: np.ndarray, e: np.ndarray, at: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """x with (T - at_j) x_j = b_j for every shift j, by elimination with row exchanges; pivots are `least` at least."""
    n, k = b.shape
    b = b.copy()
    u = np.zeros((3, n, k))  # pivot row: diagonal, and the two right of it
    one, two = d[0] - at, np.full(k, e[0] if n > 1 else 0.0)
    for i in range(n - 1):
        lower, diagonal = e[i], d[i + 1] - at
        upper = e[i + 1] if i + 2 < n else 0.0
        swap = np.abs(one) < abs(lower)
        pivot = np.where(swap, lower, np.where(np.abs(one) < least, least, one))
        u[0, i], u[1, i], u[2, i] = pivot, np.where(swap, diagonal, two), np.where(swap, upper, 0.0)
        factor = np.where(swap, one, lower) / pivot
        first, second = np.where(swap, b[i + 1], b[i]), np.where(swap, b[i], b[i + 1])
        b[i], b[i + 1] = first, second - factor * first
        one, two = np.where(swap, two, diagonal) - factor * u[1, i], np.where(swap, 0.0, upper) - factor * u[2, i]
    u[0, n - 1] = np.where(np.abs(one) < least, least, one)
    x = np.zeros((n, k))
    for i in range(n - 1, -1, -1):
        right = b[i]
        if i + 1 < n:
            right = right - u[1, i] * x[i + 1]
        if i + 2 < n:
            right = right - u[2, i] * x[i + 2]
        x[i] = right / u[0, i]
        large = np.abs(x[i]) > 1e150
        if large.any():  # a solution counts up to its length
            x[i:, large] *= 1e-150
            b[:i, large] *= 1e-150
    return x


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for falling eigenvalues.

    Values nearer than a thousandth of the norm to the one before are a cluster; its vectors are
    made orthogonal to each other after every step, and its shifts are kept apart.
    """
    n, k = len(d), len(values)
    norm = float((np.abs(d) + np.concatenate(([0.0], np.abs(e))) + np.concatenate((np.abs(e), [0.0]))).max()) or 1.0
    near = np.concatenate(([False], values[:-1] - values[1:] <= 1e-3 * norm))
    shift = values.copy()
    for j in range(1, k):
        if near[j]:
            shift[j] = min(shift[j], shift[j - 1] - 4 * EPS * norm)
    x = np.random.default_rng(1).standard_normal((n, k))
    for _ in range(rounds):
        x /= np.abs(x).max(axis=0)
        x = _solved(d, e, shift, x, EPS * norm)
        x /= np.abs(x).max(axis=0)
        for j in range(k):
            begin = j
            while near[begin]:
                begin -= 1
            for _ in range(2):
                x[:, j] -= x[:, begin:j] @ (x[:, begin:j].T @ x[:, j])
            x[:, j] /= np.sqrt(x[:, j] @ x[:, j])
    return x


def leading_eigenvectors(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    The sign is such that a vector's largest entry in size is positive.
    """
    size = np.abs(v).max()
    if not size > 0:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, mirrors = tridiagonal(v / size)
    values = leading_values(d, e, k)
    x = inverse_iteration(d, e, values)
    for m in reversed(mirrors):
        x -= 2 * np.outer(m, m @ x)
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    return values * size, x


# Sums over all rows


def _whole(column: pd.Series) -> np.ndarray:
    """Vectors as whole numbers."""
    v = np.floor(np.stack(column.to_numpy()).astype(np.float64) * SCALE)
    return np.clip(v, -REACH, REACH).astype(np.int64) + SHIFT


def fine(vector: str = "embedding"):
    """Condition: not null, not empty, no null or non-finite component."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _bands(d: int, part: int, matrix: np.ndarray) -> pd.DataFrame:
    """A matrix as rows of about BAND numbers."""
    flat = matrix.ravel()
    cuts = [flat[at : at + BAND] for at in range(0, len(flat), BAND)]
    return pd.DataFrame({"d": d, "band": range(len(cuts)), "part": part, "v": cuts})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"].to_numpy()), axis=0)])


def summed(partial: DataFrame) -> DataFrame:
    """Sums of bands (d, band, part, v) over all parts, in two steps: a group gathers about the root of their number."""
    kind = "d int, band int, part int, v array<double>"
    groups = max(1, int(partial.sparkSession.sparkContext.defaultParallelism))
    some = partial.withColumn("part", F.pmod("part", F.lit(groups)).cast("int")).groupBy("d", "band", "part").applyInPandas(_added, kind)
    return some.groupBy("d", "band").applyInPandas(_added, kind)


def _totals(rows: DataFrame) -> pd.DataFrame:
    """Per length of vector: d, n, sums (exact), low and high of each dimension. One row per length comes to the driver."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, part in pdf.groupby(pdf["embedding"].map(len)):
                x = _whole(part["embedding"])
                exact = x.sum(axis=0) if abs(x).max() < LONGEST // len(x) else x.astype(object).sum(axis=0)
                yield pd.DataFrame({"d": d, "i": range(d), "n": len(x), "s": [str(v) for v in exact], "low": x.min(axis=0), "high": x.max(axis=0)})

    each = rows.select("embedding").mapInPandas(partial, "d int, i int, n bigint, s string, low bigint, high bigint")
    per = each.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    held = per.groupBy("d").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "s", "low", "high"))).alias("held"))  # d entries of a length d
    return held.orderBy("d").toPandas()


def _in_passes(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Lengths whose models are broadcast together."""
    out: list[list[int]] = [[]]
    held = 0
    for d, size in sizes:
        if out[-1] and held + size > BROADCAST:
            out.append([])
            held = 0
        out[-1].append(d)
        held += size
    return out


def _fit(rows: DataFrame, means: dict[int, tuple[int, np.ndarray, np.ndarray]], components: int) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per length: eigenvalues, eigenvectors (columns), trace of the covariance. Solved in tasks, one matrix in each."""
    shared = rows.sparkSession.sparkContext.broadcast({d: m for d, (_, m, _) in means.items()})

    def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, part in pdf.groupby(pdf["embedding"].map(len)):
                x = _whole(part["embedding"]) - shared.value[d]
                held[d] = held.get(d, 0.0) + x.T @ x
        for d, matrix in held.items():
            yield _bands(d, TaskContext.get().partitionId(), matrix)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        flat = np.concatenate(pdf.sort_values("band")["v"].to_numpy())
        v = flat.reshape(d, d) / counts[d]
        v = (v + v.T) / 2
        values, vectors = leading_eigenvectors(v, min(components, d))
        return pd.DataFrame({"d": [d], "e": [values], "x": [vectors.ravel()], "trace": [float(np.trace(v))]})

    counts = {d: n for d, (n, _, _) in means.items()}
    products = rows.select("embedding").mapInPandas(centred, "d int, band int, part int, v array<double>")
    solved = summed(products).groupBy("d").applyInPandas(solve, "d int, e array<double>, x array<double>, trace double").toPandas()
    return {int(r.d): (np.array(r.e), np.array(r.x).reshape(int(r.d), -1), float(r.trace)) for r in solved.itertuples()}


def _deviations(x: np.ndarray, n: int, sums: np.ndarray, widest: int) -> np.ndarray:
    """Per row the sum of (n x - S)^2, exact; what a long can't hold counts as its end. widest: most that x is from S/n."""
    if (n * widest) ** 2 * x.shape[1] <= LONGEST and max(abs(int(s)) for s in sums) <= LONGEST and n * (REACH + SHIFT) <= LONGEST:
        far = n * x - sums.astype(np.int64)
        return (far * far).sum(axis=1)
    far = n * x.astype(object) - sums
    return np.array([min(int(v), LONGEST) for v in (far * far).sum(axis=1)], np.int64)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of vectors (vec_id, embedding) and component: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Vectors that are null or empty, or hold null or non-finite components, are left out; zero ones
    are not. Each length of vector is fitted and whitened by itself; n counts its rows. Whole
    numbers x = floor(64 c) + 1,000,000 are centred on their means; components are the leading
    eigenvectors of their covariance, with the largest entry positive. A component whose variance
    is none but for rounding can't be made 1: whitened is 0 there, and it doesn't count in
    identity_error, which is measured on the whitened rows themselves. Repeated rows and ids and
    null ids keep their rows and count as often; ties between variances give any basis of their
    plane; extra columns are ignored; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = materialise(vectors.select("vec_id", "embedding").where(fine()), "embeddings")
    kind = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double"
    totals = _totals(rows)
    about = {}
    for r in totals.itertuples():
        sums = np.array([int(h["s"]) for h in r.held], object)
        low, high = min(int(h["low"]) for h in r.held), max(int(h["high"]) for h in r.held)
        about[int(r.d)] = (int(r.n), np.array([s / int(r.n) for s in sums], np.float64), sums, high - low)
    out = None
    for lengths in _in_passes([(d, 8 * d * d) for d in about]):
        some = rows.where(F.size("embedding").isin(lengths))
        part = _passed(spark, some, {d: about[d] for d in lengths}, components, kind)
        out = part if out is None else out.unionByName(part)
    return out


def _passed(spark, rows: DataFrame, about: dict, components: int, kind: str) -> DataFrame:
    """whiten() for the lengths of `about`."""
    models = {}
    for d, (values, x, trace) in _fit(rows, {d: a[:3] for d, a in about.items()}, components).items():
        real = values > EPS * d * trace
        models[d] = (*about[d], x * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0), values / trace if trace > 0 else np.zeros(len(values)), real)
    model = spark.sparkContext.broadcast(models)  # BROADCAST bytes at most, or one length's

    def projected(part: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
        x = _whole(part["embedding"])
        return x, (x - model.value[d][1]) @ model.value[d][4]

    def squares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, part in pdf.groupby(pdf["embedding"].map(len)):
                w = projected(part, d)[1]
                held[d] = held.get(d, 0.0) + np.vstack((w.T @ w, w.sum(axis=0)))
        for d, matrix in held.items():
            yield _bands(d, TaskContext.get().partitionId(), matrix)

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["d"].iloc[0])
        n, real = model.value[d][0], model.value[d][6]
        flat = np.concatenate(pdf.sort_values("band")["v"].to_numpy()).reshape(len(real) + 1, -1) / n
        off = flat[:-1] - np.outer(flat[-1], flat[-1]) - np.eye(len(real))
        return pd.DataFrame({"d": [d], "error": [float(np.abs(off[real][:, real]).max(initial=0.0))]})

    bands = rows.select("embedding").mapInPandas(squares, "d int, band int, part int, v array<double>")
    error = {r["d"]: r["error"] for r in summed(bands).groupBy("d").applyInPandas(errors, "d int, error double").collect()}  # one per length

    def whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, all_ in pdf.groupby(pdf["embedding"].map(len)):
                n, _, sums, widest, _, explained, _ = model.value[d]
                k = len(explained)
                for at in range(0, len(all_), 2048):
                    part = all_.iloc[at : at + 2048]
                    x, w = projected(part, d)
                    yield pd.DataFrame({
                        "vec_id": part["vec_id"].astype("Int64").repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(part)), "n": n,
                        "deviation": _deviations(x, n, sums, widest).repeat(k), "whitened": w.ravel(), "explained": np.tile(explained, len(part)), "identity_error": error[d],
                    })

    return rows.mapInPandas(whitened, f"{kind}, identity_error double")

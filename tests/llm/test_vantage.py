"""Nearest neighbours by vantage-point trees against brute force."""

import math

import numpy as np
import pytest

from arenalake.llm import vantage

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def rows_of(seed=1):
    rng = np.random.default_rng(seed)
    out = [np.float32(v) for v in rng.standard_normal((500, 24)) * rng.uniform(0.3, 2, (500, 1))]
    for c in range(10):
        out += [np.float32(out[c] + rng.standard_normal(24) * 0.05) for _ in range(12)]
    out += [out[7]] * 90  # many copies
    table = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    table += [(2000, None), (2020, [None] + [0.1] * 23), (2040, [math.nan] * 24), (2060, [math.inf] + [0.0] * 23), (2080, [0.0] * 24), (2100, [1.0, 2.0]), (2120, [2.0, -1.0]), (2140, []), (None, table[0][1]), table[3]]
    return [(i, v, 0, 1, "clash") for i, v in table]


def usable(rows):
    return {i: np.array(v) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}


def brute(rows, every, k):
    vecs = usable(rows)
    want = {}
    for q in (i for i in vecs if i % every == 0):
        all_ = [(-float((v * vecs[q]).sum()) + 0.0, i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q])]
        want[q] = [(i, -s) for s, i in sorted(all_)[:k]]
    return want


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_LEAST", 90)
    monkeypatch.setattr(vantage, "shard_rows", lambda n: 90)
    monkeypatch.setattr(vantage, "LEAF", 8)
    monkeypatch.setattr(vantage, "QUERY_BLOCK", 7)


def test_factor_one_is_exact(spark, small_shards):
    rows = rows_of()
    got = by_query(vantage.nearest_neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), relax=1.0))
    want = {q: w for q, w in brute(rows, 20, 20).items() if w}
    assert got.keys() == want.keys() and 2100 in got and len(got[2100]) == 1
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w]
        assert np.allclose([s for _, s in got[q]], [s for _, s in w], rtol=1e-13, atol=1e-13)


def test_tuned_search_keeps_recall_and_order(spark, small_shards):
    rows = rows_of(3)
    got = by_query(vantage.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)))
    want = brute(rows, 20, 20)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items() if w]
    assert np.mean(hits) >= 0.95
    assert all([(-s, i) for i, s in g] == sorted((-s, i) for i, s in g) for g in got.values())


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got, want = by_query(vantage.nearest_neighbours(df)), brute(table, 20, 20)
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.95


def test_trees_leave_out_most_of_clustered_vectors():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16)) * 3
    v = centres[np.arange(6000) % 60] + rng.standard_normal((6000, 16)) * 0.2
    v /= np.sqrt((v * v).sum(1, keepdims=True))  # of equal length, so that the nearest are in the cluster
    scale = 1.0
    shard = vantage.Shard(np.arange(6000), v, scale, 20)
    q = np.hstack((v[::200] / scale, np.zeros((30, 1))))
    exact, all_ = shard.search(q, np.full(30, np.inf), 1.0)
    relax = vantage.tuned(v[:4096], scale, 20)
    near, some = shard.search(q, np.full(30, np.inf), relax)
    assert relax > 1 and some < all_ < 0.35 * 30 * 6000
    assert np.mean([len(np.intersect1d(a, b)) / len(a) for a, b in zip(exact, near, strict=True)]) > 0.9


def test_bounds_hold_for_every_leaf():
    rng = np.random.default_rng(9)
    v = rng.standard_normal((3000, 8)) * rng.uniform(0.1, 1, (3000, 1))
    scale = float(np.sqrt((v * v).sum(1)).max())
    top = vantage.Top.laid_out(v[:1000], scale, 12)
    x = vantage.lifted(v / scale)
    leaf = top.placed(x)
    q = np.hstack((v[:50] / scale, np.zeros((50, 1))))
    bound, d = top.bounds(q), vantage.distances(q, x)
    assert max(top.leaf) == 11 and all((d[:, leaf == i] >= bound[:, i, None] - 1e-7).all() for i in range(12))


def test_empty_and_single_tables(spark):
    assert vantage.nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vantage.nearest_neighbours(spark.createDataFrame([(20, [1.0, 2.0], 0, 0, "")], SCHEMA)).count() == 0

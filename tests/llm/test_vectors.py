"""Vector operators against brute force."""

import math

import numpy as np
import pytest

from arenalake.llm import components, pstable, topk

SCHEMA = "vec_id long, embedding array<float>, label int, t int, keys string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for c in range(12):
        centre = rng.standard_normal(64)
        out += [centre + rng.standard_normal(64) * s for s in (0, 0.05, 0.15, 0.22, 0.3)]
    out += [out[0] * 3, out[7].copy(), np.zeros(64)]
    table = [(i * 5, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]
    table += [(1001, None), (1002, [None] + [0.1] * 63), (1003, [math.nan] * 64), (1004, [math.inf] + [0.0] * 63), (1005, [1.0, 2.0]), (None, table[0][1]), table[3]]
    return [(i, v, 0, 1, "clash") for i, v in table]


def usable(rows, zero=False):
    seen = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            seen[i] = np.array(v)
    return seen


def test_embedding_links_against_brute_force(spark, rows):
    vecs = {i: v for i, v in usable(rows).items() if len(v) == 64}
    ids = sorted(vecs)
    unit = np.array([vecs[i] / np.linalg.norm(vecs[i]) for i in ids])
    link = unit @ unit.T >= 0.95
    found = pstable.embedding_components(spark.createDataFrame([*rows, (None, None, 0, 1, "clash")], SCHEMA)).collect()
    got = {r.vec_id: r for r in found}
    assert set(got) == {r[0] for r in rows} and len(found) == len(got) + 1  # rows without an id all stay
    true, found = link.sum() - len(ids), sum(got[i].n_links for i in ids)
    assert 0.9 * true <= found <= true and true > 40
    comp = {i: min(ids[j] for j in np.flatnonzero(link[n])) for n, i in enumerate(ids)}
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in ids)
    assert sum(got[i].component_id == comp[i] for i in ids) >= 0.9 * len(ids)
    assert all(got[i].n_links == 0 and got[i].kept for i in (1001, 1002, 1003, 1004, 1005, None))


def test_copies_and_other_lengths_link(spark, monkeypatch):
    monkeypatch.setattr(pstable, "BLOCK", 4)
    copies = [(i, [0.5, -1.0, 2.0] * 8, 0, 0, "") for i in range(10, 40)] + [(5, [0.51, -1.0, 2.0] * 8, 0, 0, "")]
    short = [(50, [1.0, 2.0], 0, 0, ""), (51, [2.0, 4.0], 0, 0, ""), (52, [-1.0, 1.0], 0, 0, ""), (53, [], 0, 0, "")]
    got = {r.vec_id: r for r in pstable.embedding_components(spark.createDataFrame(copies + short, SCHEMA)).collect()}
    assert all(got[i].n_links == 30 and got[i].component_id == 5 for i in [5, *range(10, 40)])
    assert (got[50].n_links, got[51].n_links, got[52].n_links, got[53].n_links) == (1, 1, 0, 0) and got[51].component_id == 50


@pytest.mark.parametrize("planned", [20_000, 2_000_000])
def test_recall_of_pairs_near_the_threshold(spark, planned):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1000, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = rng.uniform(0.9505, 0.96, (1000, 1))
    both = np.concatenate((x, cosine * x + np.sqrt(1 - cosine**2) * z))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pstable.embedding_components(df, planned).collect()}
    found = sum(got[1000 + i] == (1, i) for i in range(1000))
    assert found >= 980 and all(n <= 1 for n, _ in got.values())


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(64)
    rows = [(i, [float(x) for x in centre + rng.standard_normal(64) * 0.01], 0, 0, "") for i in range(120)]
    monkeypatch.setattr(pstable, "BLOCK", 25)
    got = pstable.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.n_links == 119 and r.component_id == 0 for r in got)


def brute_top(vecs, every=100, k=10):
    want = []
    for q in (i for i in vecs if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(vecs[q], v, strict=True)), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))[:k]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


def test_top_k_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    more = [(1100, [1.0, -2.0], 0, 1, ""), (1106, [-1.0, 0.5], 0, 1, ""), (1200, [5.0], 0, 1, ""), (1300, [], 0, 1, "")]
    vecs = {i: [math.floor(x * 1024) for x in v] for i, v in usable(rows + more, zero=True).items()}
    got = [tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows + more, SCHEMA)).collect()]
    assert sorted(got) == brute_top(vecs) and any(q == 1100 for q, *_ in got)


def test_scores_of_large_components_are_exact(spark):
    rng = np.random.default_rng(7)
    for size, held in ((2.0**17, 1 << 62), (2.0**40, (1 << 63) - 1)):  # 64-bit products, and products beyond them
        raw = [(i * 50, [float(np.float32(x)) for x in rng.standard_normal(16) * size]) for i in range(30)]
        vecs = {i: [math.floor(x * 1024) for x in v] for i, v in raw}
        got = [tuple(r) for r in topk.exact_top_k(spark.createDataFrame(raw, "vec_id long, embedding array<float>")).collect()]
        want = [(q, n, i, min(max(s, -(1 << 63)), (1 << 63) - 1)) for q, n, i, s in brute_top(vecs, k=100)]
        best = {}
        for q, _, i, s in sorted(want, key=lambda r: (r[0], -r[3], r[2])):
            best.setdefault(q, []).append((q, len(best.get(q, [])) + 1, i, s))
        assert sorted(got) == sorted(r for rows in best.values() for r in rows[:10])
        assert max(abs(s) for *_, s in got) > held >> 12


def test_bounds_leave_few_rows_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 100)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 64))
    raw = [(i, [float(x) for x in np.float32(centres[i % 40] + rng.standard_normal(64) * 0.2)]) for i in range(2000)]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<float>")
    per = topk.search(df, 50).groupBy("query_id").agg({"scored": "max"}).toPandas()
    assert len(per) == 40
    scored = {r.query_id: r.s for r in topk.search(df, 50).groupBy("query_id", "scored").count().groupBy("query_id").agg({"scored": "sum"}).toDF("query_id", "s").collect()}
    assert np.mean(list(scored.values())) < 0.15 * 2000
    got = [tuple(r) for r in topk.exact_top_k(df, 50).collect()]
    assert sorted(got) == brute_top({i: [math.floor(x * 1024) for x in v] for i, v in raw}, 50)


def test_segment_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((30, 64)), rng.standard_normal((40, 64))
    y[:5] = 1e6  # no deviation at all
    for s in topk.resolutions(64):
        mine, theirs = topk.segment_statistics(x, s), topk.segment_statistics(y, s)
        assert (np.hstack(mine) @ np.hstack(theirs).T >= x @ y.T - 1e-6).all()
        low, high, widest = theirs[0].min(0)[None], theirs[0].max(0)[None], theirs[1].max(0)[None]
        assert (topk.block_bounds(*mine, low, high, widest)[:, 0] >= (x @ y.T).max(1) - 1e-6).all()


def test_empty_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pstable.embedding_components(none).count() == 0 and topk.exact_top_k(none).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200


def test_pairs_at_the_threshold_meet_with_probability_0_997():
    from arenalake.llm import pstable

    for n in (2, 1000, 60_000, 200_000, 10**9):
        projections, tables = pstable.hash_plan(n)
        assert 1 - (1 - pstable.agreement(0.95) ** projections) ** tables >= 0.997

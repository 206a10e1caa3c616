"""Kernels against direct definitions."""

import numpy as np
import pytest

from tapeline.functions import kernels as K
from tapeline.operators import pairs

rng = np.random.default_rng(3)


def direct(x, y, ok=None):
    t = np.full((len(x) + 1, len(y) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(x)):
        for j in range(len(y)):
            if ok is None or ok[i, j]:
                t[i + 1, j + 1] = abs(x[i] - y[j]) + min(t[i, j + 1], t[i + 1, j], t[i, j])
    return t[-1, -1]


@pytest.mark.parametrize("n,m", [(1, 1), (5, 9), (9, 5), (20, 20)])
def test_dtw(n, m):
    x, y = rng.normal(size=(7, n)), rng.normal(size=(7, m))
    np.testing.assert_allclose(K.dtw(x, y), [direct(a, b) for a, b in zip(x, y)])
    ok = K.band(n, m, 5)
    np.testing.assert_allclose(K.dtw(x, y, ok), [direct(a, b, ok) for a, b in zip(x, y)])


def test_dtw_identity_and_band_order():
    x, y = rng.normal(size=(4, 30)), rng.normal(size=(4, 30))
    assert np.allclose(K.dtw(x, x), 0)
    assert (K.dtw(x, y, K.band(30, 30, 3)) >= K.dtw(x, y) - 1e-12).all()
    for a, b in zip(x, y):
        d, path = K.fast_dtw(a, b)
        assert d >= direct(a, b) - 1e-12 and path[0] == (0, 0) and path[-1] == (29, 29)


@pytest.mark.parametrize("moments", [1, 2, 4, 6, 8, 10])
def test_wavelet_reconstruction(moments):
    f = K.daubechies(moments)
    assert np.isclose((f**2).sum(), 1) and np.isclose(f.sum(), np.sqrt(2))
    for n in (64, 65, 101):
        x = rng.normal(size=n)
        np.testing.assert_allclose(K.waverec(K.wavedec(x, moments, 2), moments)[:n], x, atol=1e-6)


def test_peaks():
    x = np.array([0, 1, 0, 2, 2, 0, 3, 0, 1.0])
    assert list(K.peaks(x)) == [1, 3, 6]
    assert list(K.peaks(x, 4)) == [1, 6]


def test_sweep_in_place():
    """The sweep that overwrites the last but one diagonal gives the cell-by-cell table's corner to the last bit, for any shape and mask."""
    for n, m in ((1, 1), (1, 6), (6, 1), (2, 9), (9, 2), (7, 7), (13, 8)):
        x, y = rng.normal(size=(5, n)), rng.normal(size=(5, m))
        y[4, -1] = np.nan
        for mask in (None, K.band(n, m, abs(n - m) + 1), K.band(n, m, 0)):
            want = [K.dtw_table(a, b, mask)[-1, -1] for a, b in zip(x[:4], y[:4])]
            got = K.dtw(x, y, mask)
            assert got[:4].tolist() == want and (np.isnan(got[4]) or np.isinf(got[4]))


def test_one_frame_for_a_part(monkeypatch):
    """A pair of parts is one frame of pairs, however many sweeps it takes."""
    import pandas as pd

    part = lambda at: pd.DataFrame({"id": np.arange(at, at + 64), "v": list(rng.normal(size=(64, 4)))}, index=np.arange(at, at + 64))
    a, b, made, real = part(0), part(64), [], pd.DataFrame

    def counted(*args, **kw):
        made.append(1)
        return real(*args, **kw)

    monkeypatch.setattr(pairs.pd, "DataFrame", counted)
    got = pairs._distance_kernel(True)(a, b)
    assert len(got) == 64 * 64 and len(made) == 1


def test_distance_tiles(spark):
    v = rng.normal(size=(40, 12))
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(v)], "id long, v array<double>")
    got = {(r.a, r.b): r.distance for r in pairs.tiles(df, None, pairs._distance_kernel(True), pairs._PAIR, size=8).collect()}
    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40)}
    for (i, j), d in list(got.items())[::37]:
        assert np.isclose(d, direct(v[i], v[j]))
    near = pairs.distance_pairs(df, limit=5.0).collect()
    assert {(r.a, r.b) for r in near} == {k for k, d in got.items() if d <= 5.0}
    top = pairs.nearest(df, df, 2).collect()
    assert all(r.a == r.b for r in top if r["rank"] == 1)


def test_tile_copies(spark):
    """More series make larger blocks: the number of tiles, and with it the copies of a series, is bounded."""
    import pandas as pd

    df = spark.range(100).selectExpr("id", "array(double(id)) AS v")
    # each part is met once; a part holds at most three ids, a tile's parts come to one row
    count = lambda a, b: pd.DataFrame({"n": [len(a) * len(b)], "most": [max(len(a), len(b))]})
    got = pairs.tiles(df, None, count, "n long, most long", size=2, step=3, reduce=lambda d: pd.DataFrame({"n": [d.n.sum()], "most": [d.most.max()]})).toPandas()
    assert len(got) <= 32 * 33 // 2 and got.most.max() <= 3
    d = {frozenset((r.a, r.b)) for r in pairs.tiles(df, None, pairs._distance_kernel(True), pairs._PAIR, size=2, step=3).collect()}
    assert len(d) == 100 * 99 // 2 and all(len(x) == 2 for x in d)
    near = pairs.tiles(df, df.selectExpr("id + 0 AS id", "array(v[0]) AS v"), pairs._distance_kernel(False), pairs._PAIR, size=2, step=7).filter("a = b").count()
    assert near == 100


def test_repeated_ids(spark):
    """Rows of one id meet all others and not each other, whatever the part size; carried columns follow their side."""
    df = spark.createDataFrame([(i // 2, [float(i), 0.0], i) for i in range(40)], "id long, v array<double>, k int")
    got = pairs.tiles(df, None, pairs._distance_kernel(True, carry=["k"]), pairs._PAIR + ", k_a int, k_b int", size=4, step=3).toPandas()
    assert len(got) == 40 * 39 // 2 - 20 and (got.a < got.b).all() and (got.k_a // 2 == got.a).all() and (got.k_b // 2 == got.b).all()
    assert sorted(zip(got.k_a, got.k_b)) == [(i, j) for i in range(40) for j in range(i + 1, 40) if i // 2 != j // 2]


def test_cluster_queries_by_pairs(spark):
    """Statistics from carried clusters and density clusters from near pairs, against the distance matrix."""
    from tapeline.operators import regimes as R

    x = np.sort(np.concatenate([rng.normal(0, 1, 30), rng.normal(20, 1, 30), [9.0]]))
    near = lambda a, b: np.abs(np.subtract.outer(a, b)) / 2
    d = near(x, x)
    df = spark.createDataFrame([(i, [float(v)], int(v > 10)) for i, v in enumerate(x)], "id long, v array<double>, cluster int")
    p = pairs.distance_pairs(df, carry=["cluster"]).withColumn("distance", pairs.F.col("normalized"))
    s = {r.cluster: r for r in R.cluster_statistics(p).collect()}
    own = x > 10
    assert np.isclose(s[1].intra_mean, d[own][:, own].sum() / (30 * 29)) and np.isclose(s[1].inter_mean, d[own][:, ~own].mean()) and s[0].size == 31
    eps = 0.75
    few = pairs.distance_pairs(df.drop("cluster"), within=eps).select("a", "b", pairs.F.col("normalized").alias("distance"))
    assert few.count() == (d[np.triu_indices(61, 1)] <= eps).sum()
    best = lambda some, core: pairs.nearest(df.select("id", "v").join(some, "id", "left_semi"), df.selectExpr("id + 0 AS id", "array(v[0]) AS v").join(core, "id", "left_semi"), 1).select("a", "b", pairs.F.col("normalized").alias("distance"))
    one = {tuple(r) for r in R.density(few, df.select("id"), eps, 5, best).collect()}
    assert one == {tuple(r) for r in R.density(p.select("a", "b", "distance"), df.select("id"), eps, 5).collect()} and len(one) == 61
    assert {i for i, _, noise in one if noise} == {i for i in range(61) if (d[i] <= eps).sum() < 5 and not (d[i][(d <= eps).sum(1) >= 5] <= eps).any()}


def test_formations_by_matrix():
    """The matrix form against a plain loop over windows with the greedy kernel."""
    from tapeline.operators.formations import _shapes_of

    rng = np.random.default_rng(4)
    x = np.round(100 + rng.normal(0, 1, 160).cumsum(), 1)  # rounding makes flat tops
    line = lambda p, y: np.polyfit(p, y[p], 1)[0]
    fit = lambda p, y: np.corrcoef(p, y[p])[0, 1] if y[p].std() > 0 else 0.0
    for size in (10, 17, 33):
        got = {(int(i), kind) for at, kind, _ in _shapes_of(x, size, 3) for i in at}
        want = set()
        for s in range(len(x) - size + 1):
            w = x[s : s + size]
            p, v = K.peaks(w, 3), K.peaks(-w, 3)
            if len(set(w[p])) < len(p) or len(set(w[v])) < len(v):
                got = {g for g in got if g[0] != s}  # the order of equal extremes is free in the loop
                continue
            if len(p) < 2 or len(v) < 2:
                continue
            ps, vs, pr, vr = line(p, w), line(v, w), abs(fit(p, w)), abs(fit(v, w))
            want |= {(s, "ascending_triangle")} if w[p].std() / w[p].mean() < 0.02 and vs > 0 and vr > 0.8 else set()
            want |= {(s, "descending_triangle")} if w[v].std() / w[v].mean() < 0.02 and ps < 0 and pr > 0.8 else set()
            want |= {(s, "rising_wedge")} if pr > 0.8 and vr > 0.8 and ps > 0 and vs > ps else set()
            want |= {(s, "falling_wedge")} if pr > 0.8 and vr > 0.8 and ps < 0 and vs < ps else set()
        assert want and got == want


def test_paths_by_batch():
    """Distances and paths of many pairs at once against one pair at a time, ties included."""
    rng = np.random.default_rng(1)
    for n, m in ((5, 7), (16, 16), (9, 3), (1, 4), (33, 20)):
        x, y = rng.integers(0, 4, (30, n)).astype(float), rng.integers(0, 4, (30, m)).astype(float)
        for ok in (None, K.band(n, m, 2), K.parallelogram(n, m)):
            for k, (d, p) in enumerate(zip(*K.dtw_paths(x, y, ok))):
                t = K.dtw_table(x[k], y[k], ok)
                assert t[-1, -1] == d and [tuple(q) for q in p.tolist()] == (K.warping_path(t) if np.isfinite(d) else [])
        for radius in (1, 3):
            for k, (d, p) in enumerate(zip(*K.fast_paths(x, y, radius))):
                one, path = K.fast_dtw(x[k], y[k], radius)
                assert one == d and [tuple(q) for q in p.tolist()] == [tuple(q) for q in path]


def test_alignment_rows(spark, monkeypatch):
    """Paths leave the worker sweep by sweep as flat columns; ends that cannot be reached have no path."""
    x = [rng.normal(size=n).tolist() for n in (6, 6, 9, 4)]
    df = spark.createDataFrame([(i, 7, v, x[0]) for i, v in enumerate(x)], "id long, rid long, x array<double>, y array<double>").coalesce(1)
    monkeypatch.setattr(pairs, "row_kernel", None)  # whole batches of Python paths went through it
    for mode, width in (("exact", 0), ("band", 2), ("fast", 0)):
        for r in pairs.alignments(df, mode, width=width).collect():
            a, b = np.array(x[r.id]), np.array(x[0])
            d, path = K.fast_dtw(a, b) if mode == "fast" else (lambda t: (t[-1, -1], K.warping_path(t) if np.isfinite(t[-1, -1]) else []))(K.dtw_table(a, b, K.band(len(a), 6, 2) if mode == "band" else None))
            assert np.isclose(r.distance, d) and r.steps == len(path) and [(p.i, p.j) for p in r.path] == [tuple(q) for q in path] and r.rid == 7

"""Profiles over several slices against brute force: sides, several columns, motifs, chains, borders."""

import math

import numpy as np

from tapeline.functions import kernels as K
from tapeline.operators import profiles as PR

M, ZONE = 8, 2


def bars(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s, n in (("a", 200), (None, 90), ("tiny", 5)):
        x = np.cumsum(rng.normal(size=n)) + 20
        x[50:62] = x[10:22] * 2 if n > 60 else x[50:62]  # a repeat
        x[70:80] = 3.0  # flat
        rows += [(s, i, None if s == "a" and i == 120 else float(v), float(rng.normal())) for i, v in enumerate(x)]
    return rows, spark.createDataFrame(rows, "symbol string, seq long, close double, volume double").repartition(3)


def distances(rows, column):
    out = {}
    for s in {r[0] for r in rows}:
        v = np.array([np.nan if r[column] is None else r[column] for r in rows if r[0] == s])
        if len(v) >= M:
            w = np.lib.stride_tricks.sliding_window_view(v, M)
            d, i, gap = K.nearest_windows(w, w), np.arange(len(w)), np.isnan(w).any(1)
            d[gap], d[:, gap] = np.inf, np.inf
            d[np.abs(i[:, None] - i) <= ZONE] = np.inf
            out[s] = (w, d)
    return out


def test_sides_chains_motifs(spark):
    rows, df = bars(spark)
    profile = PR.sided_profile(df, M, block=32).cache()
    got = {(r.symbol, r.seq): r for r in profile.collect()}
    want = distances(rows, 2)
    assert len(got) == sum(int(np.isfinite(d.min(1)).sum()) for _, d in want.values())
    left, right = {}, {}
    for (s, i), r in got.items():
        d = want[s][1][i]
        assert abs(r.distance - d.min()) < 1e-6 and abs(d[r.nn] - d.min()) < 1e-6
        for side, part, shift in ((r.left_nn, d[:i], 0), (r.right_nn, d[i:], i)):
            best = part.min() if len(part) else math.inf
            assert (side is None) == (not np.isfinite(best)) and (side is None or abs(part[side - shift] - best) < 1e-6)
        left[s, i], right[s, i] = r.left_nn, r.right_nn
    link = {(s, j): i for (s, i), j in right.items() if j is not None and left.get((s, j)) == i}
    members = {(s, link[s, j], 0) for s, j in link} | {(s, j, 1) for s, j in link}
    expect = set()
    for s, j in {(s, j) for s, j, _ in members}:
        pos, at = 0, j
        while (s, at) in link:
            at, pos = link[s, at], pos + 1
        expect.add((s, at, pos, j))
    assert {tuple(r) for r in PR.chain_members(profile).collect()} == expect and max(x[2] for x in expect) > 1
    assert {(r.symbol, r.start, r.length) for r in PR.chains(df, profile, M).collect()} == {(s, a, 1 + max(p for t, b, p, _ in expect if (t, b) == (s, a))) for s, a, _, _ in expect}
    found = {}
    for r in PR.motifs(df, profile, M, top=4, most=3, sigmas=3.0, block=32).collect():
        found.setdefault((r.symbol, r.motif), {})[r["rank"]] = (r.seq, r.distance)
    for s, (w, d) in want.items():
        p = d.min(1)
        limit, k = 3.0 * np.std(p[np.isfinite(p)]), 0
        while k < 4 and p.min() <= min(limit, 4):
            i = int(p.argmin())
            own, hits = np.where(np.isnan(w).any(1), np.inf, K.nearest_windows(w[i : i + 1], w)[0]), []
            own[i] = 0.0
            for j in np.argsort(own, kind="stable"):
                if own[j] <= limit and len(hits) < 3 and all(abs(j - h) > ZONE for h in hits):
                    hits.append(int(j))
            assert [round(found[s, k][r][1], 6) for r in sorted(found[s, k])] == [round(own[j], 6) for j in hits]
            for j, _ in found[s, k].values():
                p[max(0, j - ZONE) : j + ZONE + 1] = np.inf
            k += 1
        assert (s, k) not in found and k


def test_several_columns(spark):
    rows, df = bars(spark)
    one, two = distances(rows, 2), distances(rows, 3)
    n = 0
    for r in PR.multi_profile(df, M, ["close", "volume"], block=32).collect():
        both = np.sort(np.stack([one[r.symbol][1], two[r.symbol][1]]), axis=0)
        mean = both[: r.k].mean(0)[r.seq]
        assert abs(mean.min() - r.distance) < 1e-6 and abs(mean[r.nn] - r.distance) < 1e-6
        assert r.dims == ("close,volume" if r.k == 2 else "close" if one[r.symbol][1][r.seq, r.nn] < two[r.symbol][1][r.seq, r.nn] else "volume")
        n += 1
    assert n > 400


def test_borders(spark):
    rng = np.random.default_rng(1)
    v = rng.uniform(0, 1.2, 300).round(2)
    edges = PR.borders(spark.createDataFrame([("a", i, float(min(x, 1))) for i, x in enumerate(v)], "symbol string, seq long, curve double"), 4, regimes=6, factor=5)
    want = []
    for i in np.lexsort((np.arange(300), v)):
        if v[i] < 1 and len(want) < 5 and all(abs(i - j) > 10 for j in want):
            want.append(int(i))
    assert [r.seq for r in sorted(edges.collect(), key=lambda r: r["rank"])] == want

"""Feature vectors and matching against direct definitions."""

import numpy as np
import pytest

from tapeline.functions import kernels as K
from tapeline.operators import vectors as V

rng = np.random.default_rng(11)
DATA = rng.normal(0, 1, (12, 64)).cumsum(1)


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(DATA)], "id long, v array<double>")


def test_pattern_vector(series):
    got = V.pattern_vector(series).toPandas().set_index("id").sort_index()
    assert got.shape == (12, 35)
    for i, v in enumerate(DATA):
        r = got.loc[i]
        levels = K.wavedec(v, 4, 4)
        assert np.isclose(r.wavelet_energy, sum((c**2).sum() for c in levels)) and np.isclose(r.wavelet_coeff_0, levels[0][min(np.abs(v).argmax() * len(levels[0]) // 64, len(levels[0]) - 1)])
        f = np.abs(np.fft.fft(v))[:32]
        q = np.fft.fftfreq(64)[:32]
        assert np.isclose(r.spectral_centroid, (f * q).sum() / f.sum()) and np.isclose(r.high_freq_ratio + r.low_freq_ratio, 1) and np.isclose(r.dominant_frequency, q[f.argmax()])
        assert np.isclose(r.energy_concentration, 1 - np.flatnonzero(np.cumsum(v**2) > 0.9 * (v**2).sum())[0] / 64)
        assert np.isclose(r.symmetry, 1 - np.abs(v[:32] - v[32:][::-1]).mean() / (v.std() + 1e-8))
    some = V.pattern_vector(series, ("shape",))
    assert some.columns == ["id", *V.NAMES["shape"]]


def test_prominence():
    x = np.array([0, 1, 0.9, 2, 0, 1.5, 1.45, 1.6, 0.5])
    assert list(V.prominent(x, 0.2)) == [3, 7]


def test_wavelets_by_matrix():
    for v in DATA:
        for a, b in zip(K.wavedec(DATA, 4, 3), K.wavedec(v, 4, 3)):
            assert np.allclose(a[list(map(tuple, DATA)).index(tuple(v))], b)
    assert np.allclose(K.waverec(K.wavedec(DATA, 4, 3), 4)[:, :64], DATA)


def test_frames(series):
    t = np.arange(64) / 64
    wave = 2 + np.sin(2 * np.pi * 3 * t)
    assert np.allclose(V.fourier_resample(wave[None], 16)[0], 2 + np.sin(2 * np.pi * 3 * np.arange(16) / 16))
    got = V.timeframe_features(series).toPandas()
    v = DATA[3]
    slope = np.polyfit(np.arange(64), v, 1)
    r2 = 1 - ((v - np.polyval(slope, np.arange(64))) ** 2).sum() / ((v - v.mean()) ** 2).sum()
    one = got[(got.id == 3) & (got.name == "long_trend_strength")].value.iloc[0]
    assert np.isclose(one, abs(r2)) and np.isclose(got[(got.id == 3) & (got.name == "long_volatility")].value.iloc[0], np.diff(v).std())
    z = V.combined(V.timeframe_features(series)).toPandas()
    assert np.allclose(z.groupby(["id", "frame"]).value.mean(), 0, atol=1e-9)
    c = V.frame_correlations(series).toPandas()
    assert len(c) == 12 * 6 and np.allclose(c[c.frame_a == c.frame_b].correlation, 1)


def test_pairs_and_templates(spark, series):
    pairs = spark.createDataFrame([(i, 0, DATA[i].tolist(), DATA[0].tolist()) for i in range(12)], "id long, rid long, x array<double>, y array<double>")
    got = V.pair_measures(pairs).toPandas().set_index("id")
    for i, v in enumerate(DATA):
        table = np.full((65, 65), np.inf)
        table[0, 0] = 0
        for a in range(64):
            for b in range(64):
                table[a + 1, b + 1] = (v[a] - DATA[0][b]) ** 2 + min(table[a, b], table[a, b + 1], table[a + 1, b])
        assert np.isclose(got.dtw_distance[i], np.sqrt(table[-1, -1])) and np.isclose(got.correlation[i], np.corrcoef(v, DATA[0])[0, 1])
    scaled = spark.createDataFrame([(i, ((v - v.mean()) / v.std()).tolist()) for i, v in enumerate(DATA)], "id long, v array<double>")
    best = V.template_match(series, scaled, top=2, least=0.0).toPandas()
    first = best[best["rank"] == 1]
    assert (first.id == first.rid).all() and np.allclose(first.similarity, 1) and best.groupby("id").size().max() == 2


def test_reference_sequence(spark):
    d = spark.createDataFrame([(1, s, r, float(abs(r - s // 8))) for s in (0, 8, 16, 24) for r in range(3)], "id long, start int, rid long, d double")
    near = V.nearest_reference(d)
    assert {(r.start, r.rid) for r in near.collect()} == {(0, 0), (8, 1), (16, 2), (24, 2)}
    s = V.sequence_features(near, 64, 3).first()
    assert (s.transitions, s.dominant, s.dominant_share, s.diversity) == (2, 2, 0.5, 1.0) and np.isclose(s.stability, 1 / 3)
    f = V.reference_features(d).first()
    assert f.dtw_min_distance == 0 and f.dtw_top3_mean == 0


def test_stacking_is_out_of_fold(spark):
    from pyspark.sql import functions as F

    from tapeline.operators import learned

    x = rng.normal(0, 1, (300, 2))
    y = x @ [2.0, -1.0] + rng.normal(0, 0.3, 300)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    got = {r.id: r.stacked for r in learned.stacked(df, ["a", "b"], "y").collect()}
    fold = {r.id: r.k for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("k")).collect()}
    k = np.array([fold[i] for i in range(300)])
    design = np.column_stack([x, np.ones(300)])
    for f in range(5):
        w = np.linalg.lstsq(design[k != f], y[k != f], rcond=None)[0]
        assert np.allclose([got[i] for i in np.flatnonzero(k == f)], design[k == f] @ w, atol=1e-6)

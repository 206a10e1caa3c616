"""Feature vectors of series: pattern vector by groups, timeframes, pair measures, template match."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import kernels as K
from tapeline.operators.pairs import row_kernel, stacked_rows

# ---- pattern vector


def _wavelet(v):
    n = v.shape[1]
    levels = K.wavedec(v, 4, min(4, int(np.log2(n))))
    top = np.abs(v).argmax(1)
    out = {f"wavelet_coeff_{i}": np.zeros(len(v)) for i in range(10)}
    energy, entropy = np.zeros(len(v)), np.zeros(len(v))
    for i, c in enumerate(levels):
        m = c.shape[1]
        out[f"wavelet_coeff_{i}"] = c[np.arange(len(c)), np.minimum(top * m // n, m - 1)]
        sq = c * c
        total = sq.sum(1)
        energy += total
        p = sq / np.where(total > 0, total, 1.0)[:, None]
        entropy -= np.where(p > 0, p * np.log(np.where(p > 0, p, 1.0)), 0.0).sum(1)
    return out | {"wavelet_energy": energy, "wavelet_entropy": entropy}


def _temporal(v):
    n = v.shape[1]
    top = np.abs(v).argmax(1)
    auto = np.stack([(v[:, : n - k] * v[:, k:]).sum(1) for k in range(n)], axis=1)
    scale = [next(iter(K.peaks(a)), n // 4) for a in auto]
    return {"duration": np.full(len(v), n), "scale": np.array(scale), "time_to_peak": top, "time_from_peak": n - top - 1}


def _amplitude(v):
    return {"amplitude_max": v.max(1), "amplitude_min": v.min(1), "amplitude_mean": v.mean(1), "amplitude_std": v.std(1), "amplitude_range": np.ptp(v, axis=1)}


def prominent(x: np.ndarray, least: float) -> np.ndarray:
    """Peaks that rise at least ``least`` above the higher of their two surrounding minima."""
    kept = []
    for p in K.peaks(x):
        higher = np.flatnonzero(x > x[p])
        lo = higher[higher < p].max(initial=-1) + 1
        hi = higher[higher > p].min(initial=len(x))
        if x[p] - max(x[lo : p + 1].min(), x[p:hi].min()) >= least:
            kept.append(p)
    return np.array(kept, int)


def _shape(v):
    n, sd = v.shape[1], v.std(1)
    tops = [prominent(x, 0.1 * s) for x, s in zip(v, sd)]
    lows = [len(prominent(-x, 0.1 * s)) for x, s in zip(v, sd)]
    bend = np.abs(np.gradient(np.gradient(v, axis=1), axis=1)) if n > 2 else np.zeros_like(v)
    half = n // 2
    fold = 1 - np.abs(v[:, :half] - v[:, half : 2 * half][:, ::-1]).mean(1) / (sd + 1e-8) if half else np.zeros(len(v))
    z = (v - v.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1.0)[:, None]
    return {"num_peaks": np.array([len(p) for p in tops]), "num_valleys": np.array(lows), "sharpness": np.array([b[p].mean() if len(p) else 0.0 for b, p in zip(bend, tops)]), "symmetry": fold, "kurtosis": (z**4).mean(1) - 3, "skewness": (z**3).mean(1)}


def _magnitudes(v):
    half = v.shape[1] // 2
    return np.abs(np.fft.fft(v, axis=1))[:, :half], np.fft.fftfreq(v.shape[1])[:half]


def _moments(mag, freq):
    total = mag.sum(1)
    safe = np.where(total > 0, total, 1.0)
    centre = mag @ freq / safe
    return centre, np.sqrt(((freq - centre[:, None]) ** 2 * mag).sum(1) / safe)


def _energy(v):
    sq = v * v
    total = sq.sum(1)
    p = sq / np.where(total > 0, total, 1.0)[:, None]
    late = (np.cumsum(sq, 1) > 0.9 * total[:, None]).argmax(1)
    centre, width = _moments(*_magnitudes(v))
    some = total > 0
    return {"energy_concentration": np.where(some, 1 - late / v.shape[1], 0.0), "energy_dispersion": np.where(some, -(p * np.log(p + 1e-10)).sum(1), 0.0), "spectral_centroid": centre, "spectral_bandwidth": width}


def _frequency(v):
    mag, freq = _magnitudes(v)
    power = mag * mag
    high, low = power[:, freq > 0.5 * freq.max()].sum(1), power[:, freq <= 0.5 * freq.max()].sum(1)
    total = np.where(high + low > 0, high + low, 1.0)
    return {"dominant_frequency": np.abs(freq[mag.argmax(1)]), "frequency_spread": _moments(mag, freq)[1], "high_freq_ratio": high / total, "low_freq_ratio": low / total}


GROUPS = {"wavelet": _wavelet, "temporal": _temporal, "amplitude": _amplitude, "shape": _shape, "energy": _energy, "frequency": _frequency}
NAMES = {g: list(f(np.zeros((1, 32)))) for g, f in GROUPS.items()}


def pattern_vector(series: DataFrame, groups=tuple(GROUPS)) -> DataFrame:
    """(id, 35 columns, or those of the chosen groups) of every series; groups that are not asked for are not computed."""
    names = [n for g in groups for n in NAMES[g]]

    def fn(pdf):
        return pd.concat([pd.DataFrame({"id": g.id.to_numpy()} | {k: np.asarray(x, float) for group in groups for k, x in GROUPS[group](v).items()}) for g, v in stacked_rows(pdf)])

    return row_kernel(series.select("id", "v").filter(F.size("v") > 0), fn, "id long, " + ", ".join(f"{n} double" for n in names))


def standard(df: DataFrame, columns) -> DataFrame:
    """Columns minus their mean over their deviation (1 where it is 0)."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns])
    scaled = df.crossJoin(F.broadcast(stats))
    keep = [c for c in df.columns if c not in columns]
    return scaled.select(*keep, *[((F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.s") > 0, F.col(f"_{c}.s")).otherwise(1.0)).alias(c) for c in columns])


# ---- pair measures


def pair_measures(pairs: DataFrame) -> DataFrame:
    """(id, rid, dtw_distance, correlation, euclidean, cosine_similarity) of equal-length pairs (x, y); the warping cost is squared and its root taken."""
    def fn(pdf):
        out = []
        for g, x in stacked_rows(pdf, "x"):
            y = np.stack(g.y.to_list()).astype(float)
            cx, cy = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
            norm = lambda a, b: np.sqrt((a * a).sum(1) * (b * b).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(pd.DataFrame({"id": g.id.to_numpy(), "rid": g.rid.to_numpy(), "dtw_distance": np.sqrt(K.dtw(x, y, square=True)), "correlation": (cx * cy).sum(1) / norm(cx, cy), "euclidean": np.sqrt(((x - y) ** 2).sum(1)), "cosine_similarity": (x * y).sum(1) / norm(x, y)}))
        return pd.concat(out)

    return row_kernel(pairs.select("id", "rid", "x", "y"), fn, "id long, rid long, dtw_distance double, correlation double, euclidean double, cosine_similarity double")


def comparison_report(measures: DataFrame) -> DataFrame:
    """One row: moments of the correlations, the insight text, the most similar pair."""
    c = F.col("correlation")
    d = measures.agg(F.count("*").alias("pairs"), F.avg(c).alias("mean_correlation"), F.stddev_pop(c).alias("std_correlation"), F.min(c).alias("min_correlation"), F.max(c).alias("max_correlation"), F.max_by(F.struct("id", "rid"), F.struct(c, -F.col("id"), -F.col("rid"))).alias("p"))
    insight = F.when(F.col("mean_correlation") > 0.8, "high overall similarity").when(F.col("mean_correlation") < 0.3, "low overall similarity")
    return d.withColumn("insight", insight).select("*", F.col("p.id").alias("best_id"), F.col("p.rid").alias("best_rid")).drop("p")


# ---- timeframes

#: name -> (points, vanishing moments, levels, weight)
FRAMES = {"short": (16, 2, 1, 0.2), "medium": (32, 3, 2, 0.3), "long": (64, 4, 3, 0.5)}


def fourier_resample(v: np.ndarray, points: int) -> np.ndarray:
    """Rows resampled to fewer points through their spectrum."""
    n = v.shape[1]
    f = np.fft.rfft(v, axis=1)[:, : points // 2 + 1].copy()
    if points % 2 == 0:
        f[:, points // 2] *= 2
    return np.fft.irfft(f, points, axis=1) * points / n


def _frame(v: np.ndarray, points: int) -> np.ndarray:
    return fourier_resample(v, points) if v.shape[1] > points else v


def _frame_features(v, name, points, moments, level):
    x = _frame(v, points)
    for i, c in enumerate(K.wavedec(x, moments, level)):
        mag = np.abs(np.fft.fft(c, axis=1))
        yield f"{name}_level_{i}_mean", c.mean(1)
        yield f"{name}_level_{i}_std", c.std(1)
        yield f"{name}_level_{i}_energy", (c * c).sum(1)
        yield f"{name}_level_{i}_entropy", -(c * c * np.log(c * c + 1e-10)).sum(1)
        yield f"{name}_level_{i}_dominant_freq", mag[:, : c.shape[1] // 2].argmax(1)
        yield f"{name}_level_{i}_spectral_centroid", mag @ np.arange(c.shape[1]) / mag.sum(1)
    t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    dx = x - x.mean(1, keepdims=True)
    yield f"{name}_trend_strength", np.abs((dx @ t) ** 2 / (t @ t) / (dx * dx).sum(1))
    yield f"{name}_volatility", np.diff(x, axis=1).std(1)


def timeframe_features(series: DataFrame, frames=FRAMES) -> DataFrame:
    """Long table (id, frame, pos, name, value)."""
    def fn(pdf):
        out = []
        for g, v in stacked_rows(pdf):
            for frame, (points, moments, level, _) in frames.items():
                for pos, (name, value) in enumerate(_frame_features(v, frame, points, moments, level)):
                    out.append(pd.DataFrame({"id": g.id.to_numpy(), "frame": frame, "pos": pos, "name": name, "value": np.asarray(value, float)}))
        return pd.concat(out)

    return row_kernel(series.select("id", "v"), fn, "id long, frame string, pos int, name string, value double")


def weights_of(frames=FRAMES) -> Column:
    return F.create_map(*[F.lit(x) for n, f in frames.items() for x in (n, f[3])])


def combined(features: DataFrame, frames=FRAMES) -> DataFrame:
    """(id, frame, pos, value): each frame's features as z-scores times the weight of the frame."""
    w = Window.partitionBy("id", "frame")
    z = (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-8)
    return features.select("id", "frame", "pos", (z * F.element_at(weights_of(frames), F.col("frame"))).alias("value"))


def frame_correlations(series: DataFrame, frames=FRAMES) -> DataFrame:
    """(id, frame_a, frame_b, correlation) of the resampled series over their common length."""
    names = list(frames)

    def fn(pdf):
        out = []
        for g, v in stacked_rows(pdf):
            x = [fourier_resample(v, frames[n][0]) if v.shape[1] != frames[n][0] else v for n in names]
            for i, a in enumerate(names):
                for j in range(i, len(names)):
                    m = min(x[i].shape[1], x[j].shape[1])
                    p, q = (y[:, :m] - y[:, :m].mean(1, keepdims=True) for y in (x[i], x[j]))
                    out.append(pd.DataFrame({"id": g.id.to_numpy(), "frame_a": a, "frame_b": names[j], "correlation": (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))}))
        return pd.concat(out)

    return row_kernel(series.select("id", "v"), fn, "id long, frame_a string, frame_b string, correlation double")


def merged_predictions(predictions: DataFrame) -> DataFrame:
    """(id, weighted, median, most_confident) of one prediction per frame (id, frame, weight, prediction)."""
    p = F.col("prediction")
    return predictions.groupBy("id").agg((F.sum(F.col("weight") * p) / F.sum("weight")).alias("weighted"), F.percentile(p, 0.5).alias("median"), F.max_by(p, F.struct(F.abs(p), F.col("weight"))).alias("most_confident"))


# ---- template match

#: templates of one match: the bound of its broadcast
MOST_TEMPLATES = 10_000


def _template_features(v: np.ndarray) -> np.ndarray:
    d = np.diff(v, axis=1)
    mid, l, r = v[:, 1:-1], v[:, :-2], v[:, 2:]
    tops = ((mid > l) & (mid > r) & (mid - np.minimum(l, r) > 0.1)).sum(1)
    lows = ((mid < l) & (mid < r) & (np.maximum(l, r) - mid > 0.1)).sum(1)
    return np.stack([v.mean(1), v.std(1), v.min(1), v.max(1), np.percentile(v, 25, axis=1), np.percentile(v, 75, axis=1), (d > 0).mean(1), np.abs(d).sum(1), tops, lows], axis=1)


def template_match(queries: DataFrame, templates: DataFrame, top: int = 5, least: float = 0.7, window: int = 10) -> DataFrame:
    """(id, rid, similarity, rank): best templates per query among the 3 x ``top`` that are nearest by the cosine of ten features.

    Score: 0.4 warping + 0.3 correlation + 0.2 features + 0.1 length, for z-scored series of equal length. The templates are a library of at most
    ``MOST_TEMPLATES`` rows, broadcast as one array (more are refused: match against them in parts); queries of any number stream past it in batches.
    """
    if templates.limit(MOST_TEMPLATES + 1).count() > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates; match against them in parts")
    packed = templates.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("lib"))

    def z(v):
        s = v.std(1, keepdims=True)
        return (v - v.mean(1, keepdims=True)) / np.where(s > 0, s, 1.0)

    def fn(pdf):
        lib = pdf.lib.iloc[0]
        rid, t = np.array([x["id"] for x in lib]), np.stack([x["v"] for x in lib]).astype(float)
        out = []
        for g, v in stacked_rows(pdf[["id", "v"]]):
            if v.shape[1] != t.shape[1]:
                continue
            q, n = z(v), v.shape[1]
            fq, ft = _template_features(q), _template_features(t)
            cos = fq @ ft.T / (np.linalg.norm(fq, axis=1)[:, None] * np.linalg.norm(ft, axis=1) + 1e-8)
            near = np.argsort(-cos, axis=1, kind="stable")[:, : 3 * top]
            i, j = np.repeat(np.arange(len(q)), near.shape[1]), near.ravel()
            a = np.arange(n)
            d = np.concatenate([K.dtw(q[i[s : s + 512]], t[j[s : s + 512]], np.abs(a[:, None] - a[None, :]) <= window) for s in range(0, len(i), 512)])
            corr = (q[i] * z(t)[j]).mean(1)
            score = np.clip(0.4 * (1 - np.minimum(d / n, 1.0)) + 0.3 * (corr + 1) / 2 + 0.2 * cos[i, j] + 0.1, 0, 1)
            f = pd.DataFrame({"id": g.id.to_numpy()[i], "rid": rid[j], "similarity": score})
            f = f[f.similarity >= least].sort_values(["id", "similarity", "rid"], ascending=[True, False, True])
            f["rank"] = f.groupby("id").cumcount() + 1
            out.append(f[f["rank"] <= top])
        return pd.concat(out) if out else pd.DataFrame({"id": [], "rid": [], "similarity": [], "rank": []})

    return row_kernel(queries.select("id", "v").crossJoin(F.broadcast(packed)), fn, "id long, rid long, similarity double, rank long")


# ---- reference-pattern features


def strided(series: DataFrame, size: int, step: int) -> DataFrame:
    """(id, sid, start, v): sub-windows of each series; ``sid`` numbers all of them."""
    starts = F.sequence(F.lit(0), F.size("v") - size, F.lit(step))
    cut = series.filter(F.size("v") >= size).select("id", "v", F.explode(starts).alias("start"))
    return cut.select("id", (F.col("id") * 4096 + F.col("start")).alias("sid"), "start", F.slice("v", F.col("start") + 1, size).alias("v"))


def nearest_reference(distances: DataFrame) -> DataFrame:
    """(id, start, rid): closest reference of each sub-window (id, start, rid, d)."""
    return distances.groupBy("id", "start").agg(F.min_by("rid", F.struct("d", "rid")).alias("rid"))


def reference_features(distances: DataFrame) -> DataFrame:
    """Per series: moments and best-k means of the best distance to each reference."""
    best = distances.groupBy("id", "rid").agg(F.min("d").alias("d"))
    s = F.array_sort(F.collect_list("d"))
    top = lambda k: F.aggregate(F.slice("_s", 1, k), F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(k), F.size("_s"))
    g = best.groupBy("id").agg(F.min("d").alias("dtw_min_distance"), F.avg("d").alias("dtw_mean_distance"), F.stddev_pop("d").alias("dtw_std_distance"), F.percentile("d", 0.5).alias("dtw_median_distance"), F.min_by("rid", F.struct("d", "rid")).alias("nearest"), s.alias("_s"))
    return g.select("*", *[top(k).alias(f"dtw_top{k}_mean") for k in (1, 3, 5)], F.try_divide("dtw_min_distance", "dtw_mean_distance").alias("distance_ratio")).drop("_s")


def sequence_features(nearest: DataFrame, length: int, references: int) -> DataFrame:
    """Per series: changes of the nearest reference along the series, dominant one, diversity, trend."""
    w = Window.partitionBy("id").orderBy("start")
    d = nearest.withColumn("_moved", (F.col("rid") != F.lag("rid").over(w)).cast("long"))
    t = F.col("start") / F.lit(length)
    g = d.groupBy("id").agg(F.coalesce(F.sum("_moved"), F.lit(0)).alias("transitions"), F.count("*").alias("_n"), F.countDistinct("rid").alias("_u"), F.regr_slope(F.col("rid").cast("double"), t).alias("trend_slope"), F.regr_r2(F.col("rid").cast("double"), t).alias("trend_r2"))
    top = d.groupBy("id", "rid").agg(F.count("*").alias("c")).groupBy("id").agg(F.max_by("rid", F.struct("c", -F.col("rid"))).alias("dominant"), F.max("c").alias("_c"))
    g = g.join(top, "id")
    return g.select("id", "transitions", (1 - F.col("transitions") / F.greatest(F.col("_n") - 1, F.lit(1))).alias("stability"), "dominant", (F.col("_c") / F.col("_n")).alias("dominant_share"), (F.col("_u") / F.lit(references)).alias("diversity"), "trend_slope", "trend_r2")


# ---- vocabulary


def vocabulary(items: DataFrame) -> DataFrame:
    """(cluster, id, v): the member nearest to the mean of each cluster of (id, cluster, v)."""
    mean = items.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    gap = F.aggregate(F.zip_with("v", F.col("c.m"), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    near = items.join(centre, "cluster").select("cluster", "id", "v", gap.alias("gap"))
    return near.groupBy("cluster").agg(F.min_by(F.struct("id", "v"), F.struct("gap", "id")).alias("r")).select("cluster", "r.id", "r.v")


def match_vocabulary(queries: DataFrame, words: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, cluster, similarity): best word by correlation over the common length; the vocabulary has one row per cluster and is broadcast."""
    n = F.least(F.size("v"), F.size("w"))
    d = queries.select("id", "v").crossJoin(F.broadcast(words.select("cluster", F.col("v").alias("w")))).select("id", "cluster", F.explode(F.array(F.struct(F.slice("v", 1, n).alias("a"), F.slice("w", 1, n).alias("b")))).alias("p"))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    d = d.select("id", "cluster", "p.a", "p.b", mean(F.col("p.a")).alias("ma"), mean(F.col("p.b")).alias("mb"))
    tot = lambda f: F.aggregate(F.zip_with("a", "b", f), F.lit(0.0), lambda s, x: s + x)
    da, db = (lambda a: a - F.col("ma")), (lambda b: b - F.col("mb"))
    r = F.try_divide(tot(lambda a, b: da(a) * db(b)), F.sqrt(tot(lambda a, b: da(a) * da(a)) * tot(lambda a, b: db(b) * db(b))))
    best = d.select("id", "cluster", r.alias("r")).filter(F.col("r") >= threshold).groupBy("id").agg(F.max(F.struct("r", -F.col("cluster"))).alias("b"))
    return best.select("id", (-F.col("b")["col2"]).alias("cluster"), F.col("b.r").alias("similarity"))

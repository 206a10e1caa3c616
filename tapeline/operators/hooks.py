"""Caller-supplied functions, random-kernel features, label medoids, indexed search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import rolled
from tapeline.operators.pairs import row_kernel, stacked_rows, tiles


def rolling_apply(df: DataFrame, column: str, n: int, fn, name: str) -> DataFrame:
    """``fn(matrix of frames) -> vector`` over full frames of ``n`` rows, in Arrow batches."""
    d = rolled(df, lambda h, w: h.select("symbol", "seq", "_c", F.collect_list(column).over(w.rowsBetween(1 - n, 0)).alias("_f")), n)

    @F.pandas_udf("double")
    def call(frames: pd.Series) -> pd.Series:
        full = frames.map(len).to_numpy() == n
        out = np.full(len(frames), np.nan)
        if full.any():
            out[full] = fn(np.stack(frames[full].to_list()))
        return pd.Series(out)

    return d.select("symbol", "seq", F.nanvl(call("_f"), F.lit(None)).alias(name))


def apply_features(df: DataFrame, extractor, schema: str) -> DataFrame:
    """Row-batch hook: ``extractor(pdf) -> pdf`` with the given schema."""
    return row_kernel(df, extractor, schema)


def kernel_bank(count=50, seed=42) -> list[np.ndarray]:
    """Seeded random kernels of length 7, 9 or 11."""
    rng = np.random.default_rng(seed)
    return [rng.normal(size=rng.choice([7, 9, 11])) for _ in range(count)]


def random_kernels(series: DataFrame, count=50, seed=42, pooling="max") -> DataFrame:
    """Features of seeded random convolutions (same kernels for every row): windows times a matrix of the kernels of one length, pooled; 0 for shorter series."""
    bank = kernel_bank(count, seed)
    by_size = {n: [k for k, w in enumerate(bank) if len(w) == n] for n in {len(w) for w in bank}}

    def fn(pdf):
        parts = []
        for rows, v in stacked_rows(pdf):
            out = np.zeros((len(v), count))
            for n, ks in by_size.items():
                if v.shape[1] >= n:
                    windows = np.lib.stride_tricks.sliding_window_view(v, n, axis=1)
                    out[:, ks] = getattr(windows @ np.stack([bank[k] for k in ks], axis=1), pooling)(axis=1)
            parts.append(pd.DataFrame({"id": rows.id.to_numpy(), "features": list(out)}))
        return pd.concat(parts) if parts else pd.DataFrame({"id": [], "features": []})

    return row_kernel(series.select("id", "v"), fn, "id long, features array<double>")


def label_medoids(series: DataFrame) -> DataFrame:
    """Per label the member with the smallest distance sum, and the distance statistics inside the label.

    Tiles are made inside a label and return one partial row per member, never the pairs.
    """
    def kernel(x, y):
        vx, vy = np.stack(x.v.to_list()), np.stack(y.v.to_list())
        d = np.sqrt(((vx[:, None, :] - vy[None, :, :]) ** 2).sum(2))
        off = x.id.to_numpy()[:, None] != y.id.to_numpy()[None, :]
        sides = [(x, 1)] if x.index.equals(y.index) else [(x, 1), (y, 0)]
        return pd.concat([pd.DataFrame({"label": s.label, "id": s.id, "s": (d * off).sum(axis), "n": off.sum(axis), "mx": np.where(off, d, 0).max(axis)}) for s, axis in sides])

    def reduce(d):
        return d.groupby(["label", "id"], as_index=False).agg({"s": "sum", "n": "sum", "mx": "max"})

    t = tiles(series.select("id", "label", "v").filter("label IS NOT NULL"), None, kernel, "label int, id long, s double, n long, mx double", reduce=reduce, by=["label"])
    m = t.groupBy("label", "id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("mx").alias("mx"))
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", F.struct("s", "id")).alias("medoid"), (F.sum("s") / F.sum("n")).alias("mean_distance"), F.max("mx").alias("max_distance"))


def indexed_search(queries: DataFrame, library: DataFrame, k=5, gate=2.0, least=0.0) -> DataFrame:
    """Nearest library items whose mean, deviation and trend differ by less than ``gate`` in sum."""
    def stats(v):
        x = np.arange(v.shape[1]) - (v.shape[1] - 1) / 2
        return np.stack([v.mean(1), v.std(1), v @ x / (x @ x)], axis=1)

    def kernel(a, b):
        va, vb = np.stack(a.v.to_list()), np.stack(b.v.to_list())
        near = np.abs(stats(va)[:, None, :] - stats(vb)[None, :, :]).sum(2) < gate
        sim = 1 / (1 + np.sqrt(((va[:, None, :] - vb[None, :, :]) ** 2).sum(2)))
        i, j = np.nonzero(near & (sim >= least))
        d = pd.DataFrame({"a": a.id.to_numpy()[i], "b": b.id.to_numpy()[j], "similarity": sim[i, j]}).sort_values(["a", "similarity", "b"], ascending=[True, False, True])
        return d.groupby("a").head(k)

    d = tiles(queries, library, kernel, "a long, b long, similarity double")
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

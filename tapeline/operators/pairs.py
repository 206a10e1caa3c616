"""Distance jobs between many series: tiles of block pairs, each one Arrow task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import kernels as K
from tapeline.functions.lineage import store


#: Blocks of a side, unless they would hold more than ``_ROWS`` rows: more series make larger blocks, not more copies of each series.
_BLOCKS, _ROWS = 32, 16384
#: Pairs of one sweep of the warping kernel.
_SWEEP = 512


def block_count(rows: int, size: int) -> int:
    return max(1, min(math.ceil(rows / size), _BLOCKS), math.ceil(rows / _ROWS))


def _parts(block: pd.DataFrame, step: int) -> list:
    """The block in parts of ``step`` ids; the rows of an id stay together."""
    return [g for _, g in block.groupby(pd.factorize(block.id)[0] // step)]


def _meet(kernel, pairs, reduce):
    """Outputs of the kernel for pairs of parts; with ``reduce`` one output, which holds ``reduce`` of all rows so far."""
    kept = None
    for a, b in pairs:
        out = kernel(a, b)
        if not len(out):
            continue
        if reduce is None:
            yield out
        else:
            kept = reduce(out if kept is None else pd.concat([kept, out]))
    if kept is not None:
        yield kept


def tiles(left: DataFrame, right: DataFrame | None, kernel, schema: str, size: int = 64, step: int = 256, reduce=None, by=()) -> DataFrame:
    """Apply ``kernel(left_block, right_block)`` to every pair of blocks.

    Series (id, v, ...) are spread over blocks by hash; a block is copied to
    the tiles it meets, so a task holds two blocks and no row pairs are
    shuffled.  A series has about as many copies as there are blocks, at most
    ``_BLOCKS`` until blocks reach ``_ROWS`` rows.  Inside a tile the kernel
    sees parts of at most ``step`` ids and rows leave part by part, or, with
    ``reduce``, cut down by it to one frame for the tile.  Without ``right``
    the left side meets itself (inside the groups of ``by``) and the kernel
    must keep only id pairs with a < b.
    """
    blk = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    rows = left.count()
    if right is None:
        n = block_count(rows, size)
        me = left.withColumn("_b", blk(n))
        other = F.sequence(F.lit(0), F.lit(n - 1))
        pair = F.transform(other, lambda o: F.struct(F.least(o, F.col("_b")).alias("p"), F.greatest(o, F.col("_b")).alias("q")))
        x = me.withColumn("_t", F.explode(pair)).select(*left.columns, "_b", "_t.p", "_t.q")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(frames, ignore_index=True)
            a, b = _parts(pdf[pdf._b == pdf.p], step), _parts(pdf[pdf._b == pdf.q], step)
            once = pdf.p.iloc[0] == pdf.q.iloc[0]
            yield from _meet(kernel, ((x, y) for i, x in enumerate(a) for y in (a[i:] if once else b)), reduce)

        # a tile is little data but much work, so the task count is fixed instead of coalesced by size
        keys = [*by, "p", "q"]
        return x.repartition(min(n * (n + 1) // 2, 8192), *keys).groupBy(*keys).applyInPandas(run, schema)
    others = right.count()
    n, m = (max(1, math.ceil(k / size)) for k in (rows, others))
    if min(n, m) > _BLOCKS:  # else one side is small, and only that has many copies
        n, m = block_count(rows, size), block_count(others, size)
    l = left.withColumn("p", blk(n)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    r = right.withColumn("q", blk(m)).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def cross(a, b):
        out = list(_meet(kernel, ((x, y) for x in _parts(a, step) for y in _parts(b, step)), reduce))
        return pd.concat(out) if out else pd.DataFrame()

    return l.groupBy("p", "q").cogroup(r.groupBy("p", "q")).applyInPandas(cross, schema)


def _by_length(a, b):
    """Index grids of equal-length sub-blocks as (ia, ib, A, B) matrices."""
    la, lb = a.v.map(len).to_numpy(), b.v.map(len).to_numpy()
    for n in np.unique(la):
        for m in np.unique(lb):
            ia, ib = np.flatnonzero(la == n), np.flatnonzero(lb == m)
            yield ia, ib, np.stack(a.v.iloc[ia].to_list()), np.stack(b.v.iloc[ib].to_list())


def _distance_kernel(once: bool, allowed=None, limit=None, within=None, carry=()):
    def kernel(a, b):
        out = []
        ida, idb = a.id.to_numpy(), b.id.to_numpy()
        for ia, ib, va, vb in _by_length(a, b):
            gi, gj = (g.ravel() for g in np.meshgrid(np.arange(len(ia)), np.arange(len(ib)), indexing="ij"))
            if once:
                # within one block each pair shows up twice; across two blocks it shows up once
                keep = (ida[ia[gi]] < idb[ib[gj]]) | (not a.index.equals(b.index))
                gi, gj = gi[keep], gj[keep]
            n, m = va.shape[1], vb.shape[1]
            mask = allowed(n, m) if allowed else None
            most = min(math.inf if limit is None else limit, math.inf if within is None else within * (n + m) * (1 + 1e-9))
            if most < math.inf:
                # every path starts and ends in the corners, so their costs bound the distance from below
                bound = np.abs(va[gi, 0] - vb[gj, 0]) + (np.abs(va[gi, -1] - vb[gj, -1]) if n > 1 or m > 1 else 0.0)
                ok = bound <= most
                gi, gj = gi[ok], gj[ok]
            if not len(gi):
                continue
            d = np.concatenate([K.dtw(va[gi[s : s + _SWEEP]], vb[gj[s : s + _SWEEP]], mask) for s in range(0, len(gi), _SWEEP)])
            x, y = ida[ia[gi]], idb[ib[gj]]
            swap = (x > y) if once else np.zeros(len(x), dtype=bool)
            res = {"a": np.where(swap, y, x), "b": np.where(swap, x, y), "distance": d, "normalized": d / (n + m)}
            for c in carry:
                x, y = a[c].to_numpy()[ia[gi]], b[c].to_numpy()[ib[gj]]
                res |= {f"{c}_a": np.where(swap, y, x), f"{c}_b": np.where(swap, x, y)}
            out.append(pd.DataFrame(res))
        res = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "distance": [], "normalized": []})
        if limit is not None:
            res = res[res.distance <= limit]
        return res if within is None else res[res.normalized <= within]

    return kernel


_PAIR = "a long, b long, distance double, normalized double"


def distance_pairs(series: DataFrame, allowed=None, limit=None, within=None, carry=()) -> DataFrame:
    """DTW of every unordered pair a < b; ``limit`` keeps only pairs at most that far apart, ``within`` those with a normalized distance up to it.

    Columns ``carry`` of the series come along as c_a and c_b.
    """
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([_PAIR, *(f"{c}_{side} {kinds[c]}" for c in carry for side in "ab")])
    return tiles(series, None, _distance_kernel(True, allowed, limit, within, carry), schema)


def similarity(pairs: DataFrame) -> DataFrame:
    """similarity = 1 - distance / largest distance."""
    pairs = store(pairs)
    top = pairs.agg(F.max("normalized").alias("_mx"))
    return pairs.crossJoin(F.broadcast(top)).withColumn("similarity", 1 - F.try_divide("normalized", "_mx")).drop("_mx")


def cross_distances(queries: DataFrame, references: DataFrame, allowed=None) -> DataFrame:
    """DTW of every query with every reference."""
    return tiles(queries, references, _distance_kernel(False, allowed), _PAIR)


def nearest(queries: DataFrame, references: DataFrame, k: int, limit=None) -> DataFrame:
    """k nearest references per query; every tile sends only its own best k."""
    base = _distance_kernel(False)

    def best(d):
        return d.sort_values(["a", "normalized", "b"]).groupby("a").head(k)

    d = tiles(queries, references, base, _PAIR, reduce=best)
    if limit is not None:
        d = d.filter(F.col("normalized") <= limit)
    w = Window.partitionBy("a").orderBy("normalized", "b")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def correlated_edges(series: DataFrame, threshold: float) -> DataFrame:
    """Unordered pairs of equal-length arrays with correlation above the threshold."""
    def kernel(a, b):
        out = []
        ida, idb = a.id.to_numpy(), b.id.to_numpy()
        for ia, ib, va, vb in _by_length(a, b):
            if va.shape[1] != vb.shape[1]:
                continue
            z = lambda v: (v - v.mean(1, keepdims=True)) / np.maximum(v.std(1, keepdims=True), 1e-300)
            c = z(va) @ z(vb).T / va.shape[1]
            i, j = np.nonzero(c > threshold)
            x, y = ida[ia[i]], idb[ib[j]]
            out.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "corr": c[i, j]})[x != y])
        return pd.concat(out).drop_duplicates(["a", "b"]) if out else pd.DataFrame({"a": [], "b": [], "corr": []})

    return tiles(series, None, kernel, "a long, b long, corr double", step=1024)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Mean, deviation and range over the upper triangle."""
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg("normalized").alias("mean"), F.stddev_pop("normalized").alias("std"), F.min("normalized").alias("min"), F.max("normalized").alias("max"))


def item_means(pairs: DataFrame) -> DataFrame:
    """Mean distance of each item to all others."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id"), "normalized").groupBy("id").agg(F.avg("normalized").alias("mean_distance"))


def row_kernel(df: DataFrame, fn, schema: str) -> DataFrame:
    """Arrow-batched map over rows; ``fn(pdf) -> pdf``."""
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)

    return df.mapInPandas(run, schema)


def alignments(pairs: DataFrame, mode="exact", radius=1, width=8) -> DataFrame:
    """Distance, path length and path of (id, rid, x, y) pairs; exact, fast, band or itakura. Pairs of equal lengths are swept and traced back together."""
    masks = {"exact": lambda n, m: None, "band": lambda n, m: K.band(n, m, width), "itakura": K.parallelogram}

    def fn(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for (n, m), g in pdf.groupby([pdf.x.map(len), pdf.y.map(len)]):
                step = max(1, (1 << 22) // (n * m))
                for at in range(0, len(g), step):
                    part = g.iloc[at : at + step]
                    x, y = (np.stack(part[c].to_list()).astype(float) for c in ("x", "y"))
                    distance, paths = K.fast_paths(x, y, radius) if mode == "fast" else K.dtw_paths(x, y, masks[mode](n, m))
                    yield rows(part, distance, paths)

    def rows(part, distance, paths):
        """The rows of one sweep, paths as two flat columns: a batch keeps no Python value for each step."""
        steps = np.array([len(p) for p in paths])
        ij = np.concatenate(paths).reshape(-1, 2).astype(np.int32)
        path = pa.ListArray.from_arrays(np.append(0, np.cumsum(steps)).astype(np.int32), pa.StructArray.from_arrays([pa.array(c) for c in ij.T], ["i", "j"]))
        ids = [pa.Array.from_pandas(part[c]).cast(pa.int64()) for c in ("id", "rid")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(distance, pa.float64()), pa.array(steps, pa.int64()), path], ["id", "rid", "distance", "steps", "path"])

    return pairs.select("id", "rid", "x", "y").mapInArrow(fn, "id long, rid long, distance double, steps long, path array<struct<i:int,j:int>>")


def spectra(series: DataFrame) -> DataFrame:
    """FFT features; equal-length rows of a batch are transformed together."""
    def fn(pdf):
        parts = []
        for _, g in pdf.groupby(pdf.v.map(len)):
            parts.append(pd.DataFrame({"id": g.id.to_numpy(), **K.spectrum(np.stack(g.v.to_list()))}))
        return pd.concat(parts)

    names = "dominant_frequency dominant_power total_power power_std centroid bandwidth high_ratio".split()
    return row_kernel(series.select("id", "v"), fn, "id long, " + ", ".join(f"{c} double" for c in names))


def stacked_rows(pdf: pd.DataFrame, column="v"):
    """(rows, matrix) for the equal-length arrays of a batch."""
    for _, g in pdf.groupby(pdf[column].map(len)):
        yield g, np.stack(g[column].to_list()).astype(float)


def wavelet_levels(series: DataFrame, moments=4, level=None) -> DataFrame:
    """Long table (id, level, pos, coef); level 0 is the approximation."""
    def fn(pdf):
        rows = []
        for g, v in stacked_rows(pdf):
            for lv, c in enumerate(K.wavedec(v, moments, level)):
                rows.append(pd.DataFrame({"id": np.repeat(g.id.to_numpy(), c.shape[1]), "level": lv, "pos": np.tile(np.arange(c.shape[1]), len(c)), "coef": c.ravel()}))
        return pd.concat(rows)

    return row_kernel(series.select("id", "v"), fn, "id long, level int, pos int, coef double")


def energy_distribution(levels: DataFrame) -> DataFrame:
    """Energy per level, its share, entropy of the shares and the dominant level."""
    e = levels.groupBy("id", "level").agg(F.sum(F.col("coef") * F.col("coef")).alias("energy"))
    w = Window.partitionBy("id")
    e = e.withColumn("share", F.col("energy") / F.sum("energy").over(w))
    g = e.groupBy("id").agg((-F.sum(F.col("share") * F.log2(F.col("share") + 1e-10))).alias("entropy"), F.max_by("level", "energy").alias("dominant"))
    return e.join(g, "id")


def denoised(series: DataFrame, moments=4, level=None, hard=False) -> DataFrame:
    def fn(pdf):
        return pd.concat([pd.DataFrame({"id": g.id.to_numpy(), "v": list(K.denoise(v, moments, level, hard))}) for g, v in stacked_rows(pdf)])

    return row_kernel(series.select("id", "v"), fn, "id long, v array<double>")

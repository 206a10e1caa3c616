"""Extrema with a minimum distance, triangles and wedges, rule-based classification of windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import arrays as A
from tapeline.functions import frames
from tapeline.functions.frames import number_rows, rolled, running
from tapeline.functions.lineage import store

SIDES = {"peak": 1.0, "valley": -1.0}


def turning_points(bars: DataFrame) -> DataFrame:
    """(symbol, side, seq, height): middles of flat runs higher (side 1) or lower (-1) than both neighbours; height = side x close."""
    flat = rolled(bars, lambda h, w: h.withColumn("_new", (~F.lag("close").over(w).eqNullSafe(F.col("close"))).cast("int")), 1)
    runs = running(flat, {"_run": (F.col("_new"), "sum")}).groupBy("symbol", "_run").agg(F.min("seq").alias("s"), F.max("seq").alias("e"), F.min("close").alias("p"))
    near = rolled(runs.withColumnRenamed("_run", "seq"), lambda h, w: h.withColumns({"l": F.lag("p").over(w), "r": F.lead("p").over(w)}), 1, 1)
    sides = near.withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(-1.0))))
    side = F.col("side")
    turns = sides.filter((side * F.col("p") > side * F.col("l")) & (side * F.col("p") > side * F.col("r")))
    return turns.select("symbol", "side", F.floor((F.col("s") + F.col("e")) / 2).alias("seq"), (side * F.col("p")).alias("height"))


def spaced(points: DataFrame, distance: int) -> DataFrame:
    """Points that are left when the highest goes first and removes what is nearer than ``distance``; of equal ones the later goes first.

    Removal only acts inside clusters of points closer than ``distance``, so points are cut at wider gaps and each cluster is solved on its own.
    """
    by = ["symbol", "side"]
    numbered = number_rows(points.withColumnRenamed("seq", "at"), ["at"], F.floor(F.col("at") / 4096), by)
    gaps = rolled(numbered, lambda h, w: h.withColumn("_cut", (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(distance)) >= distance).cast("int")), 1, by=by)
    clusters = running(gaps, {"cluster": (F.col("_cut"), "sum")}, by)
    lists = clusters.groupBy(*by, "cluster").agg(F.array_sort(F.collect_list(F.struct("at", "height"))).alias("c"))
    single = lists.filter(F.size("c") == 1).select(*by, F.col("c")[0]["at"].alias("seq"))

    def solve(batches):
        for pdf in batches:
            rows = []
            for symbol, side, at, height in zip(pdf.symbol, pdf.side, pdf["at"], pdf.height):
                at, free = np.asarray(at), np.ones(len(at), bool)
                for k in np.lexsort((at, np.asarray(height)))[::-1]:
                    if free[k]:
                        free[np.searchsorted(at, at[k] - distance, "right") : np.searchsorted(at, at[k] + distance, "left")] = False
                        rows.append((symbol, side, at[k]))
            yield pd.DataFrame(rows, columns=["symbol", "side", "seq"])

    many = lists.filter(F.size("c") > 1).select(*by, F.col("c.at").alias("at"), F.col("c.height").alias("height"))
    return single.unionByName(many.mapInPandas(solve, single.schema))


def extrema(bars: DataFrame, order=5) -> DataFrame:
    """Bars with ``peak`` and ``valley`` marks at a minimum distance of ``order``, the most extreme kept first."""
    kept = spaced(store(turning_points(bars)), order).groupBy("symbol", "seq").agg(F.max(F.col("side") > 0).alias("peak"), F.max(F.col("side") < 0).alias("valley"))
    marks = bars.join(kept, ["symbol", "seq"], "left")
    return marks.withColumns({"peak": F.coalesce("peak", F.lit(False)), "valley": F.coalesce("valley", F.lit(False))})


def _spaced_masks(height: np.ndarray, mask: np.ndarray, distance: int) -> np.ndarray:
    """The same rule for every row of a matrix of windows at once."""
    left, kept = mask.copy(), np.zeros_like(mask)
    while left.any():
        h = np.where(left, height, -np.inf)
        best, near = left.copy(), np.zeros_like(mask)
        for d in range(1, distance):
            best[:, d:] &= h[:, d:] >= h[:, :-d]
            best[:, :-d] &= h[:, :-d] > h[:, d:]
        for d in range(1, distance):
            near[:, d:] |= best[:, :-d]
            near[:, :-d] |= best[:, d:]
        kept |= best
        left &= ~(best | near)
    return kept


def _line(mask: np.ndarray, x: np.ndarray):
    """Per row: points, slope, correlation, deviation over mean of the marked values."""
    t = np.arange(x.shape[1], dtype=float)
    n = mask.sum(1).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        mt, mx = (mask * t).sum(1) / n, np.where(mask, x, 0.0).sum(1) / n
        dt, dx = np.where(mask, t - mt[:, None], 0.0), np.where(mask, x - mx[:, None], 0.0)
        stt, sxx, stx = (dt * dt).sum(1), (dx * dx).sum(1), (dt * dx).sum(1)
        r = np.where(stt * sxx > 0, stx / np.sqrt(stt * sxx), 0.0)
        return n, stx / stt, np.clip(r, -1, 1), np.sqrt(sxx / n) / mx


def _shapes_of(x: np.ndarray, size: int, distance: int):
    """(start, kind, confidence) of the formations of one window size in a run of prices."""
    w = np.lib.stride_tricks.sliding_window_view(x, size)
    turn = {}
    for name, side in SIDES.items():
        y = side * x
        first = np.flatnonzero(np.concatenate(([True], y[1:] != y[:-1])))
        last = np.concatenate((first[1:], [len(y)])) - 1
        inner = slice(1, len(first) - 1)
        top = (y[first[inner]] > y[first[inner] - 1]) & (y[last[inner]] > y[last[inner] + 1]) if len(first) > 2 else np.zeros(0, bool)
        f, e = first[inner][top], last[inner][top]
        lo, hi = np.full(len(x), len(x)), np.full(len(x), -1)  # rows that a window must hold for the point to count
        lo[(f + e) // 2], hi[(f + e) // 2] = f - 1, e + 1
        view = np.lib.stride_tricks.sliding_window_view
        start = np.arange(len(w))[:, None]
        mask = (view(lo, size) >= start) & (view(hi, size) >= 0) & (view(hi, size) < start + size)
        turn[name] = _line(_spaced_masks(side * w, mask, distance), w)
    (np_, ps, pr, pc), (nv, vs, vr, vc) = turn["peak"], turn["valley"]
    enough = (np_ >= 2) & (nv >= 2)
    kinds = {
        "ascending_triangle": ((pc < 0.02) & (vs > 0) & (abs(vr) > 0.8), 0.7 + abs(vr) * 0.2),
        "descending_triangle": ((vc < 0.02) & (ps < 0) & (abs(pr) > 0.8), 0.7 + abs(pr) * 0.2),
        "rising_wedge": ((abs(pr) > 0.8) & (abs(vr) > 0.8) & (ps > 0) & (vs > ps), 0.7 + (abs(pr) + abs(vr)) * 0.1),
        "falling_wedge": ((abs(pr) > 0.8) & (abs(vr) > 0.8) & (ps < 0) & (vs < ps), 0.7 + (abs(pr) + abs(vr)) * 0.1),
    }
    for kind, (ok, confidence) in kinds.items():
        at = np.flatnonzero(ok & enough)
        yield at, kind, confidence[at]


def sliding_formations(bars: DataFrame, sizes=range(10, 50), distance=3) -> DataFrame:
    """(symbol, start, end, kind, confidence) of triangles and wedges over all windows of the given sizes.

    Chunks of bars carry the rows that their last windows need; all windows of one size are solved as one matrix.
    """
    sizes = list(sizes)
    size = frames.CHUNK
    rows = frames.halo(bars.select("symbol", "seq", "close"), 0, max(sizes) + 1, size).groupBy("symbol", "_c").agg(F.array_sort(F.collect_list(F.struct("seq", "close"))).alias("r"))

    def solve(batches):
        for pdf in batches:
            out = []
            for symbol, c, seq, close in zip(pdf.symbol, pdf._c, pdf.seq, pdf.close):
                x, base = np.asarray(close, float), int(seq[0])
                for n in sizes:
                    if len(x) <= n:  # a window needs one more row behind it
                        continue
                    for at, kind, confidence in _shapes_of(x[:-1], n, distance):
                        home = at + base < (c + 1) * size
                        at, confidence = at[home] + base, confidence[home]
                        out.append(pd.DataFrame({"symbol": symbol, "start": at, "end": at + n, "kind": kind, "confidence": confidence}))
            yield pd.concat(out) if out else pd.DataFrame({"symbol": [], "start": [], "end": [], "kind": [], "confidence": []})

    return rows.select("symbol", "_c", "r.seq", "r.close").mapInPandas(solve, "symbol string, start long, end long, kind string, confidence double")


# ---- rule-based classification

#: Library of definitions; a rule is (name, tolerance or None).
LIBRARY = {
    "Head and Shoulders": ("traditional", [(0.0, "start"), (0.2, "left_shoulder_peak"), (0.3, "left_valley"), (0.5, "head_peak"), (0.7, "right_valley"), (0.8, "right_shoulder_peak"), (1.0, "end")],
                           [("head_higher_than_shoulders", None), ("shoulders_similar_height", 0.1), ("valleys_similar_height", 0.1), ("minimum_duration", 20.0)]),
    "Ascending Triangle": ("traditional", [(0.0, "start"), (0.25, "resistance_1"), (0.5, "resistance_2"), (0.75, "resistance_3"), (1.0, "breakout")],
                           [("resistance_level_flat", 0.02), ("support_trend_rising", None), ("minimum_touches", 2.0), ("volume_pattern", None)]),
    "Bull Flag": ("traditional", [(0.0, "flagpole_start"), (0.3, "flagpole_end"), (0.65, "flag_middle"), (1.0, "breakout")],
                  [("flagpole_angle", None), ("flag_angle", None), ("flag_duration_ratio", None), ("volume_spike_on_breakout", None)]),
    "Double Bottom": ("traditional", [(0.0, "start"), (0.25, "first_bottom"), (0.5, "middle_peak"), (0.75, "second_bottom"), (1.0, "breakout")],
                      [("bottoms_similar", 0.02), ("middle_peak_higher", None), ("minimum_separation", 10.0), ("volume_pattern", None)]),
    "Cup and Handle": ("traditional", [(0.0, "cup_start"), (0.5, "cup_bottom"), (0.8, "cup_end"), (0.9, "handle_bottom"), (1.0, "breakout")],
                       [("cup_shape", None), ("handle_depth", None), ("handle_duration", None), ("volume_pattern", None)]),
}
THRESHOLD = 0.7


def definitions(spark, custom: dict | None = None) -> DataFrame:
    """The library as a table (name, category, threshold, key_points, rules); ``custom`` entries are added or replace entries of the same name."""
    rows = [(n, c, THRESHOLD, [(float(p), t) for p, t in k], [(r, v) for r, v in rules]) for n, (c, k, rules) in (LIBRARY | (custom or {})).items()]
    return spark.createDataFrame(rows, "name string, category string, threshold double, key_points array<struct<position:double,type:string>>, rules array<struct<rule:string,value:double>>")


def _point(position: Column, kind: Column) -> Column:
    """Value at a key point: the nearest peak or valley for kinds named so, else the value at the position."""
    at = F.floor(position * (F.size("v") - 1)).cast("int")

    def nearest(spots):
        order = F.transform(spots, lambda i: F.struct(F.abs(i - at).alias("d"), i.alias("i")))
        return F.when(F.size(spots) > 0, F.array_min(order).i).otherwise(at)

    spot = F.when(kind.contains("peak"), nearest(F.col("peaks"))).when(kind.contains("valley") | kind.contains("bottom"), nearest(F.col("valleys"))).otherwise(at)
    return F.get(F.col("v"), spot)


def _score(rule: Column, value: Column, points: Column) -> Column:
    get = lambda name: F.try_element_at(points, F.lit(name))
    head, left, right, first, second = map(get, ("head_peak", "left_shoulder_peak", "right_shoulder_peak", "first_bottom", "second_bottom"))
    levels = F.filter(F.map_entries(points), lambda e: e.key.contains("resistance"))
    values = F.transform(levels, lambda e: e.value)
    mean = A.mean(values)
    near = lambda diff: 1 - F.least(F.lit(1.0), diff / value)
    return (
        F.when(rule == "head_higher_than_shoulders", F.coalesce(F.when((head > left) & (head > right), F.least(F.lit(1.0), F.least(head / left, head / right) - 1)), F.lit(0.0)))
        .when(rule == "shoulders_similar_height", F.coalesce(near(F.abs(left - right) / F.greatest(left, right)), F.lit(0.0)))
        .when(rule == "resistance_level_flat", F.when(F.size(values) >= 2, near(A.std(values, mean) / mean)).otherwise(0.0))
        .when(rule == "bottoms_similar", F.coalesce(near(F.abs(first - second) / F.least(first, second)), F.lit(0.0)))
        .otherwise(0.5)
    )


def classify(windows: DataFrame, library: DataFrame) -> DataFrame:
    """(symbol, seq, name, category, confidence): the best definition of each window of prices ``v`` that reaches its threshold.

    Rules without a formula count 0.5. A window that matches nothing is ``fractal`` if its halves correlate above 0.7 in size, else
    ``shapelet`` if two of four unusual traits hold, else it has no row. The library is broadcast; its size is that of a hand-written list.
    """
    inner = F.sequence(F.lit(1), F.size("v") - 2)
    at = lambda i: F.get(F.col("v"), i)
    w = windows.filter(F.size("v") >= 3)
    w = A.hold(w, peaks=F.filter(inner, lambda i: (at(i) > at(i - 1)) & (at(i) > at(i + 1))), valleys=F.filter(inner, lambda i: (at(i) < at(i - 1)) & (at(i) < at(i + 1))))
    pairs = w.crossJoin(F.broadcast(library))
    pairs = A.hold(pairs, points=F.map_from_entries(F.transform("key_points", lambda k: F.struct(k["type"].alias("key"), _point(k["position"], k["type"]).alias("value")))))
    scored = pairs.withColumn("confidence", A.mean(F.transform("rules", lambda r: _score(r["rule"], r["value"], F.col("points")))))
    best = F.max(F.when(F.col("confidence") >= F.col("threshold"), F.struct("confidence", F.col("name").alias("n"), F.col("category").alias("c")))).alias("best")
    one = scored.groupBy("symbol", "seq").agg(best)
    traits = A.hold(w, mean=A.mean("v"))
    traits = A.hold(traits, sd=A.std("v", F.col("mean")))
    z = lambda p: A.mean(F.transform("v", lambda x: F.pow((x - F.col("mean")) / F.col("sd"), p)))
    half = F.floor(F.size("v") / 2).cast("int")
    traits = A.hold(traits, skew=F.when(F.col("sd") > 0, z(3)).otherwise(0.0), kurt=F.when(F.col("sd") > 0, z(4) - 3).otherwise(0.0), a=F.slice("v", 1, half), b=F.slice("v", half + 1, half))
    traits = A.hold(traits, ra=A.resample("a", 100), rb=A.resample("b", 100))
    traits = A.hold(traits, ma=A.mean("ra"), mb=A.mean("rb"))
    traits = A.hold(traits, ca=F.transform("ra", lambda x: x - F.col("ma")), cb=F.transform("rb", lambda x: x - F.col("mb")))
    corr = F.try_divide(A.dot("ca", "cb"), F.sqrt(A.dot("ca", "ca") * A.dot("cb", "cb")))
    n_peaks, n_valleys = F.size("peaks"), F.size("valleys")
    ratio = n_peaks / (n_valleys + 1)
    odd = sum(c.cast("int") for c in ((n_peaks >= 3) & (n_valleys >= 3), F.abs("skew") > 1.5, F.col("kurt") > 3, (ratio < 0.5) | (ratio > 2)))
    kind = F.when((F.size("v") >= 20) & (F.abs(corr) > 0.7), F.struct(F.lit(0.8).alias("confidence"), F.lit("Fractal Pattern").alias("n"), F.lit("fractal").alias("c"))).when(odd >= 2, F.struct(F.lit(0.75).alias("confidence"), F.lit("Shapelet").alias("n"), F.lit("shapelet").alias("c")))
    other = traits.select("symbol", "seq", kind.alias("other"))
    found = one.join(other, ["symbol", "seq"]).withColumn("best", F.coalesce("best", "other")).filter(F.col("best").isNotNull())
    return found.select("symbol", "seq", F.col("best.n").alias("name"), F.col("best.c").alias("category"), F.col("best.confidence").alias("confidence"))

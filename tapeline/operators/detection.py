"""Chart formations, shapelets, subsequence search, matrix profile."""

from __future__ import annotations


from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import arrays as A
from tapeline.functions import kernels as K
from tapeline.functions.frames import div, number_rows, rolled, running
from tapeline.operators.symbolic import sax


#: Patterns of one search: the bound of its broadcast.
MOST_PATTERNS = 10_000


def C() -> "F.Column":
    return F.col("close")


def one():
    return F.count(F.lit(1))


def around(ex: DataFrame) -> DataFrame:
    """Last and next peak and valley (seq, price) seen from every bar, itself included."""
    at = lambda f: F.when(F.col(f), F.struct(F.col("seq").alias("s"), C().alias("p")))
    d = running(ex, {"last_peak": (at("peak"), "last"), "last_valley": (at("valley"), "last")})
    return running(d, {"next_peak": (at("peak"), "last"), "next_valley": (at("valley"), "last")}, reverse=True)


def double_tops(ex: DataFrame, bottom=False) -> DataFrame:
    """Successive peaks within 3% with a valley between (or the mirror image)."""
    side, mid = ("valley", "peak") if bottom else ("peak", "valley")
    d = around(ex).filter(F.col(mid))
    a, b = F.col("last_" + side), F.col("next_" + side)
    diff = F.abs(a.p - b.p) / a.p
    return d.filter(a.isNotNull() & b.isNotNull() & (diff < 0.03)).select("symbol", a.s.alias("start"), F.col("seq").alias("middle"), b.s.alias("end"), (0.85 - diff * 5).alias("confidence"))


def head_shoulders(ex: DataFrame) -> DataFrame:
    """Three successive peaks, the middle one highest, a valley in each gap, shoulders within 5%."""
    d = around(ex).filter("peak").select("symbol", F.col("seq").alias("at"), "close", "last_valley", "next_valley")
    d = number_rows(d, ["at"], F.floor(F.col("at") / 4096))

    def build(h, w):
        side = F.struct("at", "close")
        return h.select("*", F.lag(side).over(w).alias("l"), F.lead(side).over(w).alias("r"))

    d = rolled(d, build, 1, 1)
    l, r = F.col("l"), F.col("r")
    diff = F.abs(l["close"] - r["close"]) / l["close"]
    ok = (F.col("last_valley.s") > l["at"]) & (F.col("next_valley.s") < r["at"]) & (C() > l["close"]) & (C() > r["close"]) & (diff < 0.05)
    return d.filter(ok).select("symbol", l["at"].alias("left"), F.col("at").alias("head"), r["at"].alias("right"), (0.8 - diff * 2).alias("confidence"))


def flags(bars: DataFrame, bearish=False) -> DataFrame:
    """20-bar pole of more than 10% followed by a quiet counter-sloped flag of up to 20 bars."""
    size = bars.groupBy("symbol").agg(one().alias("_n"))
    sign = -1.0 if bearish else 1.0

    def build(h, w):
        f = w.rowsBetween(0, 19)
        pole = div(C() - F.lag(C(), 20).over(w), F.lag(C(), 20).over(w))
        return h.select("*", pole.alias("pole"), (F.stddev_pop(C()).over(f) / F.avg(C()).over(f)).alias("cv"), F.regr_slope(C(), F.col("seq").cast("double")).over(f).alias("slope"), one().over(f).alias("len"))

    d = rolled(bars, build, 20, 20).join(size, "symbol").filter(F.col("seq") < F.col("_n") - 20)
    ok = (sign * F.col("pole") > 0.1) & (F.col("len") >= 10) & (F.col("cv") < 0.03) & (sign * F.col("slope") < 0)
    return d.filter(ok).select("symbol", (F.col("seq") - 20).alias("start"), (F.col("seq") + F.col("len") - 1).alias("end"), (0.7 + F.least(F.abs("pole"), F.lit(0.2))).alias("confidence"), "pole")


def adjusted_strength(p: DataFrame, lengths: DataFrame, points_share: Column) -> DataFrame:
    """Confidence adjusted by the share of key points and the size of the formation."""
    ratio = (F.col("end") - F.col("start")) / F.col("_n")
    s = F.col("confidence") * (0.5 + 0.5 * points_share)
    s = F.when((ratio > 0.05) & (ratio < 0.3), s * 1.1).when((ratio < 0.02) | (ratio > 0.5), s * 0.8).otherwise(s)
    return p.join(lengths, "symbol").withColumn("strength", F.least(s, F.lit(1.0))).drop("_n")


def windows(bars: DataFrame, size: int) -> DataFrame:
    """Every full window of ``size`` closes, by its first row."""
    d = rolled(bars, lambda h, w: h.select("symbol", "seq", "_c", F.collect_list("close").over(w.rowsBetween(0, size - 1)).alias("v")), 0, size)
    return d.filter(F.size("v") == size)


def z(df: DataFrame, column="v", name="z") -> DataFrame:
    d = A.hold(df, _m=A.mean(column))
    d = A.hold(d, _s=A.std(column, F.col("_m")))
    return A.hold(d, **{name: A.znorm(column, F.col("_m"), F.col("_s"), 1e-12)}).drop("_m", "_s")


def search(bars: DataFrame, library: DataFrame, size: int, threshold: float, top: int) -> DataFrame:
    """Best windows for a bounded library of z-scored patterns (pid, z).

    Score = 0.3 correlation + 0.2 euclidean + 0.3 cosine + 0.2 warping, a distance d counting 1 / (1 + d).  On z-scores
    the first three follow from one dot product; the warping distance is only computed, in batches, where the score can
    still reach the threshold.  A library of more rows than ``MOST_PATTERNS`` is refused: split it and search in turn.
    """
    n = library.limit(MOST_PATTERNS + 1).count()
    if n > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns; search them in parts")
    w = z(windows(bars, size)).drop("v")
    m = A.hold(w.crossJoin(F.broadcast(library.select("pid", F.col("z").alias("_p")))), corr=A.dot("z", "_p") / size)
    dist = F.sqrt(F.greatest(2 * size * (1 - F.col("corr")), F.lit(0.0)))
    near = m.withColumn("part", 0.6 * F.col("corr") + 0.2 / (1 + dist)).filter(F.col("part") + 0.2 >= threshold)

    def warp(batches):
        for pdf in batches:
            x, y = (np.stack(pdf[c].to_list()) if len(pdf) else np.zeros((0, size)) for c in ("z", "_p"))
            d = np.concatenate([K.dtw(x[i : i + 512], y[i : i + 512]) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
            yield pd.DataFrame({"symbol": pdf.symbol, "seq": pdf.seq, "pid": pdf.pid, "score": pdf.part + 0.2 / (1 + d)})

    d = near.select("symbol", "seq", "pid", "part", "z", "_p").mapInPandas(warp, "symbol string, seq long, pid long, score double").filter(F.col("score") >= threshold)
    return d.orderBy(F.col("score").desc(), "symbol", "seq", "pid").limit(top)


def weighted_forecast(outcomes: DataFrame, by, levels=(0.68, 0.95)) -> DataFrame:
    """Similarity-weighted mean and weighted quantile interval of matched outcomes (x, weight)."""
    by = list(by)
    total = outcomes.groupBy(*by).agg(F.sum("weight").alias("_t"), (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("mean_forecast"))
    d = number_rows(outcomes, ["x", "id"], F.floor(F.col("x") * 64), by)
    d = running(d, {"_cum": (F.col("weight"), "sum")}, by).join(total, by).withColumn("_q", F.col("_cum") / F.col("_t"))
    edge = lambda p, n: F.min(F.when(F.col("_q") >= p, F.col("x"))).alias(n)
    cols = [e for l in levels for e in (edge((1 - l) / 2, f"lower_{round(l * 100)}"), edge((1 + l) / 2, f"upper_{round(l * 100)}"))]
    return d.groupBy(*by).agg(F.first("mean_forecast").alias("mean_forecast"), *cols)


def shapelets(bars: DataFrame, sizes=(16,), step=1, segments=4, alphabet=4, least=3, ahead=5):
    """(candidates, shapelets): SAX-labelled windows of each of ``sizes`` at every ``step``-th start, and per (symbol, length, word) the one nearest the centroid."""
    both = [_shapelets(bars, n, step, segments, alphabet, least, ahead) for n in sizes]
    return reduce(DataFrame.unionByName, [c for c, _ in both]), reduce(DataFrame.unionByName, [g for _, g in both])


def _shapelets(bars, size, step, segments, alphabet, least, ahead):
    stats = bars.groupBy("symbol").agg(F.avg("close").alias("_mu"), F.stddev_pop("close").alias("_sd"))

    def build(h, w):
        f = w.rowsBetween(0, size - 1)
        return h.select("symbol", "seq", "_c", F.collect_list("close").over(f).alias("raw"), F.lead(C(), size).over(w).alias("_a"), F.lead(C(), size + ahead).over(w).alias("_b"))

    d = rolled(bars, build, 0, size + ahead).filter(F.size("raw") == size)
    d = (d if step == 1 else d.filter(F.col("seq") % step == 0)).join(stats, "symbol")
    d = A.hold(d, v=F.transform("raw", lambda x: (x - F.col("_mu")) / F.col("_sd"))).withColumn("ret", (F.col("_b") - F.col("_a")) / F.col("_a")).drop("raw", "_mu", "_sd", "_a", "_b")
    cand = sax(d, segments, alphabet).withColumn("length", F.lit(size))
    mean = cand.select("symbol", "sax", F.posexplode("v").alias("pos", "x")).groupBy("symbol", "sax", "pos").agg(F.avg("x").alias("m"), one().alias("_k")).filter(F.col("_k") >= least)
    mid = mean.groupBy("symbol", "sax").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_c0"))
    near = A.hold(cand.join(mid, ["symbol", "sax"]), gap=F.sqrt(A.total(F.zip_with("v", "_c0", lambda a, b: (a - b.m) * (a - b.m)))))
    g = near.groupBy("symbol", "length", "sax").agg(one().alias("frequency"), F.min_by("seq", F.struct("gap", "seq")).alias("start"), F.min_by("v", F.struct("gap", "seq")).alias("shape"), F.coalesce(F.avg("ret"), F.lit(0.0)).alias("avg_return"),
                                                    F.coalesce(F.stddev_pop("ret"), F.lit(0.0)).alias("std_return"), F.coalesce(F.avg((F.col("ret") > 0).cast("double")).alias("w"), F.lit(0.5)).alias("win_rate"))
    return cand, g


def match_shapelets(cand: DataFrame, shapes: DataFrame, least=0.9) -> DataFrame:
    """Candidates with a shapelet's length and word and (correlation+1)/2 of at least ``least``."""
    j = cand.join(shapes.select("symbol", "length", "sax", F.col("start").alias("shapelet"), "shape"), ["symbol", "length", "sax"])
    j = A.hold(j, similarity=(A.correlation("v", "shape") + 1) / 2)
    return j.filter(F.col("similarity") >= least).select("symbol", "seq", "length", "sax", "shapelet", "similarity")


def closest_positions(series: DataFrame, shapes: DataFrame) -> DataFrame:
    """Shapelet transform: smallest z-normalised distance of each shapelet to any position of each series."""
    from tapeline.operators.pairs import tiles

    def kernel(a, b):
        out = []
        stacks = {n: (g.id.to_numpy(), np.stack(g.v.to_list()).astype(float)) for n, g in b.groupby(b.v.map(len))}  # shapes by length, one matrix each
        for i, v in zip(a.id, a.v):
            v = np.asarray(v, float)
            for n, (ids, s) in stacks.items():
                if len(v) < n:
                    continue
                d = K.nearest_windows(s, np.lib.stride_tricks.sliding_window_view(v, n))
                out.append(pd.DataFrame({"id": i, "shapelet": ids, "distance": d.min(1), "pos": d.argmin(1)}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "shapelet": [], "distance": [], "pos": []})

    return tiles(series.select("id", "v"), shapes.select("id", "v"), kernel, "id long, shapelet long, distance double, pos int")


def information_gain(dist: DataFrame, labels: DataFrame, owner: Column) -> DataFrame:
    """Best split of each shapelet's distances, its class (``owner``, from the shapelet id) against the rest: threshold and entropy gain."""
    d = number_rows(dist.join(labels, "id").select("shapelet", "id", "distance", (F.col("label") == owner).cast("int").alias("own")), ["distance", "id"], F.floor(F.col("distance") * 16), ["shapelet"])
    d = running(d, {"k": (F.col("own"), "sum")}, ["shapelet"])
    t = d.groupBy("shapelet").agg(one().alias("n"), F.sum("own").alias("total"))
    d = rolled(d, lambda h, w: h.withColumn("_next", F.lead("distance").over(w)), 0, 1, ("shapelet",)).join(t, "shapelet")
    h = lambda k, n: F.coalesce(-(div(k, n) * F.log2(div(k, n)) + (1 - div(k, n)) * F.log2(1 - div(k, n))), F.lit(0.0))
    left = (F.col("seq") + 1).cast("double")
    n, k, tot = F.col("n"), F.col("k"), F.col("total")
    safe = lambda a, b: F.when((a > 0) & (a < b), h(a.cast("double"), b)).otherwise(0.0)
    gain = safe(tot, n) - left / n * safe(k, left) - (n - left) / n * safe(tot - k, n - left)
    d = d.filter(F.col("_next") > F.col("distance")).withColumn("gain", gain)
    return d.groupBy("shapelet").agg(F.max("gain").alias("gain"), F.max_by((F.col("distance") + F.col("_next")) / 2, F.struct("gain", -F.col("seq"))).alias("threshold"))


def matrix_profile(bars: DataFrame, m: int) -> DataFrame:
    """Nearest neighbour of every window of the same symbol outside m/4 rows."""
    from tapeline.operators.profiles import sided_profile

    return sided_profile(bars, m).select("symbol", "seq", "distance", "nn")


def discords(profile: DataFrame, k=3) -> DataFrame:
    """Windows farthest from any other, scored against the mean distance."""
    from tapeline.operators.selection import top_k

    mean = profile.groupBy("symbol").agg(F.avg("distance").alias("_m"))
    d = profile.join(mean, "symbol").select("symbol", "seq", "distance", (F.col("distance") / F.col("_m")).alias("score"))
    return top_k(d, ["symbol"], [F.col("distance").desc(), "seq"], k)


def arc_curve(profile: DataFrame, m: int) -> DataFrame:
    """Share of nearest-neighbour arcs over each position against the expected parabola (low = regime border)."""
    n = profile.groupBy("symbol").agg((F.max("seq") + 1).alias("_n"))
    ends = F.array(F.struct(F.least("seq", "nn").alias("s"), F.lit(1).alias("x")), F.struct(F.greatest("seq", "nn").alias("s"), F.lit(-1).alias("x")))
    d = profile.select("symbol", F.explode(ends).alias("e")).groupBy("symbol", F.col("e.s").alias("seq")).agg(F.sum("e.x").alias("_x"))
    d = running(profile.select("symbol", "seq").join(d, ["symbol", "seq"], "left"), {"arcs": (F.coalesce("_x", F.lit(0)), "sum")}).join(n, "symbol")
    ideal = 2 * F.col("seq") * (F.col("_n") - F.col("seq")) / F.col("_n")
    edge = (F.col("seq") < m) | (F.col("seq") >= F.col("_n") - m)
    return d.select("symbol", "seq", "arcs", F.when(edge, 1.0).otherwise(F.least(F.lit(1.0), div(F.col("arcs"), ideal))).alias("curve"))


def upload_card(series: DataFrame) -> DataFrame:
    """md5 id and summary numbers of an uploaded array."""
    text = F.array_join(F.transform("v", lambda x: F.round(x * 1e6, 0).cast("long").cast("string")), ",")
    return series.select("id", F.md5(text).alias("key"), F.size("v").alias("length"), A.mean("v").alias("mean"), F.array_min("v").alias("min"), F.array_max("v").alias("max"))


def alerts(rules: DataFrame, matches: DataFrame, seconds=3600) -> DataFrame:
    """Matches of enabled rules inside the last ``seconds`` of the table, above the rule's threshold."""
    newest = matches.agg(F.max("ts").alias("_z"))
    fresh = matches.crossJoin(F.broadcast(newest)).filter(F.unix_timestamp("ts") > F.unix_timestamp("_z") - seconds)
    return fresh.join(F.broadcast(rules.filter("enabled")), "kind").filter(F.col("score") >= F.col("threshold")).drop("_z")

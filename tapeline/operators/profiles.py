"""Matrix profiles, of one series or several at once, and what is read off them: motifs, chains and regime borders.

A series travels as raw slices: the values of ``BLOCK`` window starts and of the rows that their windows need. Each pair of slices is one task, which
keeps the best neighbours of its windows, so neither windows nor pairs of them are shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import kernels as K
from tapeline.functions.frames import cell
from tapeline.functions.lineage import store
from tapeline.operators.selection import top_k

BLOCK = 1024


def slices(bars: DataFrame, m: int, columns=("close",), block: int = BLOCK) -> DataFrame:
    """(symbol, b, first, last_b, one array per column): the rows of the windows of ``m`` that start in block ``b``; ``seq`` has to be dense."""
    lo, hi = F.greatest(F.lit(0), F.floor((F.col("seq") - (m - 1)) / block)), F.floor(F.col("seq") / block)
    rows = bars.select("symbol", "seq", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).withColumn("b", F.explode(F.sequence(lo, hi)))
    g = rows.groupBy("symbol", "b").agg(F.array_sort(F.collect_list(F.struct("seq", *[f"v{i}" for i in range(len(columns))]))).alias("r")).filter(F.size("r") >= m)
    g = g.select("symbol", "b", F.col("r")[0].seq.alias("first"), *[F.col(f"r.v{i}").alias(f"v{i}") for i in range(len(columns))])
    last = F.floor((F.max("seq") - (m - 1)) / block)
    last = bars.groupBy("symbol").agg(last.alias("last_b")).filter("last_b >= 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_b"))))
    keys = last.select(cell(["symbol"], F.col("b")).alias("_k"), "last_b")
    return g.withColumn("_k", cell(["symbol"], F.col("b"))).join(keys, "_k").drop("_k")


def _views(row, m: int, n: int):
    """Start rows and the windows of each column of a slice."""
    views = [np.lib.stride_tricks.sliding_window_view(np.asarray(row[f"v{i}"], float), m) for i in range(n)]
    return int(row["first"]) + np.arange(len(views[0])), views


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """z-normalised distances of windows; those with a missing value are near nothing."""
    d = K.nearest_windows(a, b)
    d[np.isnan(a).any(1)] = np.inf
    d[:, np.isnan(b).any(1)] = np.inf
    return d


def _tiles(bars, m, columns, kernel, schema, block):
    """Every pair of slices of a symbol through ``kernel(starts, windows, starts, windows)``."""
    s = slices(bars, m, columns, block)
    other = F.sequence(F.lit(0).cast("long"), F.col("last_b"))
    pair = F.transform(other, lambda o: F.struct(F.least(o, F.col("b")).alias("p"), F.greatest(o, F.col("b")).alias("q")))
    t = s.withColumn("_t", F.explode(pair)).select("symbol", "b", "first", *[f"v{i}" for i in range(len(columns))], "_t.p", "_t.q")
    kind = bars.schema["symbol"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.b == pdf.p].iloc[0], pdf[pdf.b == pdf.q].iloc[0]
        out = kernel(*_views(left, m, len(columns)), *_views(right, m, len(columns)))
        out.insert(0, "symbol", pdf.symbol.iloc[0])
        return out

    # little data, much work: an explicit count keeps adaptive execution from merging the tasks
    tasks = max(64, int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return t.repartition(tasks, "symbol", "p", "q").groupBy("symbol", "p", "q").applyInPandas(run, f"symbol {kind}, {schema}")


def sided_profile(bars: DataFrame, m: int, block: int = BLOCK) -> DataFrame:
    """(symbol, seq, distance, nn, left_distance, left_nn, right_distance, right_nn) of every window of ``m`` closes.

    Nearest windows of the same symbol by z-normalised distance, more than m/4 rows away: of all, of the earlier and of the later ones. A flat window
    counts as zeros; windows with a NULL have no neighbours.
    """
    zone = math.ceil(m / 4)

    def kernel(ls, lv, rs, rv):
        d = _distances(lv[0], rv[0])
        d[rs[None, :] - ls[:, None] <= zone] = np.inf
        i, j = d.argmin(1), d.argmin(0)
        out = pd.DataFrame({"seq": np.r_[ls, rs], "later": np.r_[np.ones(len(ls), bool), np.zeros(len(rs), bool)], "distance": np.r_[d.min(1), d.min(0)], "nn": np.r_[rs[i], ls[j]]})
        return out[np.isfinite(out.distance)]

    t = _tiles(bars, m, ["close"], kernel, "seq long, later boolean, distance double, nn long", block)
    best = F.struct("distance", "nn")
    g = t.groupBy("symbol", "seq").agg(F.min(F.when(~F.col("later"), best)).alias("l"), F.min(F.when(F.col("later"), best)).alias("r")).withColumn("n", F.least("l", "r"))
    return g.select("symbol", "seq", "n.distance", "n.nn", F.col("l.distance").alias("left_distance"), F.col("l.nn").alias("left_nn"), F.col("r.distance").alias("right_distance"), F.col("r.nn").alias("right_nn"))


def multi_profile(bars: DataFrame, m: int, columns, block: int = BLOCK) -> DataFrame:
    """(symbol, seq, k, distance, nn, dims): the profile of several series at once, for k = 1 to all of them.

    The distance of two windows for ``k`` is the mean of their ``k`` smallest distances over the columns; ``dims`` are the columns that give them.
    """
    zone, columns = math.ceil(m / 4), list(columns)

    def kernel(ls, lv, rs, rv):
        d = np.stack([_distances(a, b) for a, b in zip(lv, rv, strict=True)])
        d[:, np.abs(ls[:, None] - rs[None, :]) <= zone] = np.inf
        mean = np.cumsum(np.sort(d, axis=0), axis=0)
        parts = []
        for k in range(1, len(columns) + 1):
            at = mean[k - 1] / k
            i, j = at.argmin(1), at.argmin(0)
            own = np.concatenate((d[:, np.arange(len(ls)), i], d[:, j, np.arange(len(rs))]), axis=1)
            order = np.sort(np.argsort(own, axis=0, kind="stable")[:k], axis=0)
            part = pd.DataFrame({"seq": np.r_[ls, rs], "k": k, "distance": np.r_[at.min(1), at.min(0)], "nn": np.r_[rs[i], ls[j]], "dims": [",".join(columns[c] for c in o) for o in order.T]})
            parts.append(part[np.isfinite(part.distance)])
        return pd.concat(parts)

    t = _tiles(bars, m, columns, kernel, "seq long, k int, distance double, nn long, dims string", block)
    g = t.groupBy("symbol", "seq", "k").agg(F.min(F.struct("distance", "nn", "dims")).alias("n"))
    return g.select("symbol", "seq", "k", "n.*")


def apart(df: DataFrame, by, order, k: int, zone: int) -> DataFrame:
    """The first ``k`` rows per group in ``order`` (last key: ``seq``) of which no two are within ``zone`` rows; adds ``rank`` from 0.

    A pick takes at most 2 * zone others out, so all picks are among the first k * (2 * zone + 1) rows, and the serial choice runs on these alone.
    """
    pool = top_k(df, by, order, k * (2 * zone + 1), rank="_place")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        picked = []
        for i, s in enumerate(pdf.seq.to_numpy()):
            if len(picked) < k and all(abs(s - x) > zone for _, x in picked):
                picked.append((i, s))
        out = pdf.iloc[[i for i, _ in picked]].drop(columns="_place")
        return out.assign(rank=np.arange(len(out), dtype=np.int32))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return pool.groupBy(*by).applyInPandas(choose, f"{shape}, rank int")


def motifs(bars: DataFrame, profile: DataFrame, m: int, top: int = 10, most: int = 10, sigmas: float = 2.0, cutoff: float | None = None, block: int = BLOCK) -> DataFrame:
    """(symbol, motif, primary, rank, seq, distance, raw): up to ``top`` motifs of each symbol with up to ``most`` occurrences.

    A motif starts from the window of least ``profile`` distance; its occurrences are the nearest windows within ``sigmas`` standard deviations of the
    profile, itself first (rank 0), more than m/4 rows from each other; then the rows around them leave the profile. ``distance`` is between z-normalised windows,
    ``raw`` between the values. Windows above ``cutoff`` (``top`` if not given) start no motif. One round per motif, all symbols at once; a round reads each
    slice once and passes on a bounded number of rows per slice. Runs jobs when the frame is built.
    """
    zone = math.ceil(m / 4)
    pool = most * (2 * zone + 1)
    parts = store(slices(bars, m, block=block))
    key = cell(["symbol"], F.col("b")).alias("_k")
    limits = store(profile.groupBy(F.struct("symbol").alias("_s")).agg((sigmas * F.stddev_pop("distance")).alias("limit")), 1)  # one row for each symbol
    left = store(profile.select("symbol", "seq", "distance"))
    kind = bars.schema["symbol"].dataType.simpleString()

    def nearest(batches):
        for pdf in batches:
            out = [pd.DataFrame({"symbol": [], "primary": [], "seq": [], "distance": [], "raw": []})]
            for row in pdf.itertuples(index=False):
                starts, (view,) = _views(row._asdict(), m, 1)
                d = _distances(np.asarray(row.v, float)[None, :], view)[0]
                d[starts == row.primary] = 0.0
                near = np.flatnonzero(d <= row.limit)
                near = near[np.lexsort((starts[near], d[near]))[:pool]]
                out.append(pd.DataFrame({"symbol": row.symbol, "primary": row.primary, "seq": starts[near], "distance": d[near], "raw": np.sqrt(((view[near] - row.v) ** 2).sum(1))}))
            yield pd.concat(out[1:]) if len(out) > 1 else out[0]

    found = None
    for k in range(top):
        first = left.groupBy("symbol").agg(F.min(F.struct("distance", "seq")).alias("c")).select("symbol", F.struct("symbol").alias("_s"), F.col("c.distance").alias("d"), F.col("c.seq").alias("primary"))
        start = first.join(limits, "_s").filter(F.col("d") <= F.least(F.col("limit"), F.lit(float(top if cutoff is None else cutoff))))
        own = start.withColumn("b", F.floor(F.col("primary") / block)).select(key, "primary", "limit").join(parts.select(key, "symbol", "first", "last_b", "v0"), "_k")
        own = own.select("symbol", "primary", "limit", F.slice("v0", (F.col("primary") - F.col("first") + 1).cast("int"), m).alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_b"))).alias("b"))
        rows = own.select(key, "primary", "limit", "v").join(parts.select(key, "symbol", "first", "v0"), "_k").drop("_k")
        close = rows.mapInPandas(nearest, f"symbol {kind}, primary long, seq long, distance double, raw double")
        part = store(apart(close, ["symbol", "primary"], ["distance", "seq"], most, zone).withColumn("motif", F.lit(k)), 1)
        if part.isEmpty():
            break
        found = part if found is None else found.unionByName(part)
        gone = part.select("symbol", F.explode(F.sequence(F.col("seq") - zone, F.col("seq") + zone)).alias("seq")).select(F.struct("symbol", "seq").alias("_w")).distinct()
        left = store(left.withColumn("_w", F.struct("symbol", "seq")).join(gone, "_w", "left_anti").drop("_w"))
    columns = ["symbol", "motif", "primary", "rank", "seq", "distance", "raw"]
    if found is None:
        found = profile.limit(0).select("symbol", F.lit(0).alias("motif"), F.col("seq").alias("primary"), F.lit(0).alias("rank"), "seq", "distance", F.col("distance").alias("raw"))
    return found.select(*columns)


def motif_summary(occurrences: DataFrame) -> DataFrame:
    """Occurrences, mean and deviation of the raw distances to the primary window per motif."""
    others = F.when(F.col("rank") > 0, F.col("raw"))
    return occurrences.groupBy("symbol", "motif", "primary").agg(F.count("*").alias("occurrences"), F.coalesce(F.avg(others), F.lit(0.0)).alias("mean_distance"), F.coalesce(F.stddev_pop(others), F.lit(0.0)).alias("std_distance"))


def chain_members(profile: DataFrame) -> DataFrame:
    """(symbol, start, pos, seq): maximal chains of windows, each the nearest later window of the one before and that one its nearest earlier window.

    Links are mutual, so every window has at most one on each side and chains are disjoint paths. Each window finds the start of its chain by pointer
    doubling: log2 of the longest chain rounds, each a join on (symbol, seq). Runs jobs when the frame is built.
    """
    at = lambda c: F.struct(F.col("symbol"), F.col(c).alias("seq"))
    right = profile.filter("right_nn IS NOT NULL").select(at("right_nn").alias("_w"), F.col("seq").alias("before"))
    links = store(profile.select(at("seq").alias("_w"), "symbol", "seq", "left_nn").join(right, "_w").filter(F.col("before") == F.col("left_nn")).select("symbol", "seq", "before"))
    ends = links.select("symbol", F.explode(F.array("seq", "before")).alias("seq")).distinct()
    hop = ends.select(at("seq").alias("_w"), "symbol", "seq").join(links.select(at("seq").alias("_w"), "before"), "_w", "left")
    hop = store(hop.select("symbol", "seq", F.coalesce("before", "seq").alias("to"), F.col("before").isNotNull().cast("long").alias("pos")))
    while True:
        far = hop.select(at("seq").alias("_w"), F.col("to").alias("beyond"), F.col("pos").alias("more"))
        step = store(hop.select(at("to").alias("_w"), "symbol", "seq", "to", "pos").join(far, "_w").select("symbol", "seq", "to", "beyond", "pos", "more"))
        hop = step.select("symbol", "seq", F.col("beyond").alias("to"), (F.col("pos") + F.col("more")).alias("pos"))
        if step.filter("to <> beyond").isEmpty():
            return hop.select("symbol", F.col("to").alias("start"), "pos", "seq")


def chains(bars: DataFrame, profile: DataFrame, m: int) -> DataFrame:
    """(symbol, start, stop, length, mean_transition, std_transition, total_evolution, unanchored) of each chain.

    Transitions are distances between the values of neighbouring windows, the evolution that of the first and the last; the longest chain of a symbol (of several,
    the first) is the unanchored one.
    """
    from tapeline.operators.detection import windows

    members = store(chain_members(profile))
    views = members.join(windows(bars, m).select(F.struct("symbol", "seq").alias("_w"), "v"), F.struct(members.symbol, members.seq) == F.col("_w")).drop("_w")
    views = store(views)
    size = members.groupBy("symbol", "start").agg(F.count("*").alias("length"))
    here = lambda pos, name: views.select(F.struct("symbol", "start", pos.alias("pos")).alias("_p"), F.col("v").alias(name))
    gap = F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    steps = here(F.col("pos"), "a").join(here(F.col("pos") - 1, "b"), "_p").select("_p.symbol", "_p.start", gap.alias("d"))
    steps = steps.groupBy("symbol", "start").agg(F.avg("d").alias("mean_transition"), F.stddev_pop("d").alias("std_transition"))
    key = F.struct("symbol", "start").alias("_c")
    ends = views.join(size.select(key, "length"), F.struct(views.symbol, views.start) == F.col("_c")).filter("pos = 0 OR pos = length - 1")
    ends = ends.groupBy("symbol", "start").agg(F.max("length").alias("length"), F.max_by("seq", "pos").alias("stop"), F.min_by("v", "pos").alias("a"), F.max_by("v", "pos").alias("b"))
    whole = ends.select(key, "symbol", "start", "stop", "length", gap.alias("total_evolution")).join(steps.select(key, "mean_transition", "std_transition"), "_c").drop("_c")
    longest = whole.groupBy("symbol").agg(F.max(F.struct("length", (-F.col("start")).alias("o"))).alias("z")).select(F.struct("symbol", (-F.col("z.o")).alias("start")).alias("_c"), F.lit(True).alias("unanchored"))
    marked = whole.withColumn("_c", key).join(longest, "_c", "left")
    return marked.select("symbol", "start", "stop", "length", "mean_transition", "std_transition", "total_evolution", F.coalesce("unanchored", F.lit(False)).alias("unanchored"))


def borders(curve: DataFrame, m: int, regimes: int = 5, factor: int = 5) -> DataFrame:
    """(symbol, rank, seq, curve): the ``regimes`` - 1 lowest places of an arc curve, at least ``factor`` half windows apart, below 1."""
    return apart(curve.filter("curve < 1").select("symbol", "seq", "curve"), ["symbol"], ["curve", "seq"], regimes - 1, (m // 2) * factor).select("symbol", "rank", "seq", "curve")


def regimes(curve: DataFrame, edges: DataFrame) -> DataFrame:
    """(symbol, seq, regime): the number of borders at or before each row. Few borders per symbol; rows meet them by chunk."""
    from tapeline.functions.frames import running

    at = edges.select(F.struct("symbol", "seq").alias("_w"), F.lit(1).alias("_one"))
    d = curve.select("symbol", "seq").withColumn("_w", F.struct("symbol", "seq")).join(at, "_w", "left").drop("_w")
    return running(d, {"regime": (F.coalesce("_one", F.lit(0)), "sum")}).select("symbol", "seq", F.col("regime").cast("long").alias("regime"))

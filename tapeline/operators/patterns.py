"""Pattern detection on price windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_members(bars: DataFrame, size: int, step: int) -> DataFrame:
    """One row per bar and window of ``size`` rows that starts every ``step`` rows."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    lo = F.greatest(F.lit(0), F.floor((F.col("seq") - size) / step) + 1)
    starts = F.transform(F.sequence(lo, F.floor(F.col("seq") / step)), lambda k: k * step)
    m = bars.withColumn("start_seq", F.explode(starts)).join(n, "symbol").filter(F.col("start_seq") < F.col("_n") - size)
    return m.withColumn("pos", (F.col("seq") - F.col("start_seq")).cast("int")).drop("_n")


def window_patterns(bars: DataFrame, size=50, step=25, trend=0.001) -> DataFrame:
    """Classify windows as trend, reversal or consolidation.

    Windows hold at most ``size`` rows, so each group is bounded.
    """
    price, pos, half = F.col("close"), F.col("pos"), size // 2
    arr = F.array_sort(F.collect_list(F.struct("pos", "close")))
    x = window_members(bars, size, step).groupBy("symbol", "start_seq").agg(
        F.min_by("ts", "pos").alias("ts"), F.min_by(price, pos).alias("price_start"), F.max_by(price, pos).alias("price_end"),
        (F.stddev_pop(price) / F.avg(price)).alias("volatility"), ((F.max(price) - F.min(price)) / F.avg(price)).alias("price_range"),
        (F.regr_slope(price, pos) / F.avg(price)).alias("_t"), F.regr_r2(price, pos).alias("strength"),
        F.regr_slope(F.when(pos < half, price), pos).alias("_h1"), F.regr_slope(F.when(pos >= half, price), pos).alias("_h2"),
        F.max_by(pos, F.struct(price, -pos)).alias("_top"), F.min_by(pos, F.struct(price, pos)).alias("_bot"), arr.alias("_a"))
    slope = lambda lo, hi: _slope(F.filter("_a", lambda r: (r.pos >= lo) & (r.pos < hi)))
    zero, end = F.lit(0), F.lit(size)
    top, bot = F.col("_top"), F.col("_bot")
    mid = lambda c: (c > 0.3 * size) & (c < 0.7 * size)
    is_top = mid(top) & (slope(zero, top) > 0) & (slope(top, end) < 0)
    is_bottom = mid(bot) & (slope(zero, bot) < 0) & (slope(bot, end) > 0)
    t, h1, h2 = F.col("_t"), F.col("_h1"), F.col("_h2")
    kind = (F.when((F.abs(t) < trend * 0.5) & (F.col("volatility") < 0.02), "consolidation")
            .when(t > trend, F.when(is_top, "reversal_top").otherwise("trend_up"))
            .when(t < -trend, F.when(is_bottom, "reversal_bottom").otherwise("trend_down"))
            .when((h1 > 0) & (h2 < 0), "reversal_top").when((h1 < 0) & (h2 > 0), "reversal_bottom"))
    x = x.withColumn("type", kind).filter("type IS NOT NULL")
    return x.select("symbol", "start_seq", (F.col("start_seq") + size).alias("end_seq"), "ts", "strength",
                    ((F.col("price_end") - F.col("price_start")) / F.col("price_start")).alias("price_change"), "price_start", "price_end",
                    "volatility", "price_range", F.abs(t).alias("trend_strength"), "type")


def _slope(points):
    """Least-squares slope of an array of (pos, close) structs."""
    n = F.size(points)
    fold = lambda f: F.aggregate(points, F.lit(0.0), lambda a, r: a + f(r))
    sx, sy = fold(lambda r: r.pos), fold(lambda r: r.close)
    sxy, sxx = fold(lambda r: r.pos * r.close), fold(lambda r: r.pos * r.pos)
    return F.try_divide(n * sxy - sx * sy, n * sxx - sx * sx)

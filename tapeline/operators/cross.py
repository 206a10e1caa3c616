"""Cross-wavelet coherence of two series and the joint feature table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.frames import rolled, running

RADIUS = 4


def gauss(sigma: float = 1.0) -> np.ndarray:
    """Normalised weights on -RADIUS..RADIUS."""
    w = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / sigma) ** 2)
    return w / w.sum()


def mirrored(i: int, n: int) -> int:
    """Index of a position outside 0..n-1 when the ends are mirrored."""
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def scale_weights(n: int) -> np.ndarray:
    """Smoothing over the scale axis as a matrix (target, source)."""
    m = np.zeros((n, n))
    for t in range(n):
        for k, w in zip(range(-RADIUS, RADIUS + 1), gauss()):
            m[t, mirrored(t + k, n)] += w
    return m


def coherence(first: DataFrame, second: DataFrame, scales) -> DataFrame:
    """(pair, seq, scale, cross, power, coherence, phase) of coefficient tables (pair, seq, scale, coef) that share pairs and positions.

    Cross and own powers are smoothed by a Gaussian over neighbouring scales (a fixed small matrix) and positions (a short frame, mirrored at the ends).
    The wavelet is real, so the phase is 0 or pi.
    """
    scales = sorted(scales)
    a, b = F.col("coef"), F.col("other")
    both = first.join(second.withColumnRenamed("coef", "other"), ["pair", "seq", "scale"])
    d = both.select("pair", "seq", F.expr(f"array_position(array({', '.join(f'{s}D' for s in scales)}), scale) - 1").cast("int").alias("s"), (a * b).alias("cross"), F.abs(a * b).alias("xy"), (a * a).alias("xx"), (b * b).alias("yy"))
    m = scale_weights(len(scales))
    spread = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(m[t, s])).alias("w")) for t in range(len(scales))]) for s in range(len(scales))])
    names = ("xy", "xx", "yy")
    wide = d.select("pair", "seq", "s", *names, F.explode(F.get(spread, F.col("s"))).alias("k"))
    over = wide.groupBy("pair", F.col("k.t").alias("s"), "seq").agg(*[F.sum(F.col(n) * F.col("k.w")).alias(n) for n in names])
    n = over.groupBy("pair").agg((F.max("seq") + 1).alias("n"))
    at = F.col("seq")
    low, high = F.when(at < RADIUS, -1 - at), F.when(at >= F.col("n") - RADIUS, 2 * F.col("n") - 1 - at)
    padded = over.join(n, "pair").withColumn("seq", F.explode(F.array_compact(F.array(at, low, high)))).withColumn("seq", F.col("seq") + RADIUS).drop("n")
    w = gauss()

    def build(h, win):
        def smooth(x):
            terms = [F.lag(x, -k).over(win) * float(g) if k < 0 else F.lead(x, k).over(win) * float(g) if k else F.col(x) * float(g) for k, g in zip(range(-RADIUS, RADIUS + 1), w)]
            return sum(terms[1:], terms[0])

        return h.withColumns({f"_{x}": smooth(x) for x in names})

    smooth = rolled(padded, build, RADIUS, RADIUS, by=("pair", "s")).withColumn("seq", F.col("seq") - RADIUS).filter(F.col("_xy").isNotNull())
    scale = F.get(F.array(*[F.lit(float(x)) for x in scales]), F.col("s"))
    out = smooth.select("pair", "seq", "s", "_xy", "_xx", "_yy").join(d.select("pair", "seq", "s", "cross"), ["pair", "seq", "s"])
    return out.select("pair", "seq", scale.alias("scale"), "cross", (F.col("cross") * F.col("cross")).alias("power"), (F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))).alias("coherence"), F.when(F.col("cross") < 0, float(np.pi)).otherwise(0.0).alias("phase"))


PATTERN_COLUMNS = ["pattern_strength", "pattern_change", "bars_since_pattern", "chance_up", "transition_entropy"]


def chain_summary(chain: DataFrame, up: str = "trend_up") -> DataFrame:
    """(type, chance_up, transition_entropy) from transition rows (from, to, p); as many rows as there are types."""
    p = F.col("p")
    return chain.groupBy(F.col("from").alias("type")).agg(F.coalesce(F.sum(F.when(F.col("to") == up, p)), F.lit(0.0)).alias("chance_up"), (-F.sum(p * F.ln(p))).alias("transition_entropy"))


def with_patterns(features: DataFrame, patterns: DataFrame, chain: DataFrame) -> DataFrame:
    """Adds to every bar the newest pattern that has ended (symbol, end_seq, type, strength, price_change) and the outlook of its type."""
    mark = F.struct("type", "strength", "price_change", F.col("end_seq").alias("at"))
    marks = patterns.select("symbol", F.col("end_seq").alias("seq"), mark.alias("_mark"))
    d = running(features.join(marks, ["symbol", "seq"], "left"), {"_last": (F.col("_mark"), "last")}).drop("_mark")
    d = d.select("*", F.col("_last.type").alias("type"), F.col("_last.strength").alias("pattern_strength"), F.col("_last.price_change").alias("pattern_change"), (F.col("seq") - F.col("_last.at")).cast("double").alias("bars_since_pattern"))
    return d.join(F.broadcast(chain_summary(chain)), "type", "left").drop("_last", "type")


def imputed_scaled(features: DataFrame, columns) -> DataFrame:
    """NULLs become the mean of their symbol (0 if it has none), then every column is scaled to mean 0 and deviation 1.

    Two aggregations: one row per symbol, and from the filled columns one row in all.
    """
    means = features.groupBy("symbol").agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    filled = features.join(means, "symbol").select("symbol", "seq", *[F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"), F.lit(0.0)).alias(c) for c in columns])
    stats = filled.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns])
    return filled.crossJoin(F.broadcast(stats)).select("symbol", "seq", *[((F.col(c) - F.col(f"_{c}.m")) / F.when(F.col(f"_{c}.s") > 0, F.col(f"_{c}.s")).otherwise(1.0)).alias(c) for c in columns])

"""Continuous wavelet transform over chunked series and its summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import frames
from tapeline.functions import kernels as K
from tapeline.functions.frames import halo, rolled


def transform(bars: DataFrame, scales, column="close") -> DataFrame:
    """Long table (symbol, seq, scale, coef) of the z-scored column.

    The series is cut into chunks with a halo as wide as the largest wavelet,
    so each chunk is an independent task and edges see the true neighbours.
    """
    stats = bars.groupBy("symbol").agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = bars.join(stats, "symbol").select("symbol", "seq", F.coalesce(F.try_divide(F.col(column) - F.col("_m"), "_s"), F.lit(0.0)).alias("z"))
    reach, chunk = math.ceil(8 * max(scales)), frames.CHUNK
    waves = [(float(s), K.morlet(s)) for s in scales]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        seq, x = pdf.seq.to_numpy(), pdf.z.to_numpy()
        home = seq // chunk == pdf["_c"].iloc[0]
        parts = []
        for s, psi in waves:
            pad = len(psi) // 2
            c = np.convolve(np.pad(x, pad), psi[::-1], "valid")
            parts.append(pd.DataFrame({"symbol": pdf.symbol.to_numpy()[home], "seq": seq[home], "scale": s, "coef": c[home]}))
        return pd.concat(parts)

    kind = bars.schema["symbol"].dataType.simpleString()
    return halo(z, reach, reach).groupBy("symbol", "_c").applyInPandas(run, f"symbol {kind}, seq long, scale double, coef double")


def scale_summary(cwt: DataFrame) -> DataFrame:
    """Energy, maximum, mean and deviation per scale."""
    m = F.abs("coef")
    return cwt.groupBy("symbol", "scale").agg(F.sum(F.col("coef") * F.col("coef")).alias("energy"), F.max(m).alias("max"), F.avg(m).alias("mean"), F.stddev_pop("coef").alias("std"))


def time_summary(cwt: DataFrame) -> DataFrame:
    """Dominant scale, energy, entropy and active scales at every time."""
    m = F.abs("coef")
    g = cwt.groupBy("symbol", "seq").agg(F.sum(m * m).alias("energy"), F.max(m).alias("max_magnitude"), F.avg(m).alias("mean_magnitude"), F.max_by("scale", m).alias("dominant_scale"),
                                         (-F.sum(m * F.ln(m + 1e-10))).alias("entropy"))
    a = cwt.join(g.select("symbol", "seq", "mean_magnitude"), ["symbol", "seq"]).groupBy("symbol", "seq").agg(F.count_if(m > F.col("mean_magnitude")).alias("active_scales"))
    return g.join(a, ["symbol", "seq"])


def ridge_points(cwt: DataFrame, scales, threshold=0.1) -> DataFrame:
    """Local maxima in time and scale above a share of the symbol's largest magnitude."""
    top = cwt.groupBy("symbol").agg(F.max(F.abs("coef")).alias("_top"))
    idx = F.array_position(F.array(*[F.lit(float(s)) for s in scales]), F.col("scale")).cast("int") - 1
    # one row for each symbol: joined as its size allows
    d = cwt.join(top, "symbol").select("symbol", "seq", idx.alias("s"), "scale", (F.abs("coef") / F.col("_top")).alias("m"))
    d = rolled(d, lambda h, w: h.select("*", F.lag("m").over(w).alias("l"), F.lead("m").over(w).alias("r")), 1, 1, ("symbol", "s"))
    near = d.select("symbol", "seq", "s", "m")
    up, down = near.select("symbol", "seq", (F.col("s") - 1).alias("s"), F.col("m").alias("u")), near.select("symbol", "seq", (F.col("s") + 1).alias("s"), F.col("m").alias("d"))
    j = d.filter(F.col("m") > threshold).join(up, ["symbol", "seq", "s"]).join(down, ["symbol", "seq", "s"])
    m = F.col("m")
    return j.filter((m > F.col("l")) & (m > F.col("r")) & (m > F.col("u")) & (m > F.col("d"))).select("symbol", "seq", "scale", m.alias("magnitude"))


def coefficient_patterns(cwt: DataFrame, least=0.01) -> DataFrame:
    """Half-overlapping windows of min(max(2s,5),50) coefficients with enough deviation."""
    n = F.least(F.greatest(F.floor(2 * F.col("scale")), F.lit(5)), F.lit(50))
    last = cwt.groupBy("symbol").agg(F.max("seq").alias("_z"))
    d = cwt.join(last, "symbol").withColumn("_n", n).withColumn("_st", F.floor(F.col("_n") / 2))
    lo = F.greatest(F.lit(0), F.ceil((F.col("seq") - F.col("_n") + 1) / F.col("_st")))
    d = d.withColumn("start", F.explode(F.transform(F.sequence(lo, F.floor(F.col("seq") / F.col("_st"))), lambda k: k * F.col("_st")))).filter(F.col("start") + F.col("_n") <= F.col("_z") + 1)
    g = d.groupBy("symbol", "scale", "start").agg(F.first("_n").alias("length"), F.stddev_pop("coef").alias("std"), F.sum(F.col("coef") * F.col("coef")).alias("energy"))
    return g.filter(F.col("std") > least)

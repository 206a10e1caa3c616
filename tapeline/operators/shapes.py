"""Statistics of single arrays and of array pairs, as row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import arrays as A
from tapeline.functions.frames import div


def statistics(series: DataFrame) -> DataFrame:
    """Moments, quantiles, slope, extrema counts and difference moments of ``v``."""
    d = A.hold(series, mean=A.mean("v"), _d=A.diffs("v"))
    m = F.col("mean")
    d = A.hold(d, _m2=A.moment("v", m, 2), mean_diff=A.mean("_d"))
    return d.select(
        *[c for c in series.columns if c != "v"], "mean", F.sqrt("_m2").alias("std"), F.array_min("v").alias("min"), F.array_max("v").alias("max"),
        div(A.moment("v", m, 3), F.pow("_m2", F.lit(1.5))).alias("skew"), (div(A.moment("v", m, 4), F.col("_m2") * F.col("_m2")) - 3).alias("kurt"),
        A.quantile("v", 0.25).alias("q25"), A.quantile("v", 0.75).alias("q75"), A.quantile("v", 0.5).alias("median"), A.slope("v").alias("slope"),
        F.size(A.peaks("v")).alias("peaks"), F.size(A.valleys("v")).alias("valleys"), "mean_diff", A.std("_d", F.col("mean_diff")).alias("std_diff"),
        (A.count_where("_d", lambda x: x > 0) / F.size("_d")).alias("up_share"), A.total("_d", F.abs).alias("variation"))


def ranks(v) -> Column:
    """Average ranks of the items of an array."""
    return F.transform(v, lambda x: A.count_where(v, lambda y: y < x) + (A.count_where(v, lambda y: y == x) + 1) / 2.0)


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Distribution, rank, error, shift and trend comparison of arrays ``x`` and ``y`` (cut to equal length)."""
    keep = [c for c in pairs.columns if c not in ("x", "y")]
    d = A.hold(pairs.withColumnsRenamed({"x": "_x0", "y": "_y0"}), x=F.slice("_x0", F.lit(1), F.least(F.size("_x0"), F.size("_y0"))), y=F.slice("_y0", F.lit(1), F.least(F.size("_x0"), F.size("_y0"))))
    d = A.hold(d, _n=F.size("x"), _mx=A.mean("x"), _my=A.mean("y"), _e=F.zip_with("x", "y", lambda a, b: a - b), _dx=A.diffs("x"), _dy=A.diffs("y"), _rx=ranks("x"), _ry=ranks("y"))
    n = F.col("_n")
    sx, sy = A.std("x", F.col("_mx")), A.std("y", F.col("_my"))
    cdf = lambda v, t: A.count_where(v, lambda u: u <= t) / n
    ks = F.array_max(F.transform(F.concat("x", "y"), lambda t: F.abs(cdf("x", t) - cdf("y", t))))
    idx = F.sequence(F.lit(0), n - 1)
    sign = lambda v, i, j: F.signum(F.get(v, i) - F.get(v, j))
    pairs_of = lambda i: F.sequence(F.lit(0), i - 1)
    tau_num = F.aggregate(F.slice(idx, F.lit(2), n - 1), F.lit(0.0), lambda a, i: a + F.aggregate(pairs_of(i), F.lit(0.0), lambda b, j: b + sign("x", i, j) * sign("y", i, j)))
    half = F.floor(n / 2).cast("int")
    # lag k pairs x[t + k] with y[t]; 'same' mode keeps n lags starting at -floor(n/2)
    lag_dot = lambda k: F.aggregate(idx, F.lit(0.0), lambda a, t: a + F.coalesce(F.when((t + k >= 0) & (t + k < n), F.get("x", t + k) * F.get("y", t)), F.lit(0.0)))
    cc = F.transform(idx, lambda i: lag_dot(i - half))
    d = A.hold(d, _cc=cc)
    agree = F.aggregate(F.zip_with("_dx", "_dy", lambda a, b: (F.signum(a) == F.signum(b)).cast("int")), F.lit(0), lambda s, v: s + v)
    return d.select(
        *keep, (F.col("_mx") - F.col("_my")).alias("mean_difference"), (sx - sy).alias("std_difference"), (A.quantile("x", 0.5) - A.quantile("y", 0.5)).alias("median_difference"), ks.alias("ks"),
        A.correlation("x", "y").alias("pearson"), A.correlation("_rx", "_ry").alias("spearman"), (tau_num / (n * (n - 1) / 2)).alias("kendall"), F.sqrt(A.total("_e", lambda e: e * e) / n).alias("rmse"),
        (A.total("_e", F.abs) / n).alias("mae"), F.array_max(F.transform("_e", F.abs)).alias("max_difference"), F.array_max("_cc").alias("cross_correlation"),
        (F.array_position("_cc", F.array_max("_cc")).cast("int") - 1 - half).alias("phase_shift"), (agree / F.size("_dx")).alias("trend_agreement"), div(sx, sy).alias("volatility_ratio"))


def difference_highlight(pairs: DataFrame) -> DataFrame:
    """Largest aligned difference of ``x`` from reference ``y`` and its position."""
    n = F.least(F.size("x"), F.size("y"))
    d = A.hold(pairs, _a=F.zip_with(F.slice("x", F.lit(1), n), F.slice("y", F.lit(1), n), lambda a, b: F.abs(a - b)))
    return d.select(*[c for c in pairs.columns if c not in ("x", "y")], F.array_max("_a").alias("max_value"), (F.array_position("_a", F.array_max("_a")) - 1).alias("max_pos"))

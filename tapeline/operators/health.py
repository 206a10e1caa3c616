"""Score trends, latency and request metrics, drift statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.frames import div, ewm, quantiles, rolled, running


def score_trend(scores: DataFrame) -> DataFrame:
    """Direction of the last three scores, change, and mean of up to ten."""
    x = F.col("prediction")

    def build(h, w):
        a, b = F.lag(x, 2).over(w), F.lag(x, 1).over(w)
        way = F.when((x > b) & (b > a), "increasing").when((x < b) & (b < a), "decreasing").otherwise("stable")
        return h.select("symbol", "seq", "_c", way.alias("trend"), (x - b).alias("change"), F.avg(x).over(w.rowsBetween(-9, 0)).alias("moving_average"))

    return rolled(scores, build, 10)


def latency(requests: DataFrame, slot="1 hour") -> DataFrame:
    """Count, error share, mean, max and percentiles of ``ms`` per slot, with an error flag above 10%."""
    d = requests.withColumn("slot", F.date_trunc(slot.split()[1], "ts").cast("timestamp_ntz"))
    g = d.groupBy("slot").agg(F.count(F.lit(1)).alias("requests"), F.avg("ms").alias("mean"), F.max("ms").alias("max"), F.avg(F.col("error").cast("double")).alias("error_rate"))
    return g.join(quantiles(d, ["slot"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}), "slot").withColumn("alert", F.col("error_rate") > 0.1)


def request_metrics(requests: DataFrame, kinds, minutes=1) -> DataFrame:
    """Tumbling request counts per kind and a health state; works on batch and stream alike."""
    g = requests.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.avg("ms").alias("mean"), F.max("ms").alias("max"), F.avg(F.col("error").cast("double")).alias("error_rate"))
    health = F.when(F.col("error_rate") > 0.5, "unhealthy").when((F.col("error_rate") > 0.1) | (F.col("max") > 200), "degraded").otherwise("healthy")
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *[c for c in g.columns if c != "w"], health.alias("health"))


def page_hinkley(errors: DataFrame, delta=0.005, threshold=50.0) -> DataFrame:
    """Cumulative deviation from the running mean above its minimum, and the drift flag."""
    d = running(errors, {"_s": (F.col("error"), "sum")})
    d = running(d, {"_m": (F.col("error") - F.col("_s") / (F.col("seq") + 1) - delta, "sum")})
    d = running(d, {"_lo": (F.col("_m"), "min")})
    ph = F.col("_m") - F.col("_lo")
    return d.select("symbol", "seq", ph.alias("statistic"), (ph > threshold).alias("drift"))


def mean_shift(errors: DataFrame, window=30, factor=3.0) -> DataFrame:
    """Recent window mean against the one before it, in units of the pooled standard error."""
    x = F.col("error")

    def build(h, w):
        a, b = w.rowsBetween(1 - 2 * window, -window), w.rowsBetween(1 - window, 0)
        se = F.sqrt((F.var_samp(x).over(a) + F.var_samp(x).over(b)) / window)
        return h.select("symbol", "seq", "_c", F.when(F.count(x).over(a) == window, div(F.avg(x).over(b) - F.avg(x).over(a), se)).alias("shift"))

    return rolled(errors, build, 2 * window).withColumn("drift", F.coalesce(F.abs("shift") > factor, F.lit(False)))


def running_statistics(values: DataFrame, column: str, alpha=0.01) -> DataFrame:
    """Exponential mean and running extremes of a feature."""
    x = F.col(column)
    return running(ewm(values, {"mean": (x, alpha)}), {"min": (x, "min"), "max": (x, "max")})


def adaptation_report(errors: DataFrame, rows=100) -> DataFrame:
    """MAE and RMSE over the last rows, over the rows before them, the direction, and how often each detector saw a drift begin."""
    last = errors.groupBy("symbol").agg(F.max("seq").alias("_z"))
    d = errors.join(last, "symbol").withColumn("_age", F.col("_z") - F.col("seq"))
    e = F.col("error")
    new, old = F.when(F.col("_age") < rows, e), F.when((F.col("_age") >= rows) & (F.col("_age") < 2 * rows), e)
    g = d.groupBy("symbol").agg(F.avg(F.abs(new)).alias("mae"), F.sqrt(F.avg(new * new)).alias("rmse"), F.avg(F.abs(old)).alias("_p"), F.count(F.lit(1)).alias("n"))
    for name, found in (("shifts", mean_shift(errors)), ("page_hinkley", page_hinkley(errors))):
        begins = rolled(found.select("symbol", "seq", "drift"), lambda h, w: h.withColumn("_b", F.col("drift") & ~F.coalesce(F.lag("drift").over(w), F.lit(False))), 1)
        g = g.join(begins.groupBy("symbol").agg(F.count_if("_b").alias(name)), "symbol", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return g.select("symbol", "n", "mae", "rmse", F.when(F.col("mae") < F.col("_p"), "improving").when(F.col("mae") > F.col("_p"), "degrading").otherwise("stable").alias("trend"), "shifts", "page_hinkley")

"""Event-style tables derived from the bar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.frames import div, number_rows, rmean, rolled
from tapeline.operators.joins import first_touch
from tapeline.operators.patterns import window_patterns
from tapeline.operators.projections import condition_labels
from tapeline.sources.tables import DAY, bars_b, bars_d, epoch, ticks_u


def returns_p(spark, root) -> DataFrame:
    """Simple and log daily returns per brand; the first bar has none."""
    def build(h, w):
        p = F.lag("close").over(w)
        return h.select("symbol", "ts", "seq", "_c", "close", (div(F.col("close"), p) - 1).alias("r"), F.ln(div(F.col("close"), p)).alias("lr"))

    return rolled(bars_b(spark, root), build, 1).filter("seq > 0")


def regimes(spark, root) -> DataFrame:
    """Daily bars with their market condition label as the regime."""
    return condition_labels(bars_d(spark, root)).withColumnRenamed("condition", "regime")


def patterns(spark, root) -> DataFrame:
    """Classified 20-bar windows of the daily bars, numbered per symbol."""
    p = window_patterns(bars_d(spark, root), size=20, step=10, trend=0.002)
    return number_rows(p, ["start_seq"], F.floor(F.col("start_seq") / 10240))


def signals(spark, root) -> DataFrame:
    """Daily bars where the close crosses its 20-bar mean; side is the new direction."""
    def build(h, w):
        h = h.withColumn("_s", F.signum(F.col("close") - rmean(F.col("close"), 20, w)).cast("int"))
        return h.withColumn("_p", F.lag("_s").over(w))

    b = rolled(bars_d(spark, root), build, 21)
    return b.withColumn("side", F.when((F.col("_s") != 0) & (F.col("_s") != F.col("_p")), F.col("_s"))).drop("_s", "_p")


def trades(spark, root) -> DataFrame:
    """Closed trades: one per signal, left at the first touch of +25% / -20% or after 10 bars."""
    t = first_touch(signals(spark, root), take=0.25, stop=0.20, hold=10, side=F.col("side"), entries=F.col("side").isNotNull())
    return t.select(
        "symbol", F.col("ts").alias("entry_ts"), F.col("seq").alias("entry_seq"), "exit_seq", "side", F.col("close").alias("entry_px"),
        "exit_px", (F.col("side") * (F.col("exit_px") / F.col("close") - 1) - 0.002).alias("net_return"), "reason")


def predictions(spark, root) -> DataFrame:
    """Scored events: probability, tier, and the next value of the same user as outcome."""
    t = rolled(ticks_u(spark, root), lambda h, w: h.withColumn("y_true", F.lead("price").over(w)), 0, 1)
    cents = F.round(F.col("price") * 100).cast("long")
    tier = F.when(F.col("price") < 20, "low").when(F.col("price") < 60, "mid").otherwise("high")
    nxt = F.when(F.col("y_true") < 20, "low").when(F.col("y_true") < 60, "mid").otherwise("high")
    prob = (cents % 1001) / 1000.0
    return t.filter("y_true IS NOT NULL").select(
        F.col("event_id").alias("id"), "symbol", "seq", "ts", F.col("event_type").alias("model"), prob.alias("prob"),
        tier.alias("pred"), nxt.alias("actual"), F.col("price").alias("y_pred"), "y_true",
        (F.col("y_true") > F.col("price")).alias("up"))

"""Readers for the input tables and the bar tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions.frames import number_rows

DAY = 86400
HOUR = 3600


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def epoch(ts) -> "F.Column":
    return F.unix_timestamp(F.col(ts) if isinstance(ts, str) else ts)


def build_bars(ticks: DataFrame, step: int) -> DataFrame:
    """Bars of ``step`` seconds from ticks (symbol, ts, tie, price, size).

    All aggregates have map-side partials, so a hot symbol or hour is reduced
    before the shuffle.
    """
    slot = F.timestamp_seconds(F.floor(epoch("ts") / step) * step).cast("timestamp_ntz")
    order = F.struct("ts", "tie")
    return ticks.groupBy("symbol", slot.alias("bar_ts")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("size").cast("double").alias("volume"),
    ).withColumnRenamed("bar_ts", "ts")


def with_seq(bars: DataFrame, step: int, by=("symbol",)) -> DataFrame:
    """Add ``seq``; a numbering bucket spans 1024 bar intervals."""
    return number_rows(bars, ["ts"], F.floor(epoch("ts") / (step * 1024)), by)


def event_ticks(spark, root):
    e = table(spark, root, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.struct("event_id").alias("tie"),
                    F.col("value").alias("price"), F.lit(1).alias("size"))


def bars_h(spark, root) -> DataFrame:
    """Hourly bars, one symbol per event type."""
    return with_seq(build_bars(event_ticks(spark, root), HOUR), HOUR)


def bars_d(spark, root) -> DataFrame:
    """Daily bars, one symbol per order priority."""
    o = table(spark, root, "orders")
    t = o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"),
                 F.struct("o_orderkey").alias("tie"), F.col("o_totalprice").alias("price"), F.lit(1).alias("size"))
    return with_seq(build_bars(t, DAY), DAY)


def bars_b(spark, root) -> DataFrame:
    """Daily bars, one symbol per part brand."""
    line = table(spark, root, "lineitem").select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, root, "part").select("p_partkey", "p_brand")
    t = line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("tie"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))
    return with_seq(build_bars(t, DAY), DAY)


def ticks_u(spark, root) -> DataFrame:
    """One short series of event values per user."""
    e = table(spark, root, "events").select(
        F.col("user_id").alias("symbol"), "ts", "event_id", "event_type", F.col("value").alias("price"))
    return number_rows(e, ["ts", "event_id"], F.floor(epoch("ts") / DAY))


def series(spark, root) -> DataFrame:
    """Labelled arrays of 64 values."""
    e = table(spark, root, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))

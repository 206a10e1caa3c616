"""Streaming sources and event-time bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tick_stream(spark: SparkSession, path: str, schema, fmt="parquet", max_files=1) -> DataFrame:
    """File stream of ticks with a fixed schema."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def event_time_bars(ticks: DataFrame, step="1 hour", late="10 minutes") -> DataFrame:
    """Bars from (symbol, ts timestamp, tie, price, size); rows later than the watermark are dropped."""
    order = F.struct("ts", "tie")
    g = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", step).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("size").cast("double").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into parquet and stop."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def keep_batch(path: str):
    """Writer for ``foreachBatch``: the rows of a batch go to a folder of its number, and a batch that is played again replaces them."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def sink_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into an exactly-once alert table (column ``batch``) and stop."""
    q = stream.writeStream.foreachBatch(keep_batch(path)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()

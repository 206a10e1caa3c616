"""Readers and writers: bars, libraries, exports, fitted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.frames import div, number_rows, quantiles, rmean, rolled, rstd
from tapeline.functions.lineage import store

# Days per period name.
PERIOD_DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730, "5y": 1825, "10y": 3650, "max": 36500}

LIBRARY = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("key_points", T.ArrayType(T.StructType([T.StructField("position", T.DoubleType()), T.StructField("type", T.StringType())]))),
    T.StructField("rules", T.MapType(T.StringType(), T.StringType())), T.StructField("threshold", T.DoubleType())])


def scan_bars(df: DataFrame, names: dict | None = None) -> DataFrame:
    """Normalise column spellings; missing high/low/open fall back to close, volume to 1; NaN becomes NULL."""
    names = names or {}
    low = {c.lower(): c for c in df.columns}
    src = lambda k: names.get(k) or low.get(k)
    close = F.col(src("close") or low.get("price")).cast("double")
    price = lambda k: F.nanvl(F.col(src(k)).cast("double"), F.lit(None)) if src(k) else close
    vol = F.col(src("volume")).cast("double") if src("volume") else F.lit(1.0)
    return df.select(F.col(src("symbol")).alias("symbol"), F.col(src("ts") or low.get("timestamp") or low.get("date")).alias("ts"),
                     *[price(k).alias(k) for k in ("open", "high", "low")], F.nanvl(close, F.lit(None)).alias("close"), vol.alias("volume"))


def recent(bars: DataFrame, period: str) -> DataFrame:
    """Bars of the last ``period`` before the newest bar of the table."""
    newest = bars.agg(F.max("ts").alias("_z"))
    days = F.make_dt_interval(F.lit(PERIOD_DAYS[period]))
    return bars.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("_z") - days).drop("_z")


def latest(rows: DataFrame, keys, loaded="loaded_at") -> DataFrame:
    """Latest version of every key (one reduction, no window)."""
    rec = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.col(loaded)).alias("_r")
    return rows.groupBy(*keys).agg(rec).select(*[c if c in keys else F.col("_r." + c) for c in rows.columns])


def upsert(base: DataFrame, changes: DataFrame, keys, loaded="loaded_at") -> DataFrame:
    """Latest version of every key of both tables."""
    return latest(base.unionByName(changes), keys, loaded)


def upsert_partitions(changes: DataFrame, path: str, keys, by: str, loaded="loaded_at") -> None:
    """Merge ``changes`` into the partitioned table at ``path``; only partitions that they touch are read, and only these are replaced."""
    spark = changes.sparkSession
    touched = changes.select(F.struct(by).alias("_k")).distinct()
    base = spark.read.parquet(path).withColumn("_k", F.struct(by)).join(touched, "_k", "left_semi").drop("_k")
    # stored, since the partitions that are read are replaced
    write_partitions(store(upsert(base.select(*changes.columns), changes, keys, loaded)), path, by)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions present in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def fresh_lookup(facts: DataFrame, dim: DataFrame, keys, updated: str, now, seconds=86400) -> DataFrame:
    """Join a dimension, keeping only rows updated within ``seconds`` of ``now``."""
    return facts.join(dim.filter(F.unix_timestamp(updated) > F.unix_timestamp(now) - seconds), list(keys))


def period_panel(bars: DataFrame, periods: DataFrame, least=50) -> DataFrame:
    """Bars tagged with every period (start_ts <= ts < end_ts) that holds more than ``least`` bars."""
    p = bars.join(F.broadcast(periods), (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts"))).drop("start_ts", "end_ts")
    size = p.groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("length")).filter(F.col("length") > least)
    return p.join(size, ["symbol", "period"])


def quality_gate(bars: DataFrame, least=20) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("close").isNull() | F.isnan("close")).alias("missing")).withColumn(
        "valid", (F.col("rows") >= least) & (F.col("missing") == 0))


def analysis_columns(bars: DataFrame) -> DataFrame:
    """20/50 means, annualised volatility, volume mean and ratio."""
    def build(h, w):
        c, v = F.col("close"), F.col("volume")
        h = h.withColumn("returns", F.coalesce(div(c, F.lag(c).over(w)) - 1, F.lit(0.0)))
        h = h.select("*", rmean(c, 20, w).alias("sma_20"), rmean(c, 50, w).alias("sma_50"), (rstd(F.col("returns"), 20, w) * 252 ** 0.5).alias("volatility"), rmean(v, 20, w).alias("volume_sma"))
        return h.withColumn("volume_ratio", div(v, F.col("volume_sma")))

    return rolled(bars, build, 51)


def feature_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Feature matrix: all columns but the last are features, the last is the target."""
    d = spark.read.csv(path, header=True, schema=schema)
    names = d.columns
    return d.select(F.array(*[F.col(c).cast("double") for c in names[:-1]]).alias("features"), F.col(names[-1]).alias("target"))


def flatten(df: DataFrame, sep="_") -> DataFrame:
    """Expand nested structs into columns joined by ``sep``."""
    def walk(schema, path):
        for f in schema.fields:
            p = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, p)
            else:
                yield F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p))

    return df.select(*walk(df.schema, []))


def envelope(df: DataFrame, version="1.0") -> DataFrame:
    """One JSON-ready record per row with export metadata."""
    n = df.agg(F.count(F.lit(1)).alias("count"))
    return df.crossJoin(F.broadcast(n)).select("count", F.lit(version).alias("version"), F.struct(*df.columns).alias("pattern"))


def template(df: DataFrame, defaults: dict) -> DataFrame:
    """Projection with defaults for missing columns and NULLs."""
    return df.select(*[F.coalesce(F.col(k), F.lit(v)).alias(k) if k in df.columns else F.lit(v).alias(k) for k, v in defaults.items()])


def batch_export(df: DataFrame, path: str, by="symbol") -> DataFrame:
    """One directory per key; returns the row count of each."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))


def to_rows(series: DataFrame) -> DataFrame:
    return series.select("id", F.posexplode("v").alias("pos", "value"))


def from_rows(rows: DataFrame) -> DataFrame:
    """Arrays back from (id, pos, value); one array per id as it was exported."""
    packed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return rows.groupBy("id").agg(packed.alias("_p")).select("id", F.transform("_p", lambda s: s.value).alias("v"))

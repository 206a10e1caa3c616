"""Scan, source and sink queries.  Sinks write to a fresh folder and read back."""

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeline.functions.lineage import shared_folder
from tapeline.operators import projections as P
from tapeline.operators import transitions as TR
from tapeline.plans.a_transitions import states
from tapeline.plans.registry import query
from tapeline.plans.w_indicators import W, g, keep
from tapeline.sources import derived as D
from tapeline.sources import io
from tapeline.sources.tables import DAY, bars_b, bars_d, bars_h, build_bars, epoch, event_ticks, series, table, with_seq


def folder(spark):
    """A fresh output folder inside the shared one."""
    return f"{shared_folder(spark)}/out-{uuid.uuid4().hex}"


@query("s01_bar_scan", "bars_h", f"SELECT symbol, seq, open, high, low, close, volume, coalesce(close / lag(close) OVER w - 1, 0) AS returns FROM bars_h {W}", "returns")
def s01(spark, root):
    raw = build_bars(event_ticks(spark, root), 3600).withColumnsRenamed({"ts": "Date", "open": "Open", "close": "CLOSE", "volume": "Volume"})
    return P.with_returns(with_seq(io.scan_bars(raw), 3600)).drop("ts")


@query("s02_bar_builder", "bars_h", "SELECT symbol, ts, open, high, low, close, volume FROM bars_h")
def s02(spark, root):
    return build_bars(event_ticks(spark, root), 3600)


@query("s03_period_read", "bars_d", "SELECT symbol, seq, close FROM bars_d WHERE ts >= (SELECT max(ts) FROM bars_d) - INTERVAL 365 DAY")
def s03(spark, root):
    return keep(io.recent(bars_d(spark, root), "1y"), "close")


@query("s04_upsert", "", """SELECT o_custkey AS custkey, CAST(o_orderdate AS TIMESTAMP) AS ts, last(o_totalprice ORDER BY o_orderkey) AS price FROM orders GROUP BY ALL""")
def s04(spark, root):
    o = table(spark, root, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("loaded_at"), "o_orderstatus")
    base, new = o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), o.filter("o_orderstatus <> 'F'").drop("o_orderstatus")
    return io.upsert(base, new, ["custkey", "ts"]).drop("loaded_at")


@query("s04_partitions", "", """SELECT CAST(year(o_orderdate) AS INT) AS year, o_custkey AS custkey, CAST(o_orderdate AS TIMESTAMP) AS ts, last(o_totalprice ORDER BY o_orderkey) AS price FROM orders GROUP BY ALL""")
def s04_partitions(spark, root):
    """The table by year on disk; orders that came later replace only the years they touch."""
    path = folder(spark)
    o = table(spark, root, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("custkey"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("loaded_at"), "o_orderstatus")
    keys = ["year", "custkey", "ts"]
    io.write_partitions(io.latest(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), keys), path, "year")
    io.upsert_partitions(o.filter("o_orderstatus <> 'F'").drop("o_orderstatus"), path, keys, "year")
    return spark.read.parquet(path).drop("loaded_at")


@query("s05_fresh_lookup", "", """WITH z AS (SELECT max(ts) AS z FROM events), d AS (SELECT user_id, max(ts) AS last_updated, count(*) AS n FROM events GROUP BY 1) SELECT event_id, user_id, n FROM events JOIN d USING (user_id), z WHERE epoch(last_updated) // 1 > epoch(z) // 1 - 86400""".replace("epoch(last_updated) // 1", "floor(epoch(last_updated))").replace("epoch(z) // 1", "floor(epoch(z))"))
def s05(spark, root):
    e = table(spark, root, "events")
    dim = e.groupBy("user_id").agg(F.max("ts").alias("last_updated"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("_now"))))
    return io.fresh_lookup(e, dim, ["user_id"], "last_updated", "_now").select("event_id", "user_id", "n")


_PER = [("p1", "1995-01-01", "1997-01-01"), ("p2", "1996-01-01", "1999-01-01"), ("p3", "1999-01-01", "2002-01-01")]


@query("s06_period_panel", "bars_b", "WITH p AS (SELECT symbol, seq, ts, close, period, count(*) OVER (PARTITION BY symbol, period) AS length FROM bars_b JOIN (VALUES "
       + ", ".join(f"('{a}', TIMESTAMP '{b}', TIMESTAMP '{c}')" for a, b, c in _PER) + ") v(period, a, b) ON ts >= a AND ts < b) SELECT symbol, seq, period, length FROM p WHERE length > 50")
def s06(spark, root):
    p = spark.createDataFrame(_PER, "period string, a string, b string").select("period", F.col("a").cast("timestamp_ntz").alias("start_ts"), F.col("b").cast("timestamp_ntz").alias("end_ts"))
    return keep(io.period_panel(bars_b(spark, root), p), "period", "length")


@query("s07_quality_gate", "bars_b", "SELECT symbol, count(*) AS rows, count(*) FILTER (close IS NULL) AS missing, count(*) >= 20 AND count(*) FILTER (close IS NULL) = 0 AS valid FROM bars_b GROUP BY symbol")
def s07(spark, root):
    return io.quality_gate(bars_b(spark, root))


_S8 = "sma_20 sma_50 volatility volume_sma volume_ratio"


@query("s08_analysis_columns", "bars_d", f"""SELECT *, volume / volume_sma AS volume_ratio FROM (SELECT symbol, seq, volume, {g('avg', 'close', 20)} AS sma_20, {g('avg', 'close', 50)} AS sma_50, {g('stddev_samp', 'returns', 20)} * sqrt(252) AS volatility, {g('avg', 'volume', 20)} AS volume_sma
  FROM (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS returns FROM bars_d {W}))""", _S8, d=4)
def s08(spark, root):
    return keep(io.analysis_columns(bars_d(spark, root)), "volume", *_S8.split())


@query("s09_feature_csv", "", "SELECT l_quantity + l_extendedprice + l_discount AS total, l_tax AS target FROM lineitem", "total", d=4)
def s09(spark, root):
    path = folder(spark)
    table(spark, root, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax").write.csv(path + "/m", header=True)
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return io.feature_csv(spark, path + "/m", schema).select(F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"), "target")


@query("s10_library_json", "patterns", "SELECT type AS name, symbol AS category, count(*) AS points, avg(strength) AS threshold FROM patterns GROUP BY ALL", "threshold")
def s10(spark, root):
    p = D.patterns(spark, root).groupBy(F.col("type").alias("name"), F.col("symbol").alias("category")).agg(F.count(F.lit(1)).alias("_n"), F.avg("strength").alias("threshold"))
    lib = p.select("name", "category", F.lit("").alias("description"), F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.struct((i / F.col("_n")).alias("position"), F.lit("peak").alias("type"))).alias("key_points"),
                   F.create_map(F.lit("min_points"), F.col("_n").cast("string")).alias("rules"), "threshold")
    path = folder(spark)
    lib.write.json(path + "/lib")
    back = spark.read.schema(io.LIBRARY).json(path + "/lib")
    return back.select("name", "category", F.element_at("rules", "min_points").cast("long").alias("points"), "threshold")


@query("s11_flatten_csv", "patterns", "SELECT symbol AS key_symbol, seq AS key_seq, type, strength AS features_strength, volatility AS features_volatility FROM patterns", "features_strength features_volatility")
def s11(spark, root):
    nested = D.patterns(spark, root).select(F.struct("symbol", "seq").alias("key"), "type", F.struct("strength", "volatility").alias("features"))
    flat, path = io.flatten(nested), folder(spark)
    flat.write.csv(path + "/flat", header=True)
    return spark.read.csv(path + "/flat", header=True, schema=flat.schema)


@query("s12_json_export", "patterns", "SELECT (SELECT count(*) FROM patterns) AS count, '1.0' AS version, symbol, seq, type, 0.7 AS confidence FROM patterns")
def s12(spark, root):
    t = io.template(D.patterns(spark, root), {"symbol": "", "seq": 0, "type": "unknown", "confidence": 0.7})
    env, path = io.envelope(t), folder(spark)
    env.write.json(path + "/x")
    return spark.read.schema(env.schema).json(path + "/x").select("count", "version", "pattern.symbol", "pattern.seq", "pattern.type", "pattern.confidence")


@query("s13_batch_export", "bars_b", "SELECT symbol, count(*) AS rows FROM bars_b GROUP BY symbol")
def s13(spark, root):
    path = folder(spark)
    io.batch_export(bars_b(spark, root), path + "/by")
    return spark.read.parquet(path + "/by").groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


@query("s14_array_round_trip", "series", "SELECT id, len(v) AS n, list_sum(v) AS total, v[1] AS first_value, v[64] AS last_value FROM series", "total first_value last_value")
def s14(spark, root):
    rows, path = io.to_rows(series(spark, root)), folder(spark)
    rows.write.csv(path + "/rows", header=True)
    s = io.from_rows(spark.read.csv(path + "/rows", header=True, schema=rows.schema))
    return s.select("id", F.size("v").cast("long").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("v")[0].alias("first_value"), F.col("v")[63].alias("last_value"))


@query("s16_fitted_tables", "m1", 'SELECT "from", "to", p FROM m1', "p")
def s16(spark, root):
    path = folder(spark)
    TR.transition_matrix(states(spark, root), 5).write.parquet(path + "/m1")
    return spark.read.parquet(path + "/m1").select("from", F.col("to").cast("long").alias("to"), "p")

"""Streaming queries and their batch forms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.operators import health as H
from tapeline.plans.registry import ORACLES, cte, query
from tapeline.plans.s_sources import folder
from tapeline.plans.w_indicators import W, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import build_bars, event_ticks, table, ticks_u, with_seq
from tapeline.streaming import bars as SB
from tapeline.streaming import monitor as MO


_DAY = 86_400


def span(rows):
    """Seconds from the first to the last ``ts``, rounded up: how late a row of files in any order can be."""
    return int(rows.agg(F.max(F.unix_timestamp("ts")) - F.min(F.unix_timestamp("ts"))).first()[0] or 0) + 1


def clock(rows, late):
    """One row behind all others, with no values: it moves the watermark a day past the last of them."""
    ts = (F.max("ts") + F.make_dt_interval(secs=F.lit(late + _DAY))).alias("ts")
    return rows.agg(ts).select(*[F.lit("").alias(c) if c == "symbol" else F.col("ts") if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])


def monitor_bars(spark, root):
    """Ten-minute bars of the events at their own times, gaps included."""
    bars = with_seq(build_bars(event_ticks(spark, root), 600), 600)
    return bars.select("symbol", "seq", F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "close", "volume")


def all_alerts(spark, root):
    """Events of the finished series, expiries after the last bar included."""
    return MO.batch_alerts(store(monitor_bars(spark, root)), horizon=1e18)


@query("t05_monitor_alerts")
def t05(spark, root):
    return all_alerts(spark, root).drop("levels")


@query("t09_alert_views")
def t09(spark, root):
    return all_alerts(spark, root).groupBy("kind", "event").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


@query("t10_key_levels")
def t10(spark, root):
    return all_alerts(spark, root).select("symbol", "t", "kind", "event", F.posexplode("levels").alias("pos", "level"))


def replay(rows, path, late, parts=6):
    """The rows as files of a stream in any order, and last the clock row."""
    rows.repartition(parts).write.parquet(path)
    clock(rows, late).coalesce(1).write.mode("append").parquet(path)
    return SB.tick_stream(rows.sparkSession, path, rows.schema, max_files=2)


def streamed(spark, bars, history=None, sink=SB.run_once):
    out, bars = folder(spark), bars.select("symbol", "ts", "close", "volume")
    late = span(bars)
    with MO.rocks_store(spark):
        sink(MO.stream_alerts(replay(bars, out + "/in", late), f"{late} seconds", history), out + "/alerts", out + "/ck")
    return spark.read.parquet(out + "/alerts")


@query("t02_backfill")
def t02(spark, root):
    """The first half of the time is history; the stream starts from its state and gives the events of the second half."""
    bars = store(monitor_bars(spark, root))
    middle = bars.agg(((F.min("t") + F.max("t")) / 2).alias("m")).first()["m"]
    return streamed(spark, bars.filter(F.col("t") > middle), bars.filter(F.col("t") <= middle).select("symbol", "ts", "close", "volume")).drop("levels")


@query("t03_stream_alerts")
def t03(spark, root):
    return streamed(spark, store(monitor_bars(spark, root))).drop("levels")


@query("t06_raised_once")
def t06(spark, root):
    """Detections of each formation with the time since the one before: never under 1.5 times its duration unless that one completed."""
    a = all_alerts(spark, root).filter("event = 'detected'")
    before = F.lag("t").over(Window.partitionBy("symbol", "kind", F.floor(F.col("t") / 86400)).orderBy("t"))
    return a.select("symbol", "kind", "t", (F.col("t") - before).alias("since"))


@query("t07_progress")
def t07(spark, root):
    """How formations end, by the stage and progress they were in."""
    a = all_alerts(spark, root)
    return a.groupBy("kind", "event", "stage", "progress").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("t") - F.col("started")).alias("mean_age"))


@query("t08_alert_sink")
def t08(spark, root):
    return streamed(spark, store(monitor_bars(spark, root)), sink=SB.sink_once).drop("levels", "batch")


@query("t11_score_trend", "predictions", """SELECT symbol, seq, CASE WHEN y_pred > b AND b > a THEN 'increasing' WHEN y_pred < b AND b < a THEN 'decreasing' ELSE 'stable' END AS trend, y_pred - b AS change, ma AS moving_average FROM (
  SELECT *, lag(y_pred, 2) OVER w AS a, lag(y_pred) OVER w AS b, avg(y_pred) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ma FROM predictions """ + W + ")", "change moving_average")
def t11(spark, root):
    return H.score_trend(D.predictions(spark, root).select("symbol", "seq", F.col("y_pred").alias("prediction")))


def requests(spark, root):
    return table(spark, root, "events").select("ts", F.col("value").alias("ms"), F.col("event_type").alias("kind"), (F.col("event_type") == "error").alias("error"))


@query("t12_latency", "", """SELECT date_trunc('hour', ts) AS slot, count(*) AS requests, avg(value) AS mean, max(value) AS max, avg(CAST(event_type = 'error' AS DOUBLE)) AS error_rate, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99,
  avg(CAST(event_type = 'error' AS DOUBLE)) > 0.1 AS alert FROM events GROUP BY 1""", "mean max error_rate p50 p95 p99")
def t12(spark, root):
    return H.latency(requests(spark, root))


@query("t13_request_metrics", "", """SELECT *, CASE WHEN error_rate > 0.5 THEN 'unhealthy' WHEN error_rate > 0.1 OR max > 200 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS start, count(*) AS requests, count(*) FILTER (event_type = 'click') AS n_click,
  count(*) FILTER (event_type = 'purchase') AS n_purchase, avg(value) AS mean, max(value) AS max, avg(CAST(event_type = 'error' AS DOUBLE)) AS error_rate FROM events GROUP BY 1)""", "mean max error_rate")
def t13(spark, root):
    return H.request_metrics(requests(spark, root), ["click", "purchase"], 30)


cte("errs", "SELECT symbol, seq, abs(y_true - y_pred) AS error FROM predictions", "predictions")


def errs(spark, root):
    return D.predictions(spark, root).select("symbol", "seq", F.abs(F.col("y_true") - F.col("y_pred")).alias("error"))


@query("t14_page_hinkley", "errs", f"""WITH a AS (SELECT *, avg(error) OVER w AS mean FROM errs {W}), b AS (SELECT *, sum(error - mean - 0.005) OVER w AS m FROM a {W}), c AS (SELECT *, min(m) OVER w AS lo FROM b {W})
  SELECT symbol, seq, m - lo AS statistic, m - lo > 50 AS drift FROM c""", "statistic")
def t14(spark, root):
    return H.page_hinkley(errs(spark, root))


@query("t14_mean_shift", "errs", """SELECT symbol, seq, shift, coalesce(abs(shift) > 3, FALSE) AS drift FROM (SELECT symbol, seq, CASE WHEN count(*) OVER a = 30 THEN (avg(error) OVER b - avg(error) OVER a) / sqrt((var_samp(error) OVER a + var_samp(error) OVER b) / 30) END AS shift FROM errs
  WINDOW a AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 59 PRECEDING AND 30 PRECEDING), b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""", "shift")
def t14b(spark, root):
    return H.mean_shift(errs(spark, root))


@query("t15_running_statistics", "ticks_u", f"""WITH RECURSIVE e AS (SELECT symbol, seq, price AS mean FROM ticks_u WHERE seq = 0 UNION ALL SELECT t.symbol, t.seq, e.mean * 0.99 + t.price * 0.01 FROM e JOIN ticks_u t ON t.symbol = e.symbol AND t.seq = e.seq + 1)
  SELECT symbol, seq, mean, min, max FROM e JOIN (SELECT symbol, seq, min(price) OVER w AS min, max(price) OVER w AS max FROM ticks_u {W}) USING (symbol, seq)""", "mean min max")
def t15(spark, root):
    return keep(H.running_statistics(ticks_u(spark, root), "price"), "mean", "min", "max")


cte("drifts", f"""SELECT symbol, seq, kind, drift, lag(drift) OVER (PARTITION BY symbol, kind ORDER BY seq) AS before FROM (SELECT symbol, seq, 'shifts' AS kind, drift FROM ({ORACLES["t14_mean_shift"][1]}) UNION ALL SELECT symbol, seq, 'page_hinkley', drift FROM ({ORACLES["t14_page_hinkley"][1]}))""", "errs")


@query("t16_adaptation_report", "drifts", """SELECT symbol, n, mae, rmse, CASE WHEN mae < p THEN 'improving' WHEN mae > p THEN 'degrading' ELSE 'stable' END AS trend, shifts, page_hinkley FROM (SELECT symbol, count(*) AS n, avg(error) FILTER (age < 30) AS mae, sqrt(avg(error * error) FILTER (age < 30)) AS rmse, avg(error) FILTER (age >= 30 AND age < 60) AS p
  FROM (SELECT *, max(seq) OVER (PARTITION BY symbol) - seq AS age FROM errs) GROUP BY symbol) JOIN (SELECT symbol, count(*) FILTER (kind = 'shifts' AND drift AND NOT coalesce(before, FALSE)) AS shifts, count(*) FILTER (kind = 'page_hinkley' AND drift AND NOT coalesce(before, FALSE)) AS page_hinkley FROM drifts GROUP BY symbol) USING (symbol)""", "mae rmse")
def t16(spark, root):
    return H.adaptation_report(store(errs(spark, root)), 30)


@query("t17_event_time_bars", "bars_h", "SELECT symbol, ts, open, high, low, close, volume FROM bars_h")
def t17(spark, root):
    """The events as files in any order; the watermark waits for all of them, and a clock row behind closes the last window."""
    out = folder(spark)
    ticks = table(spark, root, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.struct("event_id").alias("tie"), F.col("value").alias("price"), F.lit(1).alias("size"))
    late = span(ticks)
    SB.run_once(SB.event_time_bars(replay(ticks, out + "/in", late), late=f"{late} seconds"), out + "/bars", out + "/ck")
    return spark.read.parquet(out + "/bars").withColumn("ts", F.col("ts").cast("timestamp_ntz"))

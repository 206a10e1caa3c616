"""Projection, filter and scalar-column queries."""

from pyspark.sql import functions as F

from tapeline.operators import projections as P
from tapeline.plans.registry import oracle, query
from tapeline.plans.w_indicators import W, frame, g, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import bars_b, bars_d, bars_h, series, ticks_u

RET = f"SELECT *, close / lag(close) OVER w - 1 AS r FROM bars_d {W}"
_P1 = "returns_1d returns_5d returns_20d log_returns_1d log_returns_5d"


@query("p01_returns", "bars_b", "SELECT symbol, seq, " + ", ".join(f"close / lag(close, {n}) OVER w - 1 AS returns_{n}d" for n in (1, 5, 20))
       + ", ln(close / lag(close) OVER w) AS log_returns_1d, ln(close / lag(close, 5) OVER w) AS log_returns_5d FROM bars_b " + W, _P1)
def p01(spark, root):
    return keep(P.return_columns(bars_b(spark, root)), *_P1.split())


_P2 = "high_low_ratio close_open_ratio price_position_20d price_position_50d"


@query("p02_price_position", "bars_b", "SELECT symbol, seq, high / low AS high_low_ratio, close / open AS close_open_ratio, " + ", ".join(
    f"(close - ({g('min', 'close', n)})) / nullif(({g('max', 'close', n)}) - ({g('min', 'close', n)}), 0) AS price_position_{n}d" for n in (20, 50)) + " FROM bars_b", _P2)
def p02(spark, root):
    return keep(P.price_position(bars_b(spark, root)), *_P2.split())


_P3 = "day_of_week_sin day_of_week_cos month_sin month_cos"


@query("p03_calendar", "bars_h", """SELECT symbol, seq, day_of_week, day(ts) AS day_of_month, month(ts) AS month, quarter(ts) AS quarter, hour(ts) AS hour,
  sin(2 * pi() * day_of_week / 7) AS day_of_week_sin, cos(2 * pi() * day_of_week / 7) AS day_of_week_cos,
  sin(2 * pi() * month(ts) / 12) AS month_sin, cos(2 * pi() * month(ts) / 12) AS month_cos,
  CAST(day_of_week = 0 AS INT) AS is_monday, CAST(day_of_week = 4 AS INT) AS is_friday, CAST(day_of_week >= 5 AS INT) AS is_weekend,
  CAST(day(ts) <= 5 AS INT) AS is_month_start, CAST(day(ts) >= 25 AS INT) AS is_month_end, CAST(day(ts) = 1 AS INT) AS first_of_month,
  CAST(CAST(ts AS DATE) = last_day(ts) AS INT) AS last_of_month FROM (SELECT *, isodow(ts) - 1 AS day_of_week FROM bars_h)""", _P3)
def p03(spark, root):
    return P.calendar(bars_h(spark, root)).drop("ts", "open", "high", "low", "close", "volume")


@query("p04_lags", "bars_h", f"SELECT symbol, seq, lag(close, 1) OVER w AS close_lag_1, lag(close, 2) OVER w AS close_lag_2, lag(close, 5) OVER w AS close_lag_5 FROM bars_h {W}",
       "close_lag_1 close_lag_2 close_lag_5")
def p04(spark, root):
    return keep(P.lags(bars_h(spark, root), "close", [1, 2, 5, -3]), "close_lag_1", "close_lag_2", "close_lag_5")


_P5 = [f"close_{k}_{n}" for n in (5, 10, 20) for k in ("mean", "std", "min", "max")]


@query("p05_rolling_grid", "bars_h", "SELECT symbol, seq, " + ", ".join(f"{g(a, 'close', n)} AS close_{k}_{n}" for n in (5, 10, 20)
       for k, a in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM bars_h", " ".join(_P5))
def p05(spark, root):
    return keep(P.rolling_grid(bars_h(spark, root), "close"), *_P5)


@query("p06_targets", "bars_b", f"SELECT symbol, seq, lead(close, 5) OVER w / close - 1 AS target_return, CASE WHEN lead(close, 5) OVER w / close - 1 > 0 THEN 1 ELSE 0 END AS target_direction FROM bars_b {W}", "target_return")
def p06(spark, root):
    return keep(P.targets(bars_b(spark, root)), "target_return", "target_direction")


@query("p07_condition_labels", "regimes", "SELECT symbol, seq, regime AS condition, vol, r FROM regimes", "vol r")
def p07(spark, root):
    return keep(P.condition_labels(bars_d(spark, root)), "condition", "vol", "r")


@query("p08_sliding_windows", "bars_h", f"""SELECT symbol, seq, label, list_sum(win) AS total, win[1] AS first_value, win[20] AS last_value FROM (
  SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS win, lead(close, 5) OVER w AS f,
  CASE WHEN lead(close, 5) OVER w > close THEN 1 ELSE 0 END AS label FROM bars_h {W}) WHERE len(win) = 20 AND f IS NOT NULL""", "total first_value last_value")
def p08(spark, root):
    d = P.sliding_windows(bars_h(spark, root), 20, 5)
    return keep(d, "label", F.aggregate("window", F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("window")[0].alias("first_value"), F.col("window")[19].alias("last_value"))


@query("p09_supervised_sequences", "bars_h", """SELECT symbol, seq, k AS step, CAST(x[k + 1] AS DOUBLE) AS x, CASE WHEN k < 3 THEN y[k + 1] END AS y FROM (
  SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS x,
   list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 10 FOLLOWING AND 12 FOLLOWING) AS y FROM bars_h), range(10) t(k) WHERE len(x) = 10 AND len(y) = 3""", "x y")
def p09(spark, root):
    d = P.supervised_sequences(bars_h(spark, root), 10, 3).select("symbol", "seq", "y", F.posexplode("x").alias("step", "_x"))
    return d.select("symbol", "seq", F.col("step").cast("long").alias("step"), F.col("_x").alias("x"), F.try_element_at("y", F.col("step") + 1).alias("y"))


_SUB = """SELECT id, n AS length, start, list_sum(sub) AS total FROM (SELECT id, n, start, v[start + 1:start + n] AS sub FROM series,
  (VALUES (8, 4), (16, 8)) g(n, st), LATERAL (SELECT unnest(range(0, len(v) - n + 1, st)) AS start))"""


@query("p10_subsequences", "series", _SUB, "total")
def p10(spark, root):
    d = P.subsequences(series(spark, root), [8, 16], lambda n: n // 2)
    return d.select("id", "length", "start", F.aggregate("sub", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("p11_gap_fill", "ticks_u", """SELECT symbol, seq, coalesce(x, p + (n - p) * (seq - ps) / (ns - ps), n, p) AS x_filled FROM (
  SELECT *, last_value(x IGNORE NULLS) OVER a AS p, last_value(CASE WHEN x IS NOT NULL THEN seq END IGNORE NULLS) OVER a AS ps,
   first_value(x IGNORE NULLS) OVER b AS n, first_value(CASE WHEN x IS NOT NULL THEN seq END IGNORE NULLS) OVER b AS ns
  FROM (SELECT symbol, seq, CASE WHEN event_type <> 'error' THEN price END AS x FROM ticks_u)
  WINDOW a AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "x_filled")
def p11(spark, root):
    t = ticks_u(spark, root).withColumn("x", F.when(F.col("event_type") != "error", F.col("price")))
    return keep(P.fill_gaps(t, "x"), "x_filled")


@query("p12_impute", "ticks_u", """WITH t AS (SELECT symbol, seq, event_type, CASE WHEN event_type <> 'error' THEN price END AS x FROM ticks_u),
  s AS (SELECT symbol, avg(x) AS m, quantile_cont(x, 0.5) AS md FROM t GROUP BY symbol)
  SELECT symbol, seq, coalesce(x, m) AS x_mean, coalesce(x, md) AS x_median, x IS NOT NULL AS kept FROM t JOIN s USING (symbol)""", "x_mean x_median")
def p12(spark, root):
    t = ticks_u(spark, root).select("symbol", "seq", F.when(F.col("event_type") != "error", F.col("price")).alias("x_mean"))
    t = t.withColumn("x_median", F.col("x_mean")).withColumn("kept", F.col("x_mean").isNotNull())
    return P.impute(P.impute(t, ["symbol"], ["x_mean"]), ["symbol"], ["x_median"], "median")


@query("p13_scalers", "returns_p", """WITH s AS (SELECT symbol, avg(r) AS m, stddev_pop(r) AS sd, min(r) AS lo, max(r) AS hi, quantile_cont(r, 0.25) AS q1,
   quantile_cont(r, 0.5) AS q2, quantile_cont(r, 0.75) AS q3 FROM returns_p WHERE ts < TIMESTAMP '1999-01-01' GROUP BY symbol)
  SELECT symbol, seq, (r - m) / sd AS r_standard, (r - q2) / (q3 - q1) AS r_robust, (r - lo) / (hi - lo) AS r_minmax FROM returns_p JOIN s USING (symbol)
  WHERE ts >= TIMESTAMP '1999-01-01'""", "r_standard r_robust r_minmax")
def p13(spark, root):
    r = D.returns_p(spark, root).select("symbol", "ts", "seq", "r")
    cut = F.expr("timestamp_ntz '1999-01-01'")
    return P.scale(r.filter(F.col("ts") < cut), r.filter(F.col("ts") >= cut), ["symbol"], "r").drop("ts", "r")


@query("p14_normalise", "series", """SELECT id, k - 1 AS pos, CASE WHEN s < 1e-8 THEN 0 ELSE (v[k] - m) / s END AS z, (v[k] - lo) / (hi - lo) AS minmax
  FROM (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s, list_min(v) AS lo, list_max(v) AS hi FROM series), range(1, 65) t(k)""", "z minmax")
def p14(spark, root):
    d = P.normalise(series(spark, root)).select("id", F.posexplode(F.arrays_zip("z", "minmax")).alias("pos", "a"))
    return d.select("id", F.col("pos").cast("long").alias("pos"), "a.z", "a.minmax")


@query("p15_library_view", "patterns", "SELECT p.symbol, p.seq, type, strength, frequency FROM patterns p JOIN (SELECT type, count(*) AS frequency FROM patterns WHERE type LIKE 'reversal%' GROUP BY type) USING (type)", "strength")
def p15(spark, root):
    d = P.library_view(D.patterns(spark, root), types=["reversal_top", "reversal_bottom"], order="frequency")
    return keep(d, "type", "strength", "frequency")


@query("p16_detail_levels", "bars_b", """WITH n AS (SELECT symbol, count(*) AS n FROM bars_b GROUP BY symbol),
  l AS (SELECT symbol, -1 AS level, n // 200 AS step FROM n WHERE n > 200 UNION ALL
   SELECT symbol, k, CAST(2 ** (k + 1) AS BIGINT) FROM n, range(5) t(k) WHERE n > 200 AND ceil(n / 2 ** k) > 200)
  SELECT symbol, seq, close, CAST(level AS BIGINT) AS level FROM bars_b JOIN l USING (symbol) WHERE seq % step = 0""", "close", d=8)
def p16(spark, root):
    return P.detail_levels(bars_b(spark, root), 200).withColumn("level", F.col("level").cast("long"))


@query("p17_pages", "bars_h", """SELECT symbol, seq, close, 'page' AS part FROM bars_h WHERE seq BETWEEN 100 AND 149 UNION ALL
  SELECT symbol, seq, close, CASE WHEN seq < 10 THEN 'head' ELSE 'tail' END FROM bars_h JOIN (SELECT symbol, max(seq) AS m FROM bars_h GROUP BY symbol) USING (symbol) WHERE seq < 10 OR seq > m - 10""", "close")
def p17(spark, root):
    b = bars_h(spark, root)
    a = keep(P.page(b, 100, 50), "close", F.lit("page").alias("part"))
    return a.unionByName(keep(P.head_tail(b, 10), "close", "part"))


@query("p17_sample", "bars_b", f"SELECT symbol, seq, close FROM bars_b WHERE md5(symbol || '|' || seq || '|42')[1:8] < '{int(0.1 * 2**32):08x}'", "close", d=8)
def p17b(spark, root):
    return keep(P.sample_rows(bars_b(spark, root), 0.1), "close")


_ST = f"""SELECT *, CASE WHEN ({g('avg', 'close', 20)}) > ({g('avg', 'close', 50)}) THEN 1 ELSE -1 END AS trend, {g('stddev_samp', 'returns', 20)} AS vol
  FROM (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS returns FROM bars_d {W})"""
_RK = f"""SELECT *, CASE WHEN vol IS NOT NULL THEN (rank() OVER (PARTITION BY symbol, vol IS NULL ORDER BY vol) + (count(*) OVER (PARTITION BY symbol, vol) - 1) / 2.0)
  / count(vol) OVER (PARTITION BY symbol) END AS vol_rank FROM ({_ST})"""


@query("p18_trend_state", "bars_d", f"SELECT symbol, seq, trend, vol, vol_rank FROM ({_RK})", "vol vol_rank")
def p18(spark, root):
    return keep(P.trend_state(bars_d(spark, root)), "trend", "vol", "vol_rank")


@query("w33_volatility_rank", "bars_d", f"SELECT symbol, seq, vol_rank FROM ({_RK}) WHERE vol IS NOT NULL", "vol_rank")
def w33(spark, root):
    return keep(P.trend_state(bars_d(spark, root)), "vol_rank").filter("vol_rank IS NOT NULL")


@query("p19_signals", "bars_d", f"""SELECT symbol, seq, CASE WHEN vol_rank > 0.8 THEN s * 0.5 ELSE s END AS signal FROM (
  SELECT *, CASE WHEN raw * trend < 0 THEN 0 ELSE raw END AS s FROM (SELECT *, CASE WHEN pr > 0.001 THEN 1.0 WHEN pr < -0.001 THEN -1.0 ELSE 0.0 END AS raw FROM (
   SELECT *, -returns AS pr FROM ({_RK}))))""", "signal")
def p19(spark, root):
    return keep(P.trading_signals(P.trend_state(bars_d(spark, root)), -F.col("returns")), F.col("signal").cast("double").alias("signal"))


_FX = {"reversal_top": -1.2, "reversal_bottom": 1.2, "trend_down": -1.0, "trend_up": 1.0}
_P20 = "signal_strength stop_loss take_profit risk_reward"


@query("p20_signal_levels", "patterns", """SELECT symbol, seq, type, st AS signal_type, abs(s) AS signal_strength, price_end * (1 - 2 * wy * volatility) AS stop_loss, price_end * (1 + 3 * wy * volatility) AS take_profit,
  abs((price_end * (1 + 3 * wy * volatility) - price_end) / (price_end - price_end * (1 - 2 * wy * volatility))) AS risk_reward
  FROM (SELECT *, CASE WHEN st LIKE '%BUY%' THEN 1 ELSE -1 END AS wy FROM (
   SELECT *, CASE WHEN s > 0.7 THEN 'STRONG_BUY' WHEN s > 0.3 THEN 'BUY' WHEN s < -0.7 THEN 'STRONG_SELL' WHEN s < -0.3 THEN 'SELL' ELSE 'HOLD' END AS st FROM (
   SELECT *, strength * CASE type WHEN 'reversal_top' THEN -1.2 WHEN 'reversal_bottom' THEN 1.2 WHEN 'trend_down' THEN -1 ELSE 1 END AS s FROM patterns)))""", _P20, d=4)
def p20(spark, root):
    d = P.signal_levels(D.patterns(spark, root), "type", "strength", "price_end", "volatility", _FX)
    return keep(d, "type", "signal_type", *_P20.split())


@query("p21_insight_tags", "predictions", """WITH s AS (SELECT symbol, pred, skewness(y_true) AS g, kurtosis_pop(y_true) AS k, avg(CAST(pred = actual AS INT)) AS acc, avg(CAST(up AS INT)) AS hit, count(*) AS n,
   avg(y_true / y_pred - 1) AS trend, sqrt(count(*)) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) / sqrt(count(*)) AS f FROM predictions GROUP BY symbol, pred HAVING count(*) > 3)
  SELECT symbol, pred, n, CASE WHEN sc < 0.3 THEN 'Simple' WHEN sc < 0.6 THEN 'Moderate' ELSE 'Complex' END AS complexity, concat_ws('|', CASE WHEN trend > 0.02 THEN 'Strong upward trend detected' WHEN trend < -0.02 THEN 'Strong downward trend detected' END,
   CASE WHEN acc > 0.8 THEN 'High prediction reliability' END, CASE WHEN n > 20 THEN 'Frequently occurring pattern' END) AS tags,
   CASE WHEN acc > 0.7 AND hit > 0.6 THEN 'Consider trading this pattern with appropriate risk management' ELSE 'Monitor pattern but wait for improved metrics before trading' END AS advice
  FROM (SELECT *, 0.3 * abs(g * f) + 0.3 * abs(k) + 0.4 * acc AS sc FROM s)""")
def p21(spark, root):
    s = D.predictions(spark, root).groupBy("symbol", "pred").agg(
        F.skewness("y_true").alias("g"), F.kurtosis("y_true").alias("k"), F.avg((F.col("pred") == F.col("actual")).cast("int")).alias("acc"),
        F.avg(F.col("up").cast("int")).alias("hit"), F.count(F.lit(1)).alias("n"), F.avg(P.ratio(F.col("y_true"), F.col("y_pred")) - 1).alias("trend")).filter("n > 3")
    return s.select("symbol", "pred", "n", P.complexity(F.col("g"), F.col("k") + 3, F.col("acc")).alias("complexity"),
                    F.array_join(P.insight_tags(F.col("trend"), F.col("acc"), F.col("n")), "|").alias("tags"), P.recommendation(F.col("acc"), F.col("hit")).alias("advice"))

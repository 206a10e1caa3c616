"""Aggregation queries."""

from pyspark.sql import functions as F

from tapeline.functions.frames import rolled
from tapeline.operators import aggregates as A
from tapeline.operators import projections as P
from tapeline.plans.p_projections import _RK
from tapeline.plans.registry import query
from tapeline.plans.w_indicators import W
from tapeline.sources import derived as D
from tapeline.sources.tables import DAY, bars_b, bars_d, epoch, series, table, ticks_u

TYPES5 = "('trend_up'), ('trend_down'), ('reversal_top'), ('reversal_bottom'), ('consolidation')"
EVENTS = ["click", "error", "purchase", "signup", "view"]


@query("a01_type_statistics", "patterns", f"""SELECT t.type, count(p.type) AS count, coalesce(avg(strength), 0) AS avg_strength, coalesce(avg(price_change), 0) AS avg_price_change,
  coalesce(avg(volatility), 0) AS avg_volatility, count(p.type) / (SELECT count(*) FROM patterns) AS frequency FROM (VALUES {TYPES5}) t(type) LEFT JOIN patterns p USING (type) GROUP BY t.type""",
       "avg_strength avg_price_change avg_volatility frequency")
def a01(spark, root):
    return A.type_statistics(D.patterns(spark, root))


@query("a02_frequency", "patterns", """SELECT symbol, type, day, week, month, count(*) AS n FROM (SELECT symbol, type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week,
  CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM patterns) GROUP BY GROUPING SETS ((symbol), (type), (symbol, type), (day), (week), (month))""")
def a02(spark, root):
    return A.frequency_analysis(D.patterns(spark, root))


_Q = "avg(y_true) AS mean, stddev_samp(y_true) AS std, quantile_cont(y_true, 0.25) AS q1, quantile_cont(y_true, 0.5) AS median, quantile_cont(y_true, 0.75) AS q3 FROM predictions"


@query("a03_quality", "predictions", f"SELECT 'all' AS dim, 'all' AS key, {_Q} UNION ALL SELECT 'model', model, {_Q} GROUP BY model UNION ALL SELECT 'symbol', CAST(symbol AS VARCHAR), {_Q} GROUP BY symbol", "mean std q1 median q3")
def a03(spark, root):
    return A.quality_analysis(D.predictions(spark, root), "y_true", ["model", "symbol"])


def cut_sql(x, lo, hi, bins):
    return f"CAST(greatest(0, least({bins - 1}, ceil(({x} - {lo}) / (({hi} - {lo}) / {bins})) - 1)) AS BIGINT)"


@query("a03_histogram", "predictions", f"SELECT {cut_sql('y_true', 'lo', 'hi', 10)} AS bin, count(*) AS n FROM predictions, (SELECT min(y_true) AS lo, max(y_true) AS hi FROM predictions) GROUP BY 1")
def a03h(spark, root):
    return A.histogram(D.predictions(spark, root), "y_true")


@query("a04_direction_accuracy", "predictions", f"""WITH d AS (SELECT model, CAST(prob > 0.5 AS INT) AS p, CAST(up AS INT) AS a, {cut_sql('prob', 'lo', 'hi', 5)} AS bin FROM predictions, (SELECT min(prob) AS lo, max(prob) AS hi FROM predictions))
  SELECT 'overall' AS section, 'all' AS key, avg(CAST(a = p AS DOUBLE)) AS value FROM d UNION ALL SELECT 'type', model, avg(CAST(a = p AS DOUBLE)) FROM d GROUP BY model
  UNION ALL SELECT 'quality_bin', CAST(bin AS VARCHAR), avg(CAST(a = p AS DOUBLE)) FROM d GROUP BY bin UNION ALL SELECT 'confusion', a || '>' || p, count(*) FROM d GROUP BY a, p""", "value")
def a04(spark, root):
    return A.direction_accuracy(D.predictions(spark, root), F.col("prob") > 0.5, F.col("up"), "model", "prob")


_A5 = "avg_return volatility sharpe max_drawdown win_rate avg_win avg_loss profit_factor var_95 cvar_95"


@query("a05_group_risk", "trades", """WITH d AS (SELECT reason, net_return AS r, row_number() OVER (PARTITION BY reason ORDER BY entry_ts, symbol, entry_seq) AS k FROM trades),
  c AS (SELECT *, sum(r) OVER (PARTITION BY reason ORDER BY k) AS cum FROM d), m AS (SELECT *, max(cum) OVER (PARTITION BY reason ORDER BY k) - cum AS dd FROM c),
  q AS (SELECT reason, quantile_cont(r, 0.05) AS v FROM d GROUP BY reason)
  SELECT reason, avg(r) AS avg_return, stddev_samp(r) AS volatility, avg(r) / stddev_samp(r) AS sharpe, max(dd) AS max_drawdown, avg(CAST(r > 0 AS DOUBLE)) AS win_rate,
   coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r < 0), 0) AS avg_loss, abs(sum(r) FILTER (r > 0) / sum(r) FILTER (r < 0)) AS profit_factor,
   any_value(v) AS var_95, avg(r) FILTER (r <= v) AS cvar_95 FROM m JOIN q USING (reason) GROUP BY reason""", _A5)
def a05(spark, root):
    t = D.trades(spark, root)
    return A.group_risk(t, "reason", "net_return", ["entry_ts", "symbol", "entry_seq"], F.floor(epoch("entry_ts") / (DAY * 256)))


@query("a06_summary", "predictions", """SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, count(DISTINCT model) AS models, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (prob > 0.8) AS high_quality,
  count(*) FILTER (prob < 0.2) AS low_quality, avg(prob) AS mean_quality, avg(CAST(pred = actual AS DOUBLE)) AS accuracy FROM predictions""", "mean_quality accuracy")
def a06(spark, root):
    return D.predictions(spark, root).agg(
        A.one().alias("n"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("model").alias("models"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(F.col("prob") > 0.8).alias("high_quality"), F.count_if(F.col("prob") < 0.2).alias("low_quality"), F.avg("prob").alias("mean_quality"),
        A.share(F.col("pred") == F.col("actual")).alias("accuracy"))


@query("a07_symbol_statistics", "patterns", "SELECT symbol, count(*) AS n, avg(strength) AS avg_strength, count(DISTINCT type) AS types FROM patterns GROUP BY symbol", "avg_strength")
def a07(spark, root):
    return D.patterns(spark, root).groupBy("symbol").agg(A.one().alias("n"), F.avg("strength").alias("avg_strength"), F.countDistinct("type").alias("types"))


@query("a08_counts_over_time", "", "SELECT event_type, day, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS cumulative FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def a08(spark, root):
    return A.counts_over_time(table(spark, root, "events"), "event_type", "ts")


@query("a09_pivot_mean", "predictions", "SELECT symbol, " + ", ".join(f"avg(prob) FILTER (model = '{e}') AS \"{e}\"" for e in EVENTS) + " FROM predictions GROUP BY symbol", " ".join(EVENTS))
def a09(spark, root):
    return A.pivot_mean(D.predictions(spark, root), "symbol", "model", EVENTS, "prob")


@query("a10_cooccurrence", "", "WITH p AS (SELECT date_trunc('hour', ts) AS t, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in EVENTS) + " FROM events GROUP BY 1) "
       + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM p" for a in EVENTS for b in EVENTS), "corr")
def a10(spark, root):
    return A.cooccurrence(table(spark, root, "events"), "event_type", EVENTS, "ts")


@query("a11_durations", "trades", """SELECT reason, count(*) AS n, avg(h) AS mean, min(h) AS lo, max(h) AS hi, quantile_cont(h, 0.25) AS q1, quantile_cont(h, 0.5) AS median, quantile_cont(h, 0.75) AS q3
  FROM (SELECT reason, (epoch(b.ts) - epoch(entry_ts)) / 3600 AS h FROM trades t JOIN bars_d b ON b.symbol = t.symbol AND b.seq = t.exit_seq) GROUP BY reason""", "mean lo hi q1 median q3")
def a11(spark, root):
    ends = bars_d(spark, root).select("symbol", F.col("seq").alias("exit_seq"), F.col("ts").alias("exit_ts"))
    t = D.trades(spark, root).select("symbol", "exit_seq", "entry_ts", "reason").join(ends, ["symbol", "exit_seq"])
    return A.duration_by_type(t, "reason", F.col("entry_ts"), F.col("exit_ts"))


_M = " ".join(f"m{m}" for m in range(1, 13))


@query("a12_monthly_returns", "returns_p", "SELECT symbol, CAST(year(ts) AS INT) AS year, " + ", ".join(f"product(1 + r) FILTER (month(ts) = {m}) - 1 AS m{m}" for m in range(1, 13)) + " FROM returns_p GROUP BY 1, 2", _M)
def a12(spark, root):
    return A.monthly_returns(D.returns_p(spark, root))


@query("a13_exposure", "bars_d", f"""SELECT symbol, avg(CAST(s <> 0 AS DOUBLE)) AS exposure, avg(abs(s)) AS mean_size FROM (SELECT symbol, CASE WHEN vol_rank > 0.8 THEN s * 0.5 ELSE s END AS s FROM (
  SELECT *, CASE WHEN raw * trend < 0 THEN 0 ELSE raw END AS s FROM (SELECT *, CASE WHEN -returns > 0.001 THEN 1.0 WHEN -returns < -0.001 THEN -1.0 ELSE 0.0 END AS raw FROM ({_RK})))) GROUP BY symbol""", "exposure mean_size")
def a13(spark, root):
    s = P.trading_signals(P.trend_state(bars_d(spark, root)), -F.col("returns"))
    return s.groupBy("symbol").agg(A.share(F.col("signal") != 0).alias("exposure"), F.avg(F.abs("signal")).alias("mean_size"))


@query("a30_autocorrelation", "bars_d", "WITH c AS (SELECT symbol, seq, close - avg(close) OVER (PARTITION BY symbol) AS x FROM bars_d) SELECT a.symbol, k AS lag, sum(a.x * b.x) / any_value(v.v) AS acf FROM c a, range(20) t(k), c b, (SELECT symbol, sum(x * x) AS v FROM c GROUP BY symbol) v WHERE b.symbol = a.symbol AND b.seq = a.seq + k AND v.symbol = a.symbol GROUP BY 1, 2", "acf")
def a30(spark, root):
    d = A.autocorrelation(bars_d(spark, root), "close")
    return d.withColumn("lag", F.col("lag").cast("long"))


_CC = ["open", "high", "low", "close", "volume"]


@query("a31_correlation_pruning", "bars_b", "WITH c AS (SELECT " + ", ".join(f"abs(corr({_CC[i]}, {_CC[j]})) AS c{i}{j}" for i in range(5) for j in range(i + 1, 5)) + " FROM bars_b) "
       + " UNION ALL ".join(f"SELECT '{_CC[i]}' AS feature, " + (" OR ".join(f"c{i}{j} > 0.8" for j in range(i + 1, 5)) or "FALSE") + " AS removed FROM c" for i in range(5)))
def a31(spark, root):
    return A.correlated_columns(bars_b(spark, root), _CC, 0.8)


_LONG = "l AS (SELECT id, label, k - 1 AS feature, v[k] AS x FROM series, range(1, 65) t(k))"


@query("a32_f_score", "series", f"""WITH {_LONG}, g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY 1, 2),
  f AS (SELECT feature, ((sum(n * m * m) - sum(n) * (sum(n * m) / sum(n)) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g GROUP BY 1)
  SELECT feature, f, f / (SELECT max(f) FROM f) AS score FROM f""", "f score")
def a32(spark, root):
    return A.f_score(A.long_features(series(spark, root))).withColumn("feature", F.col("feature").cast("long"))


@query("a33_mutual_information", "series", f"""WITH {_LONG}, b AS (SELECT feature, label, CAST(floor((rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 10 / count(*) OVER (PARTITION BY feature)) AS BIGINT) AS bin FROM l),
  c AS (SELECT feature, label, bin, count(*) AS n, sum(count(*)) OVER (PARTITION BY feature, bin) AS na, sum(count(*)) OVER (PARTITION BY feature, label) AS nb, sum(count(*)) OVER (PARTITION BY feature) AS t FROM b GROUP BY feature, label, bin),
  m AS (SELECT feature, sum(n / t * ln(n * t / (na * nb)::DOUBLE)) AS mi FROM c GROUP BY feature) SELECT feature, mi, mi / (SELECT max(mi) FROM m) AS score FROM m""", "mi score")
def a33(spark, root):
    return A.mutual_information(A.long_features(series(spark, root))).withColumn("feature", F.col("feature").cast("long"))


@query("a37_prediction_log", "predictions", """SELECT model, count(*) AS n, avg(prob) AS mean_confidence, max(ts) AS last_seen, avg(prob) FILTER (k <= 10) AS recent_confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts DESC, id DESC) AS k FROM predictions) GROUP BY model""", "mean_confidence recent_confidence")
def a37(spark, root):
    return A.prediction_log(D.predictions(spark, root))


@query("a38_position_band", "series", "SELECT label, k - 1 AS pos, avg(v[k]) AS mean, stddev_pop(v[k]) AS std FROM series, range(1, 65) t(k) GROUP BY 1, 2", "mean std")
def a38(spark, root):
    return A.position_band(series(spark, root)).withColumn("pos", F.col("pos").cast("long"))

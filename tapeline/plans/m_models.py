"""Clustering, regime and model queries."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.operators import aggregates as A
from tapeline.operators import learned as ML
from tapeline.operators import linkage as LK
from tapeline.operators import regimes as R
from tapeline.operators import transitions as T
from tapeline.plans.a_transitions import states
from tapeline.plans.r_reports import dret
from tapeline.plans.registry import cte, query
from tapeline.plans.w_indicators import TR, W, g, keep, rsi_sql
from tapeline.sources import derived as D
from tapeline.sources.tables import bars_b, bars_d, series, table


def embedded(spark, root):
    s = series(spark, root)
    return s.select("id", "label", "v", array_to_vector("v").alias("features"))


@query("m01_kmeans")
def m01(spark, root):
    d = R.kmeans(R.scaled(embedded(spark, root)), 5)
    return d.groupBy("cluster").agg(A.one().alias("n"), F.first("inertia").alias("inertia"))


@query("m01_elbow")
def m01_elbow(spark, root):
    return R.elbow(R.scaled(embedded(spark, root)), range(2, 9))


@query("m04_bisecting")
def m04(spark, root):
    return R.bisecting(R.scaled(embedded(spark, root)), 5).groupBy("cluster").agg(A.one().alias("n"))


#: distance of the cut
NEAR = 1.1
_NEAR = f"near_links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM series a JOIN series b ON a.id <> b.id AND list_distance(a.v, b.v) <= {NEAR}), reach AS (SELECT id, id AS at_ FROM series UNION SELECT reach.id, b FROM reach JOIN near_links ON a = at_)"


@query("m04_linkage", "series", f"WITH RECURSIVE {_NEAR} SELECT id AS node, min(at_) AS cluster FROM reach GROUP BY id")
def m04_linkage(spark, root):
    s = store(series(spark, root).select("id", "v"))
    return LK.single_linkage(s.select(F.col("id").alias("node")), LK.close_pairs(s, NEAR, forest=True), distance=NEAR)


@query("m04_clusters")
def m04_clusters(spark, root):
    s = store(series(spark, root).select("id", "v"))
    return LK.single_linkage(s.select(F.col("id").alias("node")), LK.close_pairs(s, 1.25, forest=True), clusters=8)


_M5 = "mean std skew down_share relative_volume position range rsi atr_ratio sma_gap"


@query("m05_regime_features", "bars_b", f"""SELECT symbol, seq, {g('avg', 'r', 20)} AS mean, {g('stddev_samp', 'r', 20)} AS std, {g('skewness', 'r', 20)} AS skew, {g('avg', 'dn', 20)} AS down_share, volume / ({g('avg', 'volume', 20)}) AS relative_volume,
  (close - ({g('min', 'close', 20)})) / nullif(({g('max', 'close', 20)}) - ({g('min', 'close', 20)}), 0) AS position, (({g('max', 'close', 20)}) - ({g('min', 'close', 20)})) / ({g('avg', 'close', 20)}) AS range, {rsi_sql(14)} AS rsi, ({g('avg', 'tr', 14)}) / close AS atr_ratio,
  ({g('avg', 'close', 20)}) / ({g('avg', 'close', 50)}) - 1 AS sma_gap FROM (SELECT *, close / pc - 1 AS r, CAST(close / pc - 1 < 0 AS DOUBLE) AS dn, greatest(close - pc, 0) AS gain0, CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss FROM ({TR.format(t='bars_b')}))""", _M5)
def m05(spark, root):
    return R.regime_features(bars_b(spark, root))


@query("m06_mixture_regimes")
def m06(spark, root):
    d = R.regime_features(bars_b(spark, root)).dropna()
    v = R.scaled(R.vectors(d, ["mean", "std", "down_share", "position"]))
    m = R.mixture(v, 4)
    return m.groupBy("regime").agg(A.one().alias("n"), *[F.avg(c).alias(c) for c in ("mean", "std", "down_share", "position")], F.avg(F.array_max("probability")).alias("certainty"))


@query("m07_regime_transitions", "regimes", f"""SELECT f AS "from", t AS "to", n, n / sum(n) OVER (PARTITION BY f) AS p FROM (SELECT f, t, count(*) AS n FROM (SELECT regime AS f, lead(regime) OVER w AS t FROM regimes {W}) WHERE t IS NOT NULL GROUP BY ALL)""", "p")
def m07(spark, root):
    return T.empirical_matrix(D.regimes(spark, root).select("symbol", "seq", F.col("regime").alias("state")))


cte("rule", f"""SELECT symbol, CASE WHEN s20 < s * 0.7 THEN 'low' WHEN s20 > s * 1.3 THEN 'high' ELSE 'medium' END AS volatility_level, CASE WHEN px > a20 AND a20 > a50 THEN 'bullish' WHEN px < a20 AND a20 < a50 THEN 'bearish' ELSE 'neutral' END AS trend_direction,
  CASE WHEN rng < bar * 2 THEN 'ranging' WHEN abs(m5) > s * 2 THEN 'breakout' WHEN m10 * m5 < 0 THEN 'reversal' ELSE 'trending' END AS market_state FROM (SELECT symbol, stddev_samp(r) FILTER (age < 99) AS s, stddev_samp(r) FILTER (age < 20) AS s20, avg(close) FILTER (age < 20) AS a20,
   avg(close) FILTER (age < 50) AS a50, arg_max(close, seq) AS px, max(high) - min(low) AS rng, avg(high - low) AS bar, avg(r) FILTER (age < 5) AS m5, avg(r) FILTER (age < 10) AS m10 FROM (
   SELECT *, close / lag(close) OVER w - 1 AS r, max(seq) OVER (PARTITION BY symbol) - seq AS age FROM bars_b {W}) WHERE age < 100 GROUP BY symbol)""", "bars_b")


@query("m08_rule_regime", "rule", "SELECT * FROM rule")
def m08(spark, root):
    return R.rule_regime(bars_b(spark, root))


@query("m09_regime_performance", "regimes", """SELECT regime, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(r) / stddev_samp(r) AS sharpe, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r < 0), 0) AS avg_loss,
  count(*) / (SELECT count(*) FROM regimes WHERE r IS NOT NULL) AS share FROM regimes WHERE r IS NOT NULL GROUP BY regime""", "mean std sharpe win_rate avg_win avg_loss share")
def m09(spark, root):
    return R.regime_performance(D.regimes(spark, root).filter("r IS NOT NULL"))


@query("m10_strategy_parameters", "rule", """SELECT symbol, CASE market_state WHEN 'breakout' THEN 1.5 WHEN 'reversal' THEN 0.3 ELSE CASE WHEN volatility_level = 'high' THEN 0.5 ELSE 1.0 END END::DOUBLE AS position_size, CASE WHEN market_state = 'reversal' THEN 0.015 WHEN volatility_level = 'high' THEN 0.03 ELSE 0.02 END::DOUBLE AS stop_loss,
  CASE WHEN market_state = 'ranging' THEN 0.02 ELSE 0.04 END::DOUBLE AS take_profit, CASE WHEN market_state = 'trending' THEN 'long' ELSE 'medium' END AS timeframe,
  concat_ws('|', CASE WHEN volatility_level = 'high' THEN 'ATR' END, CASE market_state WHEN 'trending' THEN 'MA_crossover|ADX' WHEN 'ranging' THEN 'RSI|Bollinger_Bands' WHEN 'breakout' THEN 'Volume|Momentum' ELSE 'Divergence|Support_Resistance' END) AS indicators FROM rule""")
def m10(spark, root):
    d = R.strategy_parameters(R.rule_regime(bars_b(spark, root)))
    return d.select("symbol", "position_size", "stop_loss", "take_profit", "timeframe", F.array_join("indicators", "|").alias("indicators"))


@query("m11_volatility_tags", "dret", """SELECT symbol, v AS volatility, q AS recent, CASE WHEN v > 0.25 THEN 'high_volatility' WHEN v < 0.1 THEN 'low_volatility' ELSE 'normal_volatility' END AS market_regime, CASE WHEN q > v * 1.5 THEN 'elevated' WHEN q < v * 0.7 THEN 'compressed' ELSE 'normal' END AS volatility_regime,
  CASE WHEN t > 0.001 THEN 'upward' WHEN t < -0.001 THEN 'downward' ELSE 'sideways' END AS trend FROM (SELECT symbol, stddev_pop(r) * sqrt(252) AS v, stddev_pop(r) FILTER (seq > z - 20) * sqrt(252) AS q, regr_slope(r, seq) AS t FROM (SELECT *, max(seq) OVER (PARTITION BY symbol) AS z FROM dret) GROUP BY symbol)""", "volatility recent")
def m11(spark, root):
    return R.volatility_tags(dret(spark, root))


@query("m12_next_pattern")
def m12(spark, root):
    f = ML.next_pattern_features(D.patterns(spark, root), A.PATTERN_TYPES)
    mid = f.groupBy("symbol").agg((F.max("seq") * 0.8).alias("_cut"))
    f = f.join(mid, "symbol")
    return ML.next_pattern(f.filter("seq < _cut").drop("_cut"), f.filter("seq >= _cut").drop("_cut"))


@query("m13_boosted_folds")
def m13(spark, root):
    d = R.regime_features(bars_d(spark, root)).dropna().withColumn("target", F.col("mean") * 100)
    return ML.boosted_folds(R.vectors(d, ["std", "down_share", "position", "rsi"]), "target", 2, 10)


@query("m14_walk_forward_splits", "bars_b", """WITH n AS (SELECT symbol, count(*) AS n FROM bars_b GROUP BY symbol), f AS (SELECT symbol, unnest(range(0, CAST(floor((n - 315) / 126.0) AS BIGINT) + 1)) AS fold FROM n WHERE n >= 315)
  SELECT symbol, fold, CASE WHEN seq - fold * 126 < 252 THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM bars_b JOIN f USING (symbol) WHERE seq >= fold * 126 AND seq < fold * 126 + 315 GROUP BY ALL""")
def m14(spark, root):
    return R.walk_forward_splits(bars_b(spark, root), 252, 63, 126).groupBy("symbol", "fold", "part").agg(A.one().alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


_ENS = "(SELECT id, 'last' AS model, y_pred AS prediction, 0.5 AS weight FROM predictions UNION ALL SELECT id, 'shrunk', 0.5 * y_pred + 18, 0.3 FROM predictions UNION ALL SELECT id, 'scored', prob * 70, 0.2 FROM predictions)"


def ensemble(spark, root):
    p = D.predictions(spark, root)
    rows = F.array(F.struct(F.lit("last").alias("model"), F.col("y_pred").alias("prediction"), F.lit(0.5).alias("weight")), F.struct(F.lit("shrunk").alias("model"), (0.5 * F.col("y_pred") + 18).alias("prediction"), F.lit(0.3).alias("weight")),
                   F.struct(F.lit("scored").alias("model"), (F.col("prob") * 70).alias("prediction"), F.lit(0.2).alias("weight")))
    return p.select("id", "symbol", "seq", "y_true", F.explode(rows).alias("x")).select("id", "symbol", "seq", "y_true", "x.*")


@query("m15_ensemble", "predictions", f"SELECT id, sum(weight * prediction) / sum(weight) AS weighted_mean, quantile_cont(prediction, 0.5) AS median, arg_max(prediction, abs(prediction)) AS strongest FROM {_ENS} GROUP BY id", "weighted_mean median strongest")
def m15(spark, root):
    return R.combine(ensemble(spark, root), "id")


@query("m15_stacking")
def m15b(spark, root):
    e = ensemble(spark, root).groupBy("id", "y_true").pivot("model", ["last", "shrunk", "scored"]).agg(F.first("prediction"))
    return ML.stacked(e.withColumn("squared", F.col("last") * F.col("last") / 100), ["last", "scored", "squared"], "y_true").select("id", "stacked")


@query("m16_inverse_error_weights", "predictions", """WITH d AS (SELECT symbol, seq, 1 / (avg(abs(y_true - y_pred)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 1e-6) AS w FROM predictions)
  SELECT symbol, seq, w / sum(w) OVER (PARTITION BY seq) AS weight FROM d""", "weight")
def m16(spark, root):
    return R.inverse_error_weights(D.predictions(spark, root).select("symbol", "seq", F.abs(F.col("y_true") - F.col("y_pred")).alias("error")))


@query("m17_weight_search", "predictions", """WITH g AS (SELECT i / 10 AS w1, j / 10 AS w2, (10 - i - j) / 10 AS w3 FROM range(11) a(i), range(11) b(j) WHERE i + j <= 10), s AS (SELECT id, actual, w1, w2, w3, c, w1 * (pred = c)::INT + w2 * (CASE c WHEN 'low' THEN 0.4 WHEN 'mid' THEN 0.35 ELSE 0.25 END)::DOUBLE + w3 * (CASE c WHEN 'high' THEN prob ELSE (1 - prob) / 2 END) AS v
   FROM predictions, g, (VALUES ('low'), ('mid'), ('high')) k(c)) SELECT w1, w2, w3, avg(CAST(best = actual AS DOUBLE)) AS accuracy FROM (SELECT id, any_value(actual) AS actual, w1, w2, w3, max(struct_pack(v := v, c := c)).c AS best FROM s GROUP BY id, w1, w2, w3) GROUP BY ALL""", "w1 w2 w3 accuracy")
def m17(spark, root):
    p = D.predictions(spark, root)
    cls = ["low", "mid", "high"]
    mk = lambda f: F.create_map(*[x for c in cls for x in (F.lit(c), f(c))])
    base = {"low": 0.4, "mid": 0.35, "high": 0.25}
    d = p.select("id", "actual", mk(lambda c: (F.col("pred") == c).cast("double")).alias("s1"), mk(lambda c: F.lit(base[c])).alias("s2"),
                 mk(lambda c: F.col("prob") if c == "high" else (1 - F.col("prob")) / 2).alias("s3"))
    return R.weight_search(d)


@query("m18_forecast_tree", "m1", """WITH t AS (SELECT "from" AS f, "to" AS t, p FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY p DESC, "to") AS k FROM m1) WHERE k <= 3), s AS (SELECT symbol, arg_max(state, seq) AS st FROM states GROUP BY symbol)
  SELECT symbol, a.t || '>' || b.t || '>' || c.t AS path, a.p * b.p * c.p AS probability, a.p * 0.9 * b.p * 0.81 * c.p * 0.729 AS confidence FROM s JOIN t a ON a.f = st JOIN t b ON b.f = a.t JOIN t c ON c.f = b.t""", "probability confidence", d=9)
def m18(spark, root):
    s = states(spark, root)
    now = s.groupBy("symbol").agg(F.max_by("state", "seq").alias("state"))
    return R.forecast_tree(T.transition_matrix(s, 5), now)


_MP = {"trend_up": "flag_bull", "trend_down": "flag_bear", "reversal_top": "double_top", "reversal_bottom": "double_bottom", "consolidation": "triangle_ascending"}


@query("m19_price_projection", "patterns", """WITH p AS (SELECT symbol, seq, price_end AS price, CASE type WHEN 'trend_up' THEN 0.02 WHEN 'trend_down' THEN -0.02 WHEN 'reversal_top' THEN -0.03 WHEN 'reversal_bottom' THEN 0.03 ELSE 0.015 END AS e,
   CASE type WHEN 'trend_up' THEN 'wedge_rising' WHEN 'trend_down' THEN 'wedge_falling' WHEN 'reversal_top' THEN 'flag_bear' WHEN 'reversal_bottom' THEN 'flag_bull' ELSE 'flag_bull' END AS next_pattern FROM patterns)
  SELECT symbol, seq, price + price * e * 3 * 0.9 AS lstm, price + price * e * 3 * 0.95 AS gru, price + price * e * 3 * 1.05 AS transformer, price + price * e * 3 AS ensemble, next_pattern FROM p""", "lstm gru transformer ensemble", d=7)
def m19(spark, root):
    kind = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in _MP.items()])
    p = D.patterns(spark, root).select("symbol", "seq", kind.alias("type"), F.col("price_end").alias("price"))
    return R.price_projection(p, 3).drop("type", "price")


@query("m20_history_confidence", "predictions", """SELECT symbol, seq, CASE WHEN n < 10 THEN 0.5 ELSE greatest(0, least(1, 1 - coalesce(abs(y_pred - m) / nullif(s, 0), 0) / 3)) END AS confidence FROM (SELECT symbol, seq, y_pred, count(*) OVER f AS n, avg(y_pred) OVER f AS m, stddev_pop(y_pred) OVER f AS s FROM predictions
  WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""", "confidence")
def m20(spark, root):
    p = D.predictions(spark, root).select("symbol", "seq", F.col("y_pred").alias("prediction"))
    return keep(R.history_confidence(p), "confidence")


@query("m21_confidence_vote", "predictions", """WITH v AS (SELECT symbol, pred AS label, prob AS confidence, CASE model WHEN 'click' THEN 2.0 ELSE 1.0 END AS weight FROM predictions), s AS (SELECT symbol, label, sum(weight * confidence) / any_value(t) AS score FROM v JOIN (SELECT symbol, sum(weight) AS t FROM v GROUP BY symbol) USING (symbol) GROUP BY symbol, label)
  SELECT symbol, arg_max(label, score) AS winner, max(score) AS score, count(*) FILTER (score > 0.1) AS alternatives FROM s GROUP BY symbol""", "score")
def m21(spark, root):
    v = D.predictions(spark, root).select("symbol", F.col("pred").alias("label"), F.col("prob").alias("confidence"), F.when(F.col("model") == "click", 2.0).otherwise(1.0).alias("weight"))
    return R.confidence_vote(v, "symbol")


@query("m22_projection")
def m22(spark, root):
    d = R.projection(R.scaled(embedded(spark, root)))
    return d.select("id", F.abs("pc1").alias("pc1"), F.abs("pc2").alias("pc2"))


DIMENSIONS = [f"x{i}" for i in range(64)]  # the length of the given vectors


def labelled(spark, root):
    s = series(spark, root)
    return s.select("id", "label", *[F.col("v")[i].alias(n) for i, n in enumerate(DIMENSIONS)])


@query("a34_elimination")
def a34_elimination(spark, root):
    """The eight coordinates that recursive elimination keeps, best first."""
    kept = ML.recursive_elimination(store(labelled(spark, root)), DIMENSIONS, 8)
    return spark.createDataFrame([(i, f) for i, f in enumerate(kept)], "place int, feature string")


@query("a34_forest_importance")
def a34(spark, root):
    return ML.forest_importance(R.vectors(labelled(spark, root), DIMENSIONS), DIMENSIONS)


@query("a35_l1_importance")
def a35(spark, root):
    return ML.l1_importance(R.vectors(labelled(spark, root), DIMENSIONS), DIMENSIONS)

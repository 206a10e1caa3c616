"""Run, region, rolling-risk and sequence window queries; top-k and set queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeline.functions.frames import rmean, rolled
from tapeline.operators import sequences as S
from tapeline.plans.registry import cte, query
from tapeline.plans.w_indicators import W, frame, g, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import bars_b, bars_d, bars_h

cte("strategy", "SELECT symbol, ts, seq - 1 AS seq, 0.02 * lr AS r FROM returns_p", "returns_p")
cte("equity", f"SELECT *, (equity - peak) / peak AS drawdown FROM (SELECT *, max(equity) OVER w AS peak FROM (SELECT *, product(1 + r) OVER w AS equity FROM strategy {W}) {W})", "strategy")


def strategy(spark, root):
    """A 2% allocation to every brand: daily log returns."""
    return D.returns_p(spark, root).select("symbol", "ts", (F.col("seq") - 1).alias("seq"), (0.02 * F.col("lr")).alias("r"))


@query("w19_parabolic_sar", "bars_d", """WITH RECURSIVE e AS (SELECT symbol, seq, TRUE AS bull, 0.02::DOUBLE AS af, high AS ep, close AS sar FROM bars_d WHERE seq = 0 UNION ALL
  SELECT symbol, seq, CASE WHEN x THEN NOT bull ELSE bull END, CASE WHEN x THEN 0.02 WHEN ext THEN least(af + 0.02, 0.2) ELSE af END,
   CASE WHEN x THEN CASE WHEN bull THEN low ELSE high END WHEN ext THEN CASE WHEN bull THEN high ELSE low END ELSE ep END, CASE WHEN x THEN ep ELSE s END
  FROM (SELECT b.symbol, b.seq, e.bull, e.af, e.ep, b.high, b.low, e.sar + e.af * (e.ep - e.sar) AS s,
    CASE WHEN e.bull THEN b.low < e.sar + e.af * (e.ep - e.sar) ELSE b.high > e.sar + e.af * (e.ep - e.sar) END AS x,
    CASE WHEN e.bull THEN b.high > e.ep ELSE b.low < e.ep END AS ext FROM e JOIN bars_d b ON b.symbol = e.symbol AND b.seq = e.seq + 1))
  SELECT symbol, seq, sar AS psar FROM e""", "psar", d=3)
def w19(spark, root):
    return S.parabolic_sar(bars_d(spark, root))


_W24 = "rolling_return rolling_volatility rolling_sharpe rolling_max_drawdown rolling_var"


@query("w24_rolling_risk", "equity", f"""WITH f AS (SELECT symbol, seq, count(*) OVER x AS n, product(1 + r) OVER x - 1 AS t, stddev_samp(r) OVER x * sqrt(252) AS v, quantile_cont(r, 0.05) OVER x AS q, list(equity) OVER x AS a FROM equity
   WINDOW x AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
  d AS (SELECT symbol, seq, max((mx - e) / mx) AS dd FROM (SELECT symbol, seq, e, max(e) OVER (PARTITION BY symbol, seq ORDER BY k) AS mx FROM (SELECT symbol, seq, unnest(a) AS e, generate_subscripts(a, 1) AS k FROM f)) GROUP BY ALL)
  SELECT symbol, seq, CASE WHEN n >= 30 THEN t END AS rolling_return, CASE WHEN n >= 30 THEN v END AS rolling_volatility, CASE WHEN n >= 30 THEN CASE WHEN v = 0 THEN 0 ELSE ((1 + t) ** (252 / n) - 1 - 0.02) / v END END AS rolling_sharpe,
  CASE WHEN n >= 30 THEN dd END AS rolling_max_drawdown, CASE WHEN n >= 30 THEN q END AS rolling_var FROM f JOIN d USING (symbol, seq)""", _W24, d=5)
def w24(spark, root):
    return S.rolling_risk(strategy(spark, root))


@query("w25_equity", "equity", "SELECT symbol, seq, equity, peak, drawdown FROM equity", "equity peak drawdown")
def w25(spark, root):
    return keep(S.equity(strategy(spark, root)), "equity", "peak", "drawdown")


_RUN = "SELECT symbol, run, first(f) AS f, count(*) AS n FROM (SELECT *, sum(chg) OVER w AS run FROM (SELECT *, CASE WHEN lag(f) OVER w <> f THEN 1 ELSE 0 END AS chg FROM ({t}) " + W + ") " + W + ") GROUP BY symbol, run"


@query("w26_streaks", "equity", f"""SELECT * FROM (SELECT symbol, coalesce(max(n) FILTER (f), 0) AS win_streak, coalesce(max(n) FILTER (NOT f), 0) AS loss_streak FROM ({_RUN.format(t='SELECT symbol, seq, r > 0 AS f FROM strategy')}) GROUP BY symbol)
  JOIN (SELECT symbol, coalesce(max(n) FILTER (f), 0) AS underwater FROM ({_RUN.format(t='SELECT symbol, seq, drawdown < 0 AS f FROM equity')}) GROUP BY symbol) USING (symbol)""")
def w26(spark, root):
    s = strategy(spark, root)
    a = S.longest_runs(s, F.col("r") > 0, names=("win_streak", "loss_streak"))
    return a.join(S.longest_runs(S.equity(s), F.col("drawdown") < 0, names=("underwater", "_u")).drop("_u"), "symbol")


@query("w27_regions", "bars_h", f"""SELECT symbol, scale, min(seq) AS start, max(seq) + 1 AS "end", count(*) AS duration FROM (SELECT *, sum(chg) OVER x AS run FROM (SELECT *, CASE WHEN lag(f) OVER x <> f THEN 1 ELSE 0 END AS chg FROM (
   SELECT symbol, 10 AS scale, seq, coalesce(close > ({g('avg', 'close', 10)}), FALSE) AS f FROM bars_h UNION ALL SELECT symbol, 20, seq, coalesce(close > ({g('avg', 'close', 20)}), FALSE) FROM bars_h)
   WINDOW x AS (PARTITION BY symbol, scale ORDER BY seq)) WINDOW x AS (PARTITION BY symbol, scale ORDER BY seq)) WHERE f GROUP BY symbol, scale, run HAVING count(*) >= 3""")
def w27(spark, root):
    c = F.col("close")
    b = rolled(bars_h(spark, root), lambda h, w: h.withColumn("ms", F.array(*[F.struct(F.lit(n).alias("scale"), rmean(c, n, w).alias("m")) for n in (10, 20)])), 20)
    b = b.withColumn("x", F.explode("ms")).select("symbol", "seq", "x.scale", (c > F.col("x.m")).alias("above"))
    return S.regions(b, F.col("above"), 3, ("symbol", "scale"))


_RR = f"""SELECT *, lead(start_ts) OVER (PARTITION BY symbol ORDER BY run) AS next_ts, lead(regime) OVER (PARTITION BY symbol ORDER BY run) AS next_regime FROM (SELECT symbol, run, first(regime) AS regime, min(ts) AS start_ts, count(*) AS bars FROM (SELECT *, sum(chg) OVER w AS run FROM (
   SELECT *, CASE WHEN lag(regime) OVER w <> regime THEN 1 ELSE 0 END AS chg FROM regimes {W}) {W}) GROUP BY symbol, run)"""


@query("w28_change_points", "regimes", f"SELECT symbol, next_ts AS ts, regime AS from_regime, next_regime AS to_regime, date_diff('day', start_ts, next_ts) AS duration_days FROM ({_RR}) WHERE next_ts IS NOT NULL AND date_diff('day', start_ts, next_ts) >= 3")
def w28(spark, root):
    return S.change_points(D.regimes(spark, root), 3).withColumn("duration_days", F.col("duration_days").cast("long"))


@query("w28_persistence", "regimes", f"""SELECT symbol, regime, avg(d) AS avg_days, max(d) AS max_days, min(d) AS min_days, stddev_pop(d) AS std_days, count(*) AS occurrences, quantile_cont(d, 0.5) AS median_days
  FROM (SELECT symbol, regime, CAST(date_diff('day', start_ts, next_ts) AS INT) AS d FROM ({_RR}) WHERE next_ts IS NOT NULL) GROUP BY symbol, regime""", "avg_days std_days median_days")
def w28b(spark, root):
    return S.persistence(D.regimes(spark, root))


@query("w28_current_age", "regimes", f"SELECT symbol, regime, bars AS age FROM ({_RR}) WHERE next_ts IS NULL")
def w28c(spark, root):
    return S.current_age(D.regimes(spark, root))


@query("w30_ngrams", "patterns", "SELECT symbol, seq, array_to_string(gr, '>') AS gram FROM (SELECT symbol, seq, list(type) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gr FROM patterns) WHERE len(gr) = 5")
def w30(spark, root):
    return keep(S.ngrams(D.patterns(spark, root)), F.array_join("gram", ">").alias("gram"))


@query("w31_rolling_accuracy", "predictions", """SELECT symbol, seq, avg(CAST(pred = actual AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hit_rate,
  CASE WHEN count(*) OVER f = 10 THEN avg(CAST((prob > 0.5) = up AS DOUBLE)) OVER f END AS sign_agreement FROM predictions WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "hit_rate sign_agreement")
def w31(spark, root):
    return S.rolling_accuracy(D.predictions(spark, root), F.col("pred") == F.col("actual"), (F.col("prob") > 0.5) == F.col("up"))


@query("w32_exponential_moments", "strategy", """WITH d AS (SELECT symbol, r, 0.5 ** ((max(seq) OVER (PARTITION BY symbol) - seq) / 60) AS w FROM strategy), m AS (SELECT symbol, sum(w * r) / sum(w) AS m FROM d GROUP BY symbol)
  SELECT symbol, any_value(m) * 252 AS exp_mean, sum(w * (r - m) ** 2) / sum(w) * sum(w) ** 2 / (sum(w) ** 2 - sum(w * w)) * 252 AS exp_var FROM d JOIN m USING (symbol) GROUP BY symbol""", "exp_mean exp_var")
def w32(spark, root):
    return S.exponential_moments(strategy(spark, root))


@query("w34_training_sequences", "patterns", f"""WITH s AS (SELECT symbol, seq, list(price_change) OVER f AS x, list(type) OVER f AS t FROM patterns WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
  v AS (SELECT symbol, stddev_samp(r) AS symbol_volatility FROM (SELECT symbol, close / lag(close) OVER w - 1 AS r FROM bars_d {W}) GROUP BY symbol),
  e AS (SELECT symbol, seq, array_to_string(t, '>') AS types, list_sum([i * i for i in x]) AS energy, list_max([abs(i) for i in x]) AS max_abs, list_avg(x) AS m, x FROM s WHERE len(x) = 15),
  k AS (SELECT *, list_avg([(i - m) ** 2 for i in x]) AS m2, list_avg([(i - m) ** 3 for i in x]) AS m3, list_avg([(i - m) ** 4 for i in x]) AS m4 FROM e)
  SELECT symbol, seq, types, max_abs, energy, -list_sum([i * i / energy * log2(i * i / energy + 1e-10) for i in x]) AS entropy, m3 / m2 ** 1.5 AS skew, m4 / m2 ** 2 - 3 AS kurt, symbol_volatility FROM k JOIN v USING (symbol)""",
       "max_abs energy entropy skew kurt symbol_volatility")
def w34(spark, root):
    return S.training_sequences(D.patterns(spark, root), bars_d(spark, root))

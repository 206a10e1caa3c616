"""Risk, portfolio, backtest and evaluation queries."""

from pyspark.sql import functions as F

from tapeline.functions.frames import number_rows, rolled
from tapeline.functions.lineage import store
from tapeline.operators import joins as J
from tapeline.operators import panel as PN
from tapeline.operators import risk as R
from tapeline.plans.registry import cte, query
from tapeline.plans.derived_sql import touch_sql
from tapeline.plans.w_indicators import W, keep
from tapeline.plans.w_sequences import strategy
from tapeline.sources import derived as D
from tapeline.sources.tables import DAY, bars_b, bars_d, epoch, table, ticks_u

RM = "total_return annual_return volatility downside_volatility sharpe_ratio sortino_ratio calmar_ratio recovery_factor max_drawdown average_drawdown value_at_risk cvar skewness kurtosis tail_ratio omega_ratio"


def rm_sql(src, by):
    """Risk metric set in SQL over a table expression with (by, seq, r)."""
    p = f"PARTITION BY {by}"
    return f"""WITH s AS MATERIALIZED (SELECT * FROM ({src})), e AS (SELECT *, product(1 + r) OVER ({p} ORDER BY seq) AS eq FROM s), f AS (SELECT *, (eq - max(eq) OVER ({p} ORDER BY seq)) / max(eq) OVER ({p} ORDER BY seq) AS dd FROM e),
  u AS (SELECT {by}, coalesce(max(n) FILTER (u), 0) AS dur FROM (SELECT {by}, run, first(dd < 0) AS u, count(*) AS n FROM (SELECT *, sum(chg) OVER ({p} ORDER BY seq) AS run FROM (
    SELECT *, CASE WHEN lag(dd < 0) OVER ({p} ORDER BY seq) <> (dd < 0) THEN 1 ELSE 0 END AS chg FROM f)) GROUP BY {by}, run) GROUP BY {by}),
  q AS (SELECT {by}, quantile_cont(r, 0.05) AS v, quantile_cont(r, 0.95) AS q95 FROM s GROUP BY {by}),
  g AS (SELECT {by}, count(*) AS n, product(1 + r) - 1 AS t, stddev_pop(r) * sqrt(252) AS vol, coalesce(stddev_pop(r) FILTER (r < 0) * sqrt(252), 0) AS dv, skewness(r) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS sk, kurtosis_pop(r) AS ku,
    sum(r) FILTER (r > 0) / -sum(r) FILTER (r <= 0) AS om, abs(min(dd)) AS md, coalesce(abs(avg(dd) FILTER (dd < 0)), 0) AS ad, any_value(v) AS v, any_value(q95) AS q95, avg(r) FILTER (r <= v) AS cv FROM f JOIN q USING ({by}) GROUP BY {by}),
  h AS (SELECT *, (1 + t) ** (252 / n) - 1 AS a FROM g)
  SELECT {by}, n, t AS total_return, a AS annual_return, vol AS volatility, dv AS downside_volatility, (a - 0.02) / vol AS sharpe_ratio, CASE WHEN dv = 0 THEN 0 ELSE (a - 0.02) / dv END AS sortino_ratio, a / md AS calmar_ratio, t / md AS recovery_factor,
   md AS max_drawdown, ad AS average_drawdown, dur AS max_drawdown_duration, v AS value_at_risk, cv AS cvar, sk AS skewness, ku AS kurtosis, q95 / abs(v) AS tail_ratio, om AS omega_ratio FROM h JOIN u USING ({by})"""


@query("r01_risk_metrics", "strategy", rm_sql("SELECT * FROM strategy", "symbol"), RM)
def r01(spark, root):
    return R.risk_metrics(strategy(spark, root))


@query("r02_benchmark_metrics", "strategy", """WITH j AS (SELECT s.symbol, r, b FROM strategy s JOIN (SELECT ts, avg(r) AS b FROM strategy GROUP BY ts) USING (ts)),
  g AS (SELECT symbol, product(1 + r - b) ** (252 / count(*)) - 1 AS aa, stddev_pop(r - b) * sqrt(252) AS te, covar_samp(r, b) / var_pop(b) AS beta, product(1 + r) ** (252 / count(*)) - 1 AS ar, product(1 + b) ** (252 / count(*)) - 1 AS ab FROM j GROUP BY symbol)
  SELECT symbol, aa / te AS information_ratio, beta, ar - (0.02 + beta * (ab - 0.02)) AS alpha FROM g""", "information_ratio beta alpha")
def r02(spark, root):
    s = strategy(spark, root)
    return R.benchmark_metrics(s, s.groupBy("ts").agg(F.avg("r").alias("bench")))


_R3 = "win_rate profit_factor expectancy avg_win avg_loss kelly"


@query("r03_trade_statistics", "trades", """SELECT symbol, n AS trades, wr AS win_rate, pf AS profit_factor, wr * aw + (1 - wr) * l AS expectancy, aw AS avg_win, abs(l) AS avg_loss,
  CASE WHEN l = 0 THEN 0 ELSE coalesce(least(greatest((wr * (aw / abs(l)) - (1 - wr)) / nullif(aw / abs(l), 0), 0), 0.25), 0) END AS kelly FROM (SELECT symbol, count(*) AS n, avg(CAST(net_return > 0 AS DOUBLE)) AS wr,
   sum(net_return) FILTER (net_return > 0) / abs(sum(net_return) FILTER (net_return < 0)) AS pf, coalesce(avg(net_return) FILTER (net_return > 0), 0) AS aw, coalesce(avg(net_return) FILTER (net_return < 0), 0) AS l FROM trades GROUP BY symbol)""", _R3)
def r03(spark, root):
    return R.trade_statistics(D.trades(spark, root), ["symbol"], "net_return")


_R4 = "var_95 var_99 cvar_95 cvar_99 max_drawdown sharpe_ratio sortino_ratio calmar_ratio"


@query("r04_dual_var", "equity", f"""WITH g AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s1, stddev_samp(r) FILTER (r < 0) AS ds, least(avg(r) - {R.Z95} * stddev_pop(r), quantile_cont(r, 0.05)) AS v95, least(avg(r) - {R.Z99} * stddev_pop(r), quantile_cont(r, 0.01)) AS v99,
   abs(min(drawdown)) AS md FROM equity GROUP BY symbol) SELECT symbol, abs(any_value(v95)) AS var_95, abs(any_value(v99)) AS var_99, abs(coalesce(avg(r) FILTER (r <= v95), any_value(v95))) AS cvar_95, abs(coalesce(avg(r) FILTER (r <= v99), any_value(v99))) AS cvar_99,
   any_value(md) AS max_drawdown, any_value(m / s1 * sqrt(252)) AS sharpe_ratio, any_value(m / ds * sqrt(252)) AS sortino_ratio, any_value(m * 252 / md) AS calmar_ratio FROM strategy JOIN g USING (symbol) GROUP BY symbol""", _R4)
def r04(spark, root):
    return R.dual_var(strategy(spark, root))


_SC = ", ".join(f"('{k}', '{v[0]}', {v[1]})" for k, v in R.SCENARIOS.items())
_R5 = "total_return max_drawdown sharpe_ratio var_95 cvar_95"


@query("r05_stress", "strategy", "SELECT symbol, scenario, total_return, max_drawdown, sharpe_ratio, value_at_risk AS var_95, cvar AS cvar_95 FROM (" + rm_sql(
    f"SELECT symbol, scenario, seq, CAST(CASE WHEN kind = 'scale' THEN r * size WHEN seq = n // 2 THEN size ELSE r END AS DOUBLE) AS r FROM strategy JOIN (SELECT symbol, count(*) AS n FROM strategy GROUP BY symbol) USING (symbol), (VALUES {_SC}) v(scenario, kind, size)", "symbol, scenario") + ")", _R5)
def r05(spark, root):
    return R.stress(strategy(spark, root))


cte("weights", "SELECT symbol, sum(volume) / sum(sum(volume)) OVER () AS weight FROM bars_b GROUP BY symbol", "bars_b")
cte("pret", "SELECT ts, sum(r * weight) AS r FROM strategy JOIN weights USING (symbol) GROUP BY ts", "strategy weights")


def weights(spark, root):
    v = bars_b(spark, root).groupBy("symbol").agg(F.sum("volume").alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("v").alias("t")))).select("symbol", (F.col("v") / F.col("t")).alias("weight"))


_R5B = "historical_worst market_crash high_volatility correlation_breakdown"


@query("r05_portfolio_stress", "pret", """SELECT (SELECT avg(r) FROM (SELECT r FROM pret ORDER BY r LIMIT 5)) AS historical_worst, (SELECT sum(weight) * -0.20 FROM weights) AS market_crash, (SELECT stddev_samp(r) * -4 FROM pret) AS high_volatility,
  (SELECT avg(m) FROM (SELECT min(r) AS m FROM strategy GROUP BY symbol)) AS correlation_breakdown""", _R5B)
def r05b(spark, root):
    return R.portfolio_stress(strategy(spark, root), weights(spark, root))


@query("k03_worst_days", "pret", "SELECT avg(r) AS worst FROM (SELECT r FROM pret ORDER BY r LIMIT 5)", "worst", d=8)
def k03(spark, root):
    return R.worst_days(R.portfolio_returns(strategy(spark, root), weights(spark, root)))


cte("cov", "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, covar_samp(x.r, y.r) * 252 AS cov, corr(x.r, y.r) AS corr FROM strategy x JOIN strategy y ON x.ts = y.ts GROUP BY ALL", "strategy")


@query("r06_risk_contribution", "cov weights", """WITH c AS (SELECT a AS symbol, sum(cov * weight) AS cw FROM cov JOIN weights ON b = symbol GROUP BY a), v AS (SELECT sqrt(sum(weight * cw)) AS pv FROM c JOIN weights USING (symbol))
  SELECT symbol, weight, cw / pv AS marginal, weight * cw / pv AS component, weight * cw / pv / pv AS percent, pv AS portfolio_volatility FROM c JOIN weights USING (symbol), v""", "weight marginal component percent portfolio_volatility", d=8)
def r06(spark, root):
    return PN.risk_contribution(PN.covariance(strategy(spark, root)), weights(spark, root))


@query("r07_covariance", "cov", "SELECT * FROM cov WHERE a <= b", "cov corr", d=8)
def r07(spark, root):
    return PN.covariance(strategy(spark, root))


cte("aged", "SELECT s.*, age FROM strategy s JOIN (SELECT ts, row_number() OVER (ORDER BY ts DESC) - 1 AS age FROM (SELECT DISTINCT ts FROM strategy)) USING (ts)", "strategy")


@query("r07_exponential_covariance", "aged", """WITH p AS (SELECT x.symbol AS a, y.symbol AS b, x.r AS x, y.r AS y, 0.5 ** (x.age / 60) AS w FROM aged x JOIN aged y ON x.ts = y.ts AND x.symbol <= y.symbol),
  m AS (SELECT a, b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM p GROUP BY ALL)
  SELECT a, b, sum(w * (x - mx) * (y - my)) / sum(w) * sum(w) ** 2 / (sum(w) ** 2 - sum(w * w)) * 252 AS cov FROM p JOIN m USING (a, b) GROUP BY a, b""", "cov", d=8)
def r07b(spark, root):
    return PN.exponential_covariance(strategy(spark, root))


cte("expected", """SELECT symbol, avg(r) * 252 AS historical, sum(0.5 ** (age / 60) * r) / sum(0.5 ** (age / 60)) * 252 AS exponential, 0.02 + covar_samp(r, mkt) / any_value(mv) * (any_value(mm) * 252 - 0.02) AS capm, covar_samp(r, mkt) / any_value(mv) AS beta
  FROM aged JOIN (SELECT ts, avg(r) AS mkt FROM strategy GROUP BY ts) USING (ts), (SELECT avg(mkt) AS mm, var_samp(mkt) AS mv FROM (SELECT avg(r) AS mkt FROM strategy GROUP BY ts)) GROUP BY symbol""", "aged")


@query("r07_expected_returns", "expected", "SELECT * FROM expected", "historical exponential capm beta")
def r07c(spark, root):
    return PN.expected_returns(strategy(spark, root))


cte("dret", f"SELECT symbol, ts, seq, r FROM (SELECT symbol, ts, seq, 0.02 * ln(close / lag(close) OVER w) AS r FROM bars_d {W}) WHERE seq > 0", "bars_d")


def dret(spark, root):
    return rolled(bars_d(spark, root), lambda h, w: h.select("symbol", "ts", "seq", "_c", (0.02 * F.ln(F.col("close") / F.lag("close").over(w))).alias("r")), 1).filter("seq > 0")


@query("r07_shrunk_covariance", "dret", """WITH d AS (SELECT * FROM dret WHERE ts IN (SELECT ts FROM dret GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT symbol) FROM dret))), c AS (SELECT symbol, ts, r - avg(r) OVER (PARTITION BY symbol) AS r FROM d),
  e AS (SELECT x.symbol AS a, y.symbol AS b, avg(x.r * y.r) AS s, count(*) AS n, sum(x.r * x.r * y.r * y.r) AS b2 FROM c x JOIN c y ON x.ts = y.ts GROUP BY ALL),
  t AS (SELECT max(n) AS n, sqrt(count(*)) AS p, sum(s) FILTER (a = b) AS tr, sum(s * s) AS d2, sum(b2) AS b2 FROM e),
  u AS (SELECT tr / p AS mu, least((b2 / n - d2) / (p * n), (d2 - 2 * tr / p * tr + p * (tr / p) ** 2) / p) / ((d2 - 2 * tr / p * tr + p * (tr / p) ** 2) / p) AS k FROM t)
  SELECT a, b, ((1 - k) * s + CASE WHEN a = b THEN k * mu ELSE 0 END) * 252 AS cov, k AS shrinkage FROM e, u WHERE a <= b""", "cov shrinkage", d=8)
def r07d(spark, root):
    return PN.shrunk_covariance(dret(spark, root))


@query("r08_inverse_variance", "cov expected", """WITH w AS (SELECT a AS symbol, 252 / cov / sum(252 / cov) OVER () AS weight, sqrt(cov / 252) AS vol FROM cov WHERE a = b), p AS (SELECT sqrt(sum(cov / 252 * x.weight * y.weight)) AS er FROM cov JOIN w x ON x.symbol = a JOIN w y ON y.symbol = b)
  SELECT sum(weight * historical) AS expected_return, any_value(er) AS expected_risk, (sum(weight * historical) - 0.02) / any_value(er) AS sharpe, sum(weight * vol) / any_value(er) AS diversification_ratio, CAST(floor(1 / sum(weight * weight)) AS BIGINT) AS effective_assets FROM w JOIN expected USING (symbol), p""",
       "expected_return expected_risk sharpe diversification_ratio")
def r08(spark, root):
    s = strategy(spark, root)
    daily = PN.covariance(s).withColumn("cov", F.col("cov") / 252)
    return PN.allocation_report(daily, PN.expected_returns(s))


@query("r09_blended_expectations", "cov expected", """WITH v AS (SELECT symbol, avg(r) AS view, avg(CAST(r > 0 AS DOUBLE)) AS confidence FROM strategy WHERE year(ts) >= 2000 GROUP BY symbol)
  SELECT symbol, confidence * view + (1 - confidence) * historical AS expected_return, cov * (1 + (1 - confidence) * 0.5) ** 2 AS variance FROM expected JOIN v USING (symbol) JOIN cov ON a = symbol AND b = symbol""", "expected_return variance", d=8)
def r09(spark, root):
    s = strategy(spark, root)
    v = s.filter(F.year("ts") >= 2000).groupBy("symbol").agg(F.avg("r").alias("view"), R.share(F.col("r") > 0).alias("confidence"))
    return PN.blended(PN.expected_returns(s), PN.covariance(s), v)


_R10 = "concentration average_correlation maximum_correlation diversification_ratio var_95 risk_utilization"


@query("r10_portfolio_risk", "cov pret", f"""WITH p AS (SELECT stddev_samp(r) AS s1, abs(least(avg(r) - {R.Z95} * stddev_pop(r), quantile_cont(r, 0.05))) AS v FROM pret), c AS (SELECT avg(corr) AS ac, max(corr) AS mc FROM cov WHERE a < b),
  w AS (SELECT sum(weight * v) AS wv, max(weight) AS mw FROM weights JOIN (SELECT symbol, stddev_samp(r) AS v FROM strategy GROUP BY symbol) USING (symbol))
  SELECT mw AS concentration, ac AS average_correlation, mc AS maximum_correlation, wv / s1 AS diversification_ratio, v AS var_95, v / 0.02 AS risk_utilization,
  concat_ws('|', CASE WHEN mw > 0.25 THEN 'High concentration risk' END, CASE WHEN mc > 0.8 THEN 'High correlation risk' END, CASE WHEN v / 0.02 > 0.8 THEN 'High risk utilization' END) AS warnings FROM p, c, w""", _R10)
def r10(spark, root):
    s = strategy(spark, root)
    d = R.assess_portfolio(s, weights(spark, root), PN.covariance(s))
    return d.withColumn("warnings", F.array_join("warnings", "|"))


@query("r11_position_size", "patterns", """SELECT symbol, seq, k AS kelly_fraction, b AS base_size, least(b * strength, 25000 / e) AS final_size, 25000 / e AS max_size, e + 2 * rk AS take_profit FROM (
  SELECT *, 0.4 * (2000 / rk) + 0.3 * (0.02 / volatility * 100000 / e) + 0.3 * k * 100000 / e AS b FROM (SELECT *, greatest(0, least(((0.5 + strength * 0.3) * 0.02 - (1 - (0.5 + strength * 0.3)) * rk / e) / 0.02, 0.25)) AS k FROM (
   SELECT symbol, seq, strength, volatility, price_end AS e, abs(price_end - price_end * (1 - volatility)) AS rk FROM patterns)))""", "kelly_fraction base_size final_size max_size take_profit")
def r11(spark, root):
    s = D.patterns(spark, root).select("symbol", "seq", F.col("price_end").alias("entry"), (F.col("price_end") * (1 - F.col("volatility"))).alias("stop"), F.col("strength").alias("confidence"), "volatility")
    return keep(R.position_size(s), "kelly_fraction", "base_size", "final_size", "max_size", "take_profit")


_R12 = "total_return win_rate avg_win avg_loss sharpe_ratio profit_factor max_drawdown"


@query("r12_pattern_backtest", "patterns", f"""WITH t AS (SELECT symbol, seq, (exit_px - close) / close - 0.002 AS r FROM ({touch_sql('bars_d', 0.25, 0.2, 10)}) x WHERE (symbol, seq) IN (SELECT (symbol, end_seq) FROM patterns)),
  e AS (SELECT *, product(1 + r) OVER w AS eq FROM t {W}), f AS (SELECT *, (eq - max(eq) OVER w) / max(eq) OVER w AS dd FROM e {W})
  SELECT symbol, count(*) AS trades, count(*) FILTER (r > 0) AS winning, count(*) FILTER (r <= 0) AS losing, sum(r) AS total_return, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, coalesce(avg(r) FILTER (r > 0), 0) AS avg_win, coalesce(avg(r) FILTER (r <= 0), 0) AS avg_loss,
   avg(r) / stddev_pop(r) * sqrt(252) AS sharpe_ratio, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r <= 0)) AS profit_factor, min(dd) AS max_drawdown FROM f GROUP BY symbol""", _R12)
def r12(spark, root):
    at = D.patterns(spark, root).select("symbol", F.col("end_seq").alias("seq"))
    t = J.first_touch(bars_d(spark, root), 0.25, 0.2, 10).join(at, ["symbol", "seq"])
    t = t.select("symbol", F.col("seq").alias("at"), ((F.col("exit_px") - F.col("close")) / F.col("close") - 0.002).alias("net_return"))
    return R.trade_report(t, ["at"], F.floor(F.col("at") / 1024))


_R13 = "win_rate avg_return profit_factor sharpe_ratio max_drawdown best_type_accuracy mean_type_accuracy"


@query("r13_forecast_backtest", "patterns", f"""WITH n AS (SELECT symbol, max(seq) AS m FROM bars_d GROUP BY symbol), o AS (SELECT p.symbol, p.seq, type, price_change > 0 AS up, CASE WHEN end_seq >= m THEN 0.0 ELSE (z.close - a.close) / a.close END AS x FROM patterns p JOIN n USING (symbol)
   JOIN bars_d a ON a.symbol = p.symbol AND a.seq = p.end_seq LEFT JOIN bars_d z ON z.symbol = p.symbol AND z.seq = least(p.end_seq + 5, m)), f AS (SELECT symbol, seq, type, CASE WHEN up THEN x ELSE -x END AS r, up = (x > 0) AS hit FROM o),
  c AS (SELECT *, sum(r) OVER w AS c FROM f {W}), d AS (SELECT symbol, max(t - c) AS dd FROM (SELECT *, max(c) OVER w AS t FROM c {W}) GROUP BY symbol),
  s AS (SELECT symbol, max(n) FILTER (g) AS mw, max(n) FILTER (NOT g) AS ml FROM (SELECT symbol, run, first(r > 0) AS g, count(*) AS n FROM (SELECT *, sum(chg) OVER w AS run FROM (SELECT *, CASE WHEN lag(r > 0) OVER w <> (r > 0) THEN 1 ELSE 0 END AS chg FROM f {W}) {W}) GROUP BY ALL) GROUP BY symbol),
  t AS (SELECT symbol, max(a) AS best, avg(a) AS mean FROM (SELECT symbol, type, avg(CAST(hit AS DOUBLE)) AS a FROM f GROUP BY ALL HAVING count(*) >= 5) GROUP BY symbol)
  SELECT symbol, count(*) AS forecasts, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, avg(r) AS avg_return, sum(r) FILTER (r > 0) / abs(sum(r) FILTER (r < 0)) AS profit_factor, avg(r) / stddev_pop(r) * sqrt(252 / 5) AS sharpe_ratio, any_value(dd) AS max_drawdown,
   any_value(mw) AS max_wins, any_value(ml) AS max_losses, any_value(best) AS best_type_accuracy, any_value(mean) AS mean_type_accuracy FROM f JOIN d USING (symbol) JOIN s USING (symbol) LEFT JOIN t USING (symbol) GROUP BY symbol""", _R13)
def r13(spark, root):
    o = J.forward_outcome(D.patterns(spark, root), bars_d(spark, root), "end_seq", 5)
    up, x = F.col("price_change") > 0, F.col("outcome")
    return R.forecast_backtest(o.select("symbol", "seq", F.when(up, x).otherwise(-x).alias("r"), F.col("type").alias("kind"), (up == (x > 0)).alias("hit")), 5)


@query("r14_calibration", "predictions", """SELECT CAST(floor(prob * 10) AS BIGINT) AS bin, count(*) AS n, avg(prob) AS mean_prob, avg(CAST(up AS DOUBLE)) AS accuracy, sqrt(avg(CAST(up AS DOUBLE)) * (1 - avg(CAST(up AS DOUBLE))) / count(*)) AS std_error
  FROM predictions WHERE prob < 1 GROUP BY 1""", "mean_prob accuracy std_error")
def r14(spark, root):
    return R.calibration(D.predictions(spark, root), F.col("up"), closed="left")


cte("flips", f"""SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY p.seq) - 1 AS seq, CASE WHEN type IN ('trend_up', 'reversal_bottom') THEN 1 ELSE -1 END AS sig, price_end AS price FROM patterns p WHERE type <> 'consolidation'""", "patterns")


@query("r14_flip_trades", "flips", """WITH RECURSIVE e AS (SELECT symbol, seq, sig AS pos, price AS px, CASE WHEN sig > 0 THEN 'entry_long' ELSE 'entry_short' END AS kind, NULL::DOUBLE AS trade_return FROM flips WHERE seq = 0 UNION ALL
  SELECT f.symbol, f.seq, CASE WHEN pos = 0 THEN sig WHEN sig = -pos THEN 0 ELSE pos END, CASE WHEN pos = 0 THEN price ELSE px END, CASE WHEN pos = 0 THEN CASE WHEN sig > 0 THEN 'entry_long' ELSE 'entry_short' END WHEN sig = -pos THEN 'exit' END,
   CASE WHEN pos <> 0 AND sig = -pos THEN pos * (price - px) / px END FROM e JOIN flips f ON f.symbol = e.symbol AND f.seq = e.seq + 1) SELECT symbol, seq, kind, trade_return FROM e WHERE kind IS NOT NULL""", "trade_return")
def r14b(spark, root):
    p = D.patterns(spark, root).filter("type <> 'consolidation'")
    s = p.select("symbol", F.col("seq").alias("at"), F.when(F.col("type").isin("trend_up", "reversal_bottom"), 1).otherwise(-1).alias("sig"), F.col("price_end").alias("price"))
    return R.flip_trades(number_rows(s, ["at"], F.floor(F.col("at") / 1024)))


_R15 = "entry_price exit_price quantity commission pnl"


@query("r15_signal_ledger", "signals", """WITH en AS (SELECT *, close * (1 + side * 0.0005) AS ep FROM signals WHERE side IS NOT NULL), j AS (SELECT en.symbol, en.seq, b.seq AS x, b.close AS px, en.side * (b.close - ep) / ep AS ret FROM en JOIN signals b ON b.symbol = en.symbol AND b.seq > en.seq AND b.seq <= en.seq + 20),
  t AS (SELECT symbol, seq, min(x) FILTER (ret >= 0.25 OR ret <= -0.2) AS x, max(x) AS lx FROM j GROUP BY symbol, seq)
  SELECT symbol, seq, exit_seq, side, ep AS entry_price, xp AS exit_price, q AS quantity, 0.001 * (10000 + q * xp) AS commission, side * q * (xp - ep) - 0.001 * (10000 + q * xp) AS pnl, reason FROM (
   SELECT en.symbol, en.seq, coalesce(t.x, lx) AS exit_seq, side, ep, px * (1 - side * 0.0005) AS xp, 10000 / ep AS q, CASE WHEN t.x IS NULL THEN CASE WHEN lx < en.seq + 20 THEN 'end_of_backtest' ELSE 'max_holding' END WHEN ret >= 0.25 THEN 'take_profit' ELSE 'stop_loss' END AS reason
   FROM en JOIN t USING (symbol, seq) JOIN j ON j.symbol = en.symbol AND j.seq = en.seq AND j.x = coalesce(t.x, lx))""", _R15)
def r15(spark, root):
    return R.signal_ledger(D.signals(spark, root))


_R16 = "mean_return std_return mean_sharpe std_sharpe mean_max_drawdown worst_drawdown consistency"


@query("r16_walk_forward_summary", "strategy", """WITH d AS (SELECT symbol, seq // 63 AS win, seq, r FROM strategy), e AS (SELECT *, product(1 + r) OVER (PARTITION BY symbol, win ORDER BY seq) AS eq FROM d), f AS (SELECT *, (eq - max(eq) OVER (PARTITION BY symbol, win ORDER BY seq)) / max(eq) OVER (PARTITION BY symbol, win ORDER BY seq) AS dd FROM e),
  g AS (SELECT symbol, win, product(1 + r) - 1 AS t, coalesce((avg(r) * 252 - 0.02) / (stddev_samp(r) * sqrt(252)), 0) AS s, abs(min(dd)) AS d FROM f GROUP BY ALL)
  SELECT symbol, count(*) AS windows, avg(t) AS mean_return, stddev_pop(t) AS std_return, avg(s) AS mean_sharpe, stddev_pop(s) AS std_sharpe, avg(d) AS mean_max_drawdown, max(d) AS worst_drawdown, avg(CAST(t > 0 AS DOUBLE)) AS consistency FROM g GROUP BY symbol""", _R16)
def r16(spark, root):
    return R.walk_forward_summary(strategy(spark, root), 63)


@query("r17_equity_ratios", "equity", """SELECT symbol, s AS sharpe_ratio, a AS annual_return, md AS max_drawdown, a / md AS calmar_ratio FROM (SELECT symbol, (avg(r) * 252 - 0.02) / (stddev_samp(r) * sqrt(252)) AS s, (arg_max(equity, seq) / arg_min(equity, seq)) ** (365.25 / date_diff('day', min(ts), max(ts))) - 1 AS a, abs(min(drawdown)) AS md FROM equity GROUP BY symbol)""",
       "sharpe_ratio annual_return max_drawdown calmar_ratio")
def r17(spark, root):
    return R.equity_ratios(strategy(spark, root))


_VAR = "SELECT v.name AS strategy, seq, CAST(r * k AS DOUBLE) AS r FROM (SELECT row_number() OVER (ORDER BY ts) - 1 AS seq, r FROM pret), (VALUES ('long', 1.0), ('half', 0.5), ('short', -1.0)) v(name, k)"


@query("r18_strategy_comparison", "pret", rm_sql(_VAR, "strategy"), RM)
def r18(spark, root):
    p = R.portfolio_returns(strategy(spark, root), weights(spark, root))
    dim = spark.createDataFrame([("long", 1.0), ("half", 0.5), ("short", -1.0)], "strategy string, k double")
    d = p.crossJoin(F.broadcast(dim)).select("strategy", "ts", (F.col("r") * F.col("k")).alias("r"))
    return R.risk_metrics(number_rows(d, ["ts"], F.floor(epoch("ts") / (DAY * 1024)), by=["strategy"]), ("strategy",))


_R19 = "mse rmse mae mape r2 explained_variance mean_residual std_residual skew_residual kurtosis_residual max_error directional_accuracy percentile_95_error"


@query("r19_regression_report", "predictions", f"""SELECT model, count(*) AS n, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / y_true)) AS mape, 1 - avg(e * e) / var_pop(y_true) AS r2, 1 - var_pop(e) / var_pop(y_true) AS explained_variance, avg(e) AS mean_residual,
  stddev_pop(e) AS std_residual, skewness(e) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0)) AS skew_residual, kurtosis_pop(e) AS kurtosis_residual, max(abs(e)) AS max_error, avg(CAST(dr AS DOUBLE)) AS directional_accuracy, quantile_cont(abs(e), 0.95) AS percentile_95_error
  FROM (SELECT *, y_true - y_pred AS e, (y_true > lag(y_true) OVER w) = (y_pred > lag(y_pred) OVER w) AS dr FROM predictions {W}) GROUP BY model""", _R19)
def r19(spark, root):
    return R.regression_report(D.predictions(spark, root), ["model"])


@query("r20_class_metrics", "predictions", """WITH m AS (SELECT label, support, coalesce(tp / nullif(pr, 0), 0) AS precision, tp / support AS recall FROM (SELECT actual AS label, count(*) AS support, count(*) FILTER (pred = actual) AS tp FROM predictions GROUP BY 1) LEFT JOIN (SELECT pred AS label, count(*) AS pr FROM predictions GROUP BY 1) USING (label)),
  f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m) SELECT * FROM f UNION ALL SELECT 'weighted', CAST(sum(support) AS BIGINT), sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support) FROM f""", "precision recall f1")
def r20(spark, root):
    return R.class_metrics(D.predictions(spark, root))


@query("r20_binary_scores", "predictions", """WITH k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY prob) + (count(*) OVER (PARTITION BY model, prob) - 1) / 2 AS rk, greatest(least(prob, 1 - 1e-15), 1e-15) AS q FROM predictions)
  SELECT model, avg(CAST((prob > 0.5) = up AS DOUBLE)) AS accuracy, -avg(CASE WHEN up THEN ln(q) ELSE ln(1 - q) END) AS log_loss, (sum(rk) FILTER (up) - count(*) FILTER (up) * (count(*) FILTER (up) + 1) / 2) / (count(*) FILTER (up) * count(*) FILTER (NOT up)) AS auc FROM k GROUP BY model""", "accuracy log_loss auc")
def r20b(spark, root):
    return R.binary_scores(D.predictions(spark, root), ["model"])


_R21 = "total_return sharpe_ratio max_drawdown win_rate profit_factor avg_return_per_trade"


@query("r21_signal_returns", "returns_p", f"""WITH p AS (SELECT symbol, seq - 1 AS seq, 0.02 * lr AS y_true, -lr AS y_pred FROM returns_p), s AS (SELECT symbol, seq, sign(y_pred) * lead(y_true) OVER w AS s, sign(y_pred) <> lag(sign(y_pred)) OVER w AS chg FROM p {W}),
  c AS (SELECT *, sum(s) OVER w AS c FROM s WHERE s IS NOT NULL {W}), d AS (SELECT symbol, min((c - t) / (t + 1e-6)) AS md FROM (SELECT *, max(c) OVER w AS t FROM c {W}) GROUP BY symbol), g AS (SELECT symbol, sum(s) - count(*) FILTER (chg) * 0.001 AS net, avg(s) AS m, stddev_pop(s) AS sd, count(*) FILTER (chg) AS k,
   avg(CAST(s > 0 AS DOUBLE)) AS wr, coalesce(sum(s) FILTER (s > 0), 0) AS gp, abs(coalesce(sum(s) FILTER (s < 0), 0)) AS ls FROM s GROUP BY symbol)
  SELECT symbol, net AS total_return, m / (sd + 1e-6) * sqrt(252) AS sharpe_ratio, md AS max_drawdown, wr AS win_rate, gp / (ls + 1e-6) AS profit_factor, k AS number_of_trades, net / (k + 1e-6) AS avg_return_per_trade FROM g JOIN d USING (symbol)""", _R21)
def r21(spark, root):
    p = D.returns_p(spark, root).select("symbol", (F.col("seq") - 1).alias("seq"), (0.02 * F.col("lr")).alias("y_true"), (-F.col("lr")).alias("y_pred"))
    return R.signal_returns(p)


_AB = "mean_a mean_b std_a std_b t_statistic effect_size p_value"


@query("r22_paired_test", "predictions", """SELECT n, mean_a, mean_b, std_a, std_b, t_statistic, effect_size, p AS p_value, CASE WHEN p < 0.05 THEN CASE WHEN mean_a > mean_b THEN 'last_value' ELSE 'constant' END ELSE 'No significant difference' END AS winner FROM (
 SELECT *, greatest(0, 1 - 2 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt(pi()) * (hi / 2000 / 3) * list_sum([(CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * cos(hi * k / 2000) ** (n - 2) for k in range(2001)])) AS p FROM (
 SELECT *, atan(least(abs(t_statistic), 40) / sqrt(n - 1)) AS hi FROM (SELECT count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, stddev_pop(a) AS std_a, stddev_pop(b) AS std_b, avg(a - b) * sqrt(count(*)) / stddev_samp(a - b) AS t_statistic, avg(a - b) / stddev_pop(a - b) AS effect_size FROM (
  SELECT -abs(y_pred - y_true) AS a, -abs(36 - y_true) AS b FROM predictions))))""", _AB)
def r22(spark, root):
    s = D.predictions(spark, root).select((-F.abs(F.col("y_pred") - F.col("y_true"))).alias("last_value"), (-F.abs(36 - F.col("y_true"))).alias("constant"))
    return R.paired_test(s, "last_value", "constant")


@query("r23_model_selection", "predictions", """WITH m AS (SELECT model, avg(CAST(pred = actual AS DOUBLE)) AS accuracy, avg(abs(y_true - y_pred)) AS mae FROM predictions GROUP BY model)
  SELECT model, accuracy, mae, accuracy / sum(accuracy) OVER () AS ensemble_weight, model = (SELECT arg_max(model, accuracy) FROM m) AS best_accuracy, model = (SELECT arg_min(model, mae) FROM m) AS best_mae, accuracy < 0.5 AS warn FROM m""", "accuracy mae ensemble_weight")
def r23(spark, root):
    m = D.predictions(spark, root).groupBy("model").agg(R.share(F.col("pred") == F.col("actual")).alias("accuracy"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    best = m.agg(F.max_by("model", "accuracy").alias("_a"), F.min_by("model", "mae").alias("_m"), F.sum("accuracy").alias("_s"))
    return m.crossJoin(F.broadcast(best)).select("model", "accuracy", "mae", (F.col("accuracy") / F.col("_s")).alias("ensemble_weight"), (F.col("model") == F.col("_a")).alias("best_accuracy"),
                                                 (F.col("model") == F.col("_m")).alias("best_mae"), (F.col("accuracy") < 0.5).alias("warn"))


_CAL = "SELECT CAST(ceil(prob * 10) - 1 AS BIGINT) AS bin, count(*) AS n, avg(prob) AS mean_prob, avg(CAST(up AS DOUBLE)) AS accuracy FROM predictions WHERE prob > 0 GROUP BY 1"


@query("r24_calibration", "predictions", f"SELECT *, sqrt(accuracy * (1 - accuracy) / n) AS std_error FROM ({_CAL})", "mean_prob accuracy std_error")
def r24(spark, root):
    return R.calibration(D.predictions(spark, root), F.col("up"))


@query("r24_calibration_error", "predictions", f"SELECT sum(n * abs(mean_prob - accuracy)) / sum(n) AS ece, CAST(sum(n) AS BIGINT) AS n FROM ({_CAL})", "ece")
def r24b(spark, root):
    return R.calibration_error(R.calibration(D.predictions(spark, root), F.col("up")))


@query("r25_error_profile", "predictions", """SELECT CAST(hour(ts) AS INT) AS hour, count(*) AS n, avg(e) AS mean, stddev_pop(e) AS std, regr_slope(abs(e), prob) AS confidence_slope, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.5) AS median, quantile_cont(e, 0.75) AS q3
  FROM (SELECT *, y_true - y_pred AS e FROM predictions) GROUP BY 1""", "mean std confidence_slope q1 median q3")
def r25(spark, root):
    return R.error_profile(D.predictions(spark, root))


@query("r26_horizon_accuracy", "predictions", "SELECT CAST(k AS INT) AS horizon, p.pred, count(*) AS support, avg(CAST(p.pred = a.actual AS DOUBLE)) AS accuracy FROM predictions p, (VALUES (1), (3), (5)) h(k), predictions a WHERE a.symbol = p.symbol AND a.seq = p.seq + k - 1 GROUP BY 1, 2", "accuracy")
def r26(spark, root):
    return R.horizon_accuracy(D.predictions(spark, root))


@query("r27_split", "patterns", f"SELECT symbol, CASE WHEN md5(symbol || '|' || seq)[1:8] < '{int(0.2 * 2**32):08x}' THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM patterns GROUP BY ALL")
def r27(spark, root):
    return R.hash_split(D.patterns(spark, root), ["symbol", "seq"]).groupBy("symbol", "part").agg(R.one().alias("n"))


# fills: one trade per line item; returned items are sales
_FILL = f"""SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS seq, side, quantity, price, greatest(quantity * price * 0.001, 1.0) AS commission
  FROM (SELECT p_brand AS symbol, l.*, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS price FROM lineitem l JOIN part ON p_partkey = l_partkey)"""
cte("fills", _FILL)


def fills(spark, root):
    """Numbered fills, stored twice on the way: the join and the numbering each shuffle every line item, and so never lie on the disks together."""
    p = table(spark, root, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    d = table(spark, root, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    tie = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    d = store(d.select("symbol", *tie, (F.col("l_returnflag") == "R").alias("sale")), release=True)
    d = number_rows(d, tie, F.floor(epoch("l_shipdate") / DAY)).withColumn("quantity", F.col("l_quantity"))
    d = d.withColumn("side", F.when(F.col("sale"), -1).otherwise(1)).withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    d = d.withColumn("commission", F.greatest(F.col("quantity") * F.col("price") * 0.001, F.lit(1.0)))
    return store(d.select("symbol", "seq", F.col("l_shipdate").alias("ts"), "side", "quantity", "price", "commission"), release=True)


cte("priced", f"""SELECT symbol, seq, quantity, fp AS price, greatest(quantity * fp * 0.001, 1.0) AS commission, abs(fp - close) * quantity AS slippage, imp AS market_impact, pnl FROM (SELECT *, close * (1 + side * 0.0001) * (1 + side * imp) AS fp FROM (
  SELECT *, CASE WHEN volume = 0 THEN 0.0005 WHEN quantity / volume < 0.01 THEN 0.0 WHEN quantity / volume < 0.05 THEN 0.0005 * (quantity / volume) * 20 ELSE 0.0005 * (quantity / volume) * 50 END AS imp
  FROM (SELECT t.symbol, entry_seq AS seq, side, 1.0::DOUBLE AS quantity, entry_px AS close, volume * 10 AS volume, net_return * entry_px AS pnl FROM trades t JOIN bars_d b ON b.symbol = t.symbol AND b.seq = t.entry_seq)))""", "trades")


def priced(spark, root):
    b = bars_d(spark, root).select("symbol", F.col("seq").alias("entry_seq"), (F.col("volume") * 10).alias("volume"))
    t = D.trades(spark, root).join(b, ["symbol", "entry_seq"])
    t = t.select("symbol", F.col("entry_seq").alias("seq"), "side", F.lit(1.0).alias("quantity"), F.col("entry_px").alias("close"), "volume", (F.col("net_return") * F.col("entry_px")).alias("pnl"))
    return R.cost_columns(t)


_R28 = "total_commission average_commission commission_share total_slippage average_slippage largest_win largest_loss"


@query("r28_cost_report", "priced", """SELECT count(*) AS trades, sum(commission) AS total_commission, avg(commission) AS average_commission, sum(commission) / sum(quantity * price) AS commission_share, sum(slippage) AS total_slippage, avg(slippage) AS average_slippage,
  max(pnl) FILTER (pnl > 0) AS largest_win, min(pnl) FILTER (pnl < 0) AS largest_loss FROM priced""", _R28, d=4)
def r28(spark, root):
    return R.cost_report(priced(spark, root).withColumn("price", F.col("fill_price")))


@query("r29_cost_columns", "priced", "SELECT symbol, seq, price AS fill_price, market_impact, commission, slippage FROM priced", "fill_price market_impact commission slippage")
def r29(spark, root):
    return keep(priced(spark, root), "fill_price", "market_impact", "commission", "slippage")


_BOOK = """WITH RECURSIVE b AS (SELECT symbol, seq, TRUE AS held, side * quantity AS qty, quantity * price AS cost, price AS av, NULL::DOUBLE AS pnl FROM fills WHERE seq = 0 UNION ALL
  SELECT symbol, seq, NOT (held AND side < 0 AND abs(qty) <= q), CASE WHEN NOT held THEN side * q WHEN side > 0 THEN qty + q WHEN abs(qty) <= q THEN 0 ELSE qty - q END,
   CASE WHEN NOT held THEN q * p WHEN side > 0 THEN cost + q * p WHEN abs(qty) <= q THEN 0 ELSE av * (qty - q) END,
   CASE WHEN NOT held THEN p WHEN side > 0 THEN CASE WHEN qty + q <> 0 THEN (cost + q * p) / (qty + q) ELSE 0 END WHEN abs(qty) <= q THEN 0 ELSE av END,
   CASE WHEN held AND side < 0 THEN (CASE WHEN qty > 0 THEN q * p - basis ELSE basis - q * p END) - fee END
  FROM (SELECT f.symbol, f.seq, f.side, f.quantity AS q, f.price AS p, f.commission AS fee, b.held, b.qty, b.cost, b.av, CASE WHEN abs(b.qty) <= f.quantity THEN b.cost ELSE b.av * f.quantity END AS basis FROM b JOIN fills f ON f.symbol = b.symbol AND f.seq = b.seq + 1))"""


@query("r30_average_cost", "fills", _BOOK + " SELECT symbol, seq, qty AS position, av AS average_price, round(pnl, 5) + 0.0 AS realized_pnl FROM b", "position average_price", d=8)
def r30(spark, root):
    return R.average_cost(fills(spark, root)).withColumn("realized_pnl", F.round("realized_pnl", 5) + F.lit(0.0))


@query("r30_mark_to_market", "fills", _BOOK + """, g AS (SELECT symbol, sum(pnl) AS realized, arg_max(qty, seq) AS position, arg_max(av, seq) AS average_price FROM b GROUP BY symbol), l AS (SELECT symbol, arg_max(price, seq) AS last_price FROM fills GROUP BY symbol)
  SELECT symbol, realized, position, average_price, last_price, position * (last_price - average_price) AS unrealized FROM g JOIN l USING (symbol)""", "realized position average_price last_price unrealized", d=2)
def r30b(spark, root):
    f = fills(spark, root)
    return R.mark_to_market(R.average_cost(f), f.groupBy("symbol").agg(F.max_by("price", "seq").alias("last_price")))

"""Oracle CTEs for the derived tables."""

from tapeline.plans.registry import cte

W = "WINDOW w AS (PARTITION BY symbol ORDER BY seq)"

cte("returns_p", f"SELECT * FROM (SELECT symbol, ts, seq, close, close / lag(close) OVER w - 1 AS r, ln(close / lag(close) OVER w) AS lr FROM bars_b {W}) WHERE seq > 0", "bars_b")

cte("regimes", """WITH x AS MATERIALIZED (SELECT *, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS vol, avg(volume) OVER f AS vma
  FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY seq) - 1 AS r FROM bars_d)
  WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 q AS (SELECT symbol, quantile_cont(vol, 0.75) AS vq, quantile_cont(r, 0.8) AS r80, quantile_cont(r, 0.2) AS r20 FROM x GROUP BY symbol)
 SELECT x.*, CASE WHEN seq < 20 THEN 'unknown' WHEN vol > vq THEN 'high_volatility' WHEN volume > 2 * vma THEN 'high_volume'
  WHEN r > r80 THEN 'strong_uptrend' WHEN r < r20 THEN 'strong_downtrend' ELSE 'normal' END AS regime FROM x JOIN q USING (symbol)""", "bars_d")


def window_sql(base, size, step, trend):
    """Window pattern classification in SQL."""
    return f"""WITH n AS (SELECT symbol, count(*) AS n FROM {base} GROUP BY symbol),
 m AS (SELECT b.*, s.start AS start_seq, seq - s.start AS pos FROM {base} b, LATERAL (SELECT unnest(range(greatest(0, CAST(floor((seq - {size}) / {step}.0) + 1 AS BIGINT) * {step}),
   seq + 1, {step})) AS start) s),
 e AS (SELECT m.*, arg_max(pos, close) OVER g AS top, arg_min(pos, close) OVER g AS bot FROM m JOIN n USING (symbol) WHERE start_seq < n - {size}
   WINDOW g AS (PARTITION BY symbol, start_seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 a AS (SELECT symbol, start_seq, first(ts ORDER BY pos) AS ts, first(close ORDER BY pos) AS price_start, last(close ORDER BY pos) AS price_end,
   stddev_pop(close) / avg(close) AS volatility, (max(close) - min(close)) / avg(close) AS price_range, regr_slope(close, pos) / avg(close) AS tn,
   regr_r2(close, pos) AS strength, any_value(top) AS top, any_value(bot) AS bot,
   regr_slope(close, pos) FILTER (pos < {size // 2}) AS h1, regr_slope(close, pos) FILTER (pos >= {size // 2}) AS h2,
   regr_slope(close, pos) FILTER (pos < top) AS tb, regr_slope(close, pos) FILTER (pos >= top) AS ta,
   regr_slope(close, pos) FILTER (pos < bot) AS bb, regr_slope(close, pos) FILTER (pos >= bot) AS ba
  FROM e GROUP BY symbol, start_seq)
 SELECT symbol, start_seq, start_seq + {size} AS end_seq, ts, strength, (price_end - price_start) / price_start AS price_change, price_start, price_end, volatility, price_range,
  abs(tn) AS trend_strength, type FROM (SELECT *, CASE WHEN abs(tn) < {trend} * 0.5 AND volatility < 0.02 THEN 'consolidation'
   WHEN tn > {trend} THEN CASE WHEN top > 0.3 * {size} AND top < 0.7 * {size} AND tb > 0 AND ta < 0 THEN 'reversal_top' ELSE 'trend_up' END
   WHEN tn < -{trend} THEN CASE WHEN bot > 0.3 * {size} AND bot < 0.7 * {size} AND bb < 0 AND ba > 0 THEN 'reversal_bottom' ELSE 'trend_down' END
   WHEN h1 > 0 AND h2 < 0 THEN 'reversal_top' WHEN h1 < 0 AND h2 > 0 THEN 'reversal_bottom' END AS type FROM a) WHERE type IS NOT NULL"""


cte("patterns", f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_seq) - 1 AS seq FROM ({window_sql('bars_d', 20, 10, 0.002)})", "bars_d")

cte("signals", f"""SELECT symbol, ts, seq, open, high, low, close, volume, CASE WHEN s <> 0 AND s <> p THEN s END AS side FROM (
  SELECT *, lag(s) OVER w AS p FROM (SELECT *, CAST(sign(close - CASE WHEN seq >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END) AS INTEGER) AS s
  FROM bars_d) {W})""", "bars_d")


def touch_sql(base, take, stop, hold, side="1", where="TRUE"):
    """First-touch exits in SQL by an equi-range join."""
    return f"""WITH en AS (SELECT *, {side} AS sd FROM {base} WHERE {where}),
 j AS (SELECT en.symbol, en.seq, b.seq AS x, b.close AS px, en.sd * (b.close - en.close) / en.close AS ret FROM en JOIN {base} b
   ON b.symbol = en.symbol AND b.seq > en.seq AND b.seq <= en.seq + {hold}),
 t AS (SELECT symbol, seq, min(x) FILTER (ret >= {take} OR ret <= -{stop}) AS x, max(x) AS lx FROM j GROUP BY symbol, seq),
 c AS (SELECT symbol, seq, coalesce(x, CASE WHEN lx = seq + {hold} THEN lx END) AS exit_seq, x IS NOT NULL AS touched FROM t)
 SELECT en.symbol, en.ts, en.seq, en.close, en.sd AS side, c.exit_seq, j.px AS exit_px,
  CASE WHEN NOT touched THEN 'max_holding' WHEN j.ret >= {take} THEN 'take_profit' ELSE 'stop_loss' END AS reason
 FROM en JOIN c USING (symbol, seq) JOIN j ON j.symbol = c.symbol AND j.seq = c.seq AND j.x = c.exit_seq"""


cte("trades", f"""SELECT symbol, ts AS entry_ts, seq AS entry_seq, exit_seq, side, close AS entry_px, exit_px,
  side * (exit_px / close - 1) - 0.002 AS net_return, reason FROM ({touch_sql('signals', 0.25, 0.20, 10, 'side', 'side IS NOT NULL')})""", "signals")

cte("predictions", f"""SELECT event_id AS id, symbol, seq, ts, event_type AS model, (CAST(round(price * 100) AS BIGINT) % 1001) / 1000.0 AS prob,
  CASE WHEN price < 20 THEN 'low' WHEN price < 60 THEN 'mid' ELSE 'high' END AS pred, CASE WHEN y_true < 20 THEN 'low' WHEN y_true < 60 THEN 'mid' ELSE 'high' END AS actual,
  price AS y_pred, y_true, y_true > price AS up FROM (SELECT *, lead(price) OVER w AS y_true FROM ticks_u {W}) WHERE y_true IS NOT NULL""", "ticks_u")

"""Indicator queries (window functions)."""

import re

from pyspark.sql import functions as F

from tapeline.operators import indicators as ind
from tapeline.plans.registry import ORACLES, query
from tapeline.sources.tables import bars_b, bars_d, bars_h

W = "WINDOW w AS (PARTITION BY symbol ORDER BY seq)"


def frame(n, after=0):
    return f"OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND {'CURRENT ROW' if not after else str(after) + ' FOLLOWING'})"


def g(agg, x, n):
    """Full-frame guard as in pandas rolling."""
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {agg}({x}) {frame(n)} END"


def wsum(x, n):
    return "(" + " + ".join(f"lag({x}, {n - k}) OVER w * {k}" if k < n else f"{x} * {n}" for k in range(1, n + 1)) + f") / {n * (n + 1) / 2}"


def ema_sql(base, x, specs):
    """Recursive exponential means; specs = {name: alpha}."""
    init = ", ".join(f"{x} AS {n}" for n in specs)
    step = ", ".join(f"e.{n} * {1 - a!r} + b.{x} * {a!r}" for n, a in specs.items())
    names = ", ".join(specs)
    return (f"SELECT symbol, seq, {init} FROM {base} WHERE seq = 0 UNION ALL "
            f"SELECT b.symbol, b.seq, {step} FROM e JOIN {base} b ON b.symbol = e.symbol AND b.seq = e.seq + 1"), names


def keep(df, *cols):
    return df.select("symbol", "seq", *cols)


SMA = [f"sma_{n}" for n in (5, 10, 20, 50, 200)]


@query("w01_sma", "bars_d", "SELECT symbol, seq, " + ", ".join(f"{g('avg', 'close', n)} AS sma_{n}" for n in (5, 10, 20, 50, 200)) + " FROM bars_d", " ".join(SMA), d=3)
def w01(spark, root):
    return keep(ind.sma(bars_d(spark, root)), *SMA)


_E = {f"ema_{n}": 2 / (n + 1) for n in (12, 26, 50)}
_ema, _names = ema_sql("bars_d", "close", _E)


@query("w02_ema", "bars_d", f"WITH RECURSIVE e AS ({_ema}) SELECT * FROM e", " ".join(_E), d=3)
def w02(spark, root):
    return keep(ind.ema(bars_d(spark, root)), *_E)


@query("w03_wma_hma", "bars_d", f"""SELECT symbol, seq, wma_10, wma_20, {wsum('hull', 4)} AS hma_20 FROM (
  SELECT symbol, seq, {wsum('close', 10)} AS wma_10, {wsum('close', 20)} AS wma_20, 2 * {wsum('close', 10)} - {wsum('close', 20)} AS hull
  FROM bars_d {W}) {W}""", "wma_10 wma_20 hma_20", d=3)
def w03(spark, root):
    return keep(ind.wma(bars_d(spark, root)), "wma_10", "wma_20", "hma_20")


def rsi_sql(n):
    ga, lo = g("avg", "gain", n), g("avg", "loss", n)
    return f"CASE WHEN ({lo}) = 0 AND ({ga}) > 0 THEN 100.0 WHEN ({lo}) > 0 THEN 100 - 100 / (1 + ({ga}) / ({lo})) END"


_GL = f"""SELECT *, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss
  FROM (SELECT *, close - lag(close) OVER w AS d FROM {{t}} {W})"""


@query("w04_rsi", "bars_d", f"SELECT symbol, seq, {rsi_sql(14)} AS rsi_14, {rsi_sql(21)} AS rsi_21 FROM ({_GL.format(t='bars_d')})", "rsi_14 rsi_21")
def w04(spark, root):
    return keep(ind.rsi(bars_d(spark, root)), "rsi_14", "rsi_21")


_m, _ = ema_sql("bars_d", "close", {"e12": 2 / 13, "e26": 2 / 27})


@query("w05_macd", "bars_d", f"""WITH RECURSIVE e AS ({_m}), m AS MATERIALIZED (SELECT symbol, seq, e12 - e26 AS macd FROM e),
 s AS (SELECT symbol, seq, macd AS macd_signal FROM m WHERE seq = 0 UNION ALL
  SELECT m.symbol, m.seq, s.macd_signal * 0.8 + m.macd * 0.2 FROM s JOIN m ON m.symbol = s.symbol AND m.seq = s.seq + 1)
 SELECT symbol, seq, macd, macd_signal, macd - macd_signal AS macd_histogram FROM m JOIN s USING (symbol, seq)""",
       "macd macd_signal macd_histogram", d=3)
def w05(spark, root):
    return keep(ind.macd(bars_d(spark, root)), "macd", "macd_signal", "macd_histogram")


_lo, _hi = g("min", "low", 14), g("max", "high", 14)


@query("w06_stochastic", "bars_d", f"""SELECT symbol, seq, k AS stoch_k_14, williams_r_14, {g('avg', 'k', 3)} AS stoch_d_14 FROM (
  SELECT symbol, seq, 100 * (close - lo) / nullif(hi - lo, 0) AS k, -100 * (hi - close) / nullif(hi - lo, 0) AS williams_r_14
  FROM (SELECT *, {_lo} AS lo, {_hi} AS hi FROM bars_d))""", "stoch_k_14 williams_r_14 stoch_d_14")
def w06(spark, root):
    return keep(ind.stochastic(bars_d(spark, root)), "stoch_k_14", "williams_r_14", "stoch_d_14")


@query("w07_roc", "bars_d", f"""SELECT symbol, seq, (close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100 AS roc_10,
  (close - lag(close, 20) OVER w) / lag(close, 20) OVER w * 100 AS roc_20,
  (volume - lag(volume, 10) OVER w) / nullif(lag(volume, 10) OVER w, 0) * 100 AS vroc_10 FROM bars_d {W}""", "roc_10 roc_20 vroc_10")
def w07(spark, root):
    return keep(ind.roc(bars_d(spark, root)), "roc_10", "roc_20", "vroc_10")


@query("w08_cci", "bars_d", f"""SELECT symbol, seq, (tp - m) / nullif(0.015 * list_sum(list_transform(f, lambda x: abs(x - m))) / 20, 0) AS cci_20
  FROM (SELECT symbol, seq, tp, {g('avg', 'tp', 20)} AS m, list(tp) {frame(20)} AS f FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars_d))""", "cci_20")
def w08(spark, root):
    return keep(ind.cci(bars_d(spark, root)), "cci_20")


_p, _n = g("sum", "pos", 14), g("sum", "neg", 14)


@query("w09_mfi", "bars_d", f"""SELECT symbol, seq, CASE WHEN ({_n}) = 0 AND ({_p}) > 0 THEN 100.0
   WHEN ({_n}) > 0 THEN 100 - 100 / (1 + ({_p}) / ({_n})) END AS mfi_14 FROM (
  SELECT symbol, seq, CASE WHEN tp > ptp THEN tp * volume ELSE 0 END AS pos, CASE WHEN tp < ptp THEN tp * volume ELSE 0 END AS neg FROM (
   SELECT *, lag(tp) OVER w AS ptp FROM (SELECT *, (high + low + close) / 3 AS tp FROM bars_d) {W}))""", "mfi_14")
def w09(spark, root):
    return keep(ind.mfi(bars_d(spark, root)), "mfi_14")


_BB = [f"bb_{x}_20" for x in ("upper", "middle", "lower", "width", "percent")]


@query("w10_bollinger", "bars_h", f"""SELECT symbol, seq, m + 2 * s AS bb_upper_20, m AS bb_middle_20, m - 2 * s AS bb_lower_20, 4 * s AS bb_width_20,
  (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_percent_20 FROM (SELECT *, {g('avg', 'close', 20)} AS m, {g('stddev_samp', 'close', 20)} AS s FROM bars_h)""", " ".join(_BB))
def w10(spark, root):
    return keep(ind.bollinger(bars_h(spark, root)), *_BB)


TR = f"SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER w AS pc FROM {{t}} {W})"


@query("w11_atr", "bars_h", f"SELECT symbol, seq, tr AS true_range, {g('avg', 'tr', 14)} AS atr_14 FROM ({TR.format(t='bars_h')})", "true_range atr_14")
def w11(spark, root):
    return keep(ind.atr(bars_h(spark, root)), "true_range", "atr_14")


@query("w12_rolling_std", "bars_h", f"SELECT symbol, seq, {g('stddev_samp', 'close', 20)} AS std_20, {g('stddev_samp', 'close', 50)} AS std_50 FROM bars_h", "std_20 std_50")
def w12(spark, root):
    return keep(ind.rolling_std(bars_h(spark, root)), "std_20", "std_50")


_k, _ = ema_sql("bars_h", "close", {"m": 2 / 21})
_CH = "kc_upper_20 kc_middle_20 kc_lower_20 dc_upper_20 dc_lower_20 dc_middle_20"


@query("w13_channels", "bars_h", f"""WITH RECURSIVE e AS ({_k}), t AS (SELECT *, {g('avg', 'tr', 20)} AS a, {g('max', 'high', 20)} AS hi, {g('min', 'low', 20)} AS lo
  FROM ({TR.format(t='bars_h')})) SELECT symbol, seq, m + 2 * a AS kc_upper_20, m AS kc_middle_20, m - 2 * a AS kc_lower_20, hi AS dc_upper_20, lo AS dc_lower_20,
  (hi + lo) / 2 AS dc_middle_20 FROM t JOIN e USING (symbol, seq)""", _CH)
def w13(spark, root):
    return keep(ind.channels(bars_h(spark, root)), *_CH.split())


_CLV = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"
_VT = f"""SELECT symbol, seq, sum(coalesce(sign(close - pc) * volume, 0)) OVER w AS obv, sum({_CLV} * volume) OVER w AS ad_line,
  sum(coalesce((close - pc) / pc * volume, 0)) OVER w AS pvt, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap
  FROM (SELECT *, lag(close) OVER w AS pc FROM bars_d {W}) {W}"""


@query("w14_volume_lines", "bars_d", f"SELECT symbol, seq, obv, ad_line, pvt FROM ({_VT})", "obv ad_line pvt", d=3)
def w14(spark, root):
    return keep(ind.volume_totals(bars_d(spark, root)), "obv", "ad_line", "pvt")


@query("w15_vwap", "bars_b", f"SELECT symbol, seq, vwap FROM ({_VT.replace('bars_d', 'bars_b')})", "vwap", d=5)
def w15(spark, root):
    return keep(ind.volume_totals(bars_b(spark, root)), "vwap")


@query("w16_cmf", "bars_d", f"SELECT symbol, seq, ({g('sum', 'mf', 20)}) / ({g('sum', 'volume', 20)}) AS cmf_20 FROM (SELECT *, {_CLV} * volume AS mf FROM bars_d)", "cmf_20")
def w16(spark, root):
    return keep(ind.cmf(bars_d(spark, root)), "cmf_20")


@query("w17_adx", "bars_d", f"""SELECT symbol, seq, p AS plus_di_14, m AS minus_di_14, {g('avg', 'dx', 14)} AS adx_14 FROM (
 SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM (
  SELECT *, 100 * ({g('avg', 'pdm', 14)}) / nullif({g('avg', 'tr', 14)}, 0) AS p, 100 * ({g('avg', 'mdm', 14)}) / nullif({g('avg', 'tr', 14)}, 0) AS m FROM (
   SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM (
    SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM ({TR.format(t='bars_d')}) {W}))))""", "plus_di_14 minus_di_14 adx_14")
def w17(spark, root):
    return keep(ind.adx(bars_d(spark, root)), "plus_di_14", "minus_di_14", "adx_14")


_AR = "aroon_up_25 aroon_down_25 aroon_osc_25"


@query("w18_aroon", "bars_d", f"""SELECT symbol, seq, u AS aroon_up_25, d AS aroon_down_25, u - d AS aroon_osc_25 FROM (
 SELECT symbol, seq, CASE WHEN len(h) = 26 THEN 100.0 * (26 - list_position(h, list_max(h))) / 25 END AS u,
  CASE WHEN len(l) = 26 THEN 100.0 * (26 - list_position(l, list_min(l))) / 25 END AS d
 FROM (SELECT symbol, seq, list(high) {frame(26)} AS h, list(low) {frame(26)} AS l FROM bars_d))""", _AR)
def w18(spark, root):
    return keep(ind.aroon(bars_d(spark, root)), *_AR.split())


_IC = "tenkan kijun senkou_a senkou_b chikou"


@query("w20_ichimoku", "bars_d", f"""SELECT symbol, seq, t AS tenkan, k AS kijun, lag((t + k) / 2, 26) OVER w AS senkou_a, lag(b, 26) OVER w AS senkou_b,
  lead(close, 26) OVER w AS chikou FROM (SELECT symbol, seq, close, """ + ", ".join(
    f"(({g('max', 'high', n)}) + ({g('min', 'low', n)})) / 2 AS {a}" for n, a in ((9, "t"), (26, "k"), (52, "b"))) + f" FROM bars_d) {W}", _IC)
def w20(spark, root):
    return keep(ind.ichimoku(bars_d(spark, root)), *_IC.split())


@query("w21_supertrend", "bars_b", f"""SELECT symbol, seq, CASE WHEN seq >= 10 THEN CASE WHEN coalesce(st, 1) = 1 THEN lo ELSE up END END AS supertrend FROM (
 SELECT *, last_value(ev IGNORE NULLS) OVER w AS st FROM (
  SELECT *, CASE WHEN seq >= 10 THEN CASE WHEN close > up THEN 1 WHEN close <= lo THEN -1 END END AS ev FROM (
   SELECT *, (high + low) / 2 + 3 * a AS up, (high + low) / 2 - 3 * a AS lo FROM (SELECT *, {g('avg', 'tr', 10)} AS a FROM ({TR.format(t='bars_b')})))) {W})""", "supertrend", d=3)
def w21(spark, root):
    return keep(ind.supertrend(bars_b(spark, root)), "supertrend")


_MO = "volatility_20d volatility_50d returns_skew_20d returns_kurt_20d"


@query("w22_return_moments", "bars_d", f"""SELECT symbol, seq, {g('stddev_samp', 'r', 20)} AS volatility_20d, {g('stddev_samp', 'r', 50)} AS volatility_50d,
  {g('skewness', 'r', 20)} AS returns_skew_20d, {g('kurtosis', 'r', 20)} AS returns_kurt_20d
  FROM (SELECT *, close / lag(close) OVER w - 1 AS r FROM bars_d {W})""", _MO)
def w22(spark, root):
    return keep(ind.moments(bars_d(spark, root)), *_MO.split())


_FL = "close bb_percent_20 rsi_14 atr_14"


@query("flagship_band_signal", "bars_h", f"""SELECT symbol, seq, close, bb_percent_20, rsi_14, atr_14,
  CASE WHEN bb_percent_20 < 0 OR rsi_14 < 30 THEN 1 WHEN bb_percent_20 > 1 OR rsi_14 > 70 THEN -1 ELSE 0 END AS signal
 FROM (SELECT symbol, seq, close, (close - (m - 2 * s)) / nullif(4 * s, 0) AS bb_percent_20, rsi_14, atr_14,
   row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM (
   SELECT *, {g('avg', 'close', 20)} AS m, {g('stddev_samp', 'close', 20)} AS s, {rsi_sql(14)} AS rsi_14, {g('avg', 'tr', 14)} AS atr_14 FROM (
    SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN d > 0 THEN d ELSE 0 END AS gain, CASE WHEN d < 0 THEN -d ELSE 0 END AS loss
    FROM (SELECT *, lag(close) OVER w AS pc, close - lag(close) OVER w AS d FROM bars_h {W}))))
 WHERE rn = 1 ORDER BY abs(bb_percent_20 - 0.5) DESC, symbol LIMIT 5""", _FL)
def flagship(spark, root):
    return ind.latest_band_signal(bars_h(spark, root))


_CAT = (SMA + list(_E) + "wma_10 wma_20 hma_20 rsi_14 rsi_21 macd macd_signal macd_histogram stoch_k_14 stoch_d_14 williams_r_14 roc_10 roc_20 vroc_10 cci_20 mfi_14".split()
        + _BB + "atr_14 std_20 std_50".split() + _CH.split() + "obv ad_line pvt vwap cmf_20 plus_di_14 minus_di_14 adx_14".split() + _AR.split()
        + ["ichimoku_" + c for c in _IC.split()] + ["supertrend_10_3"])


# prices picked as they are, or halves of two, are exact and stay unrounded (rounding meets ties); sums of many are not
_PARTS = "w01_sma w02_ema w03_wma_hma w04_rsi w05_macd w06_stochastic w07_roc w08_cci w09_mfi w10_bollinger w11_atr w12_rolling_std w13_channels w14_volume_lines w15_vwap w16_cmf w17_adx w18_aroon w20_ichimoku w21_supertrend".split()
_PICK = {"ichimoku_" + c: f"w20_ichimoku.{c}" for c in _IC.split()} | {"supertrend_10_3": "w21_supertrend.supertrend"}
_JOINED = " JOIN ".join(f"({re.sub('bars_[dh]', 'bars_b', ORACLES[n][1])}) {n}" + (" USING (symbol, seq)" if i else "") for i, n in enumerate(_PARTS))


@query("w23_catalogue", "bars_b", f"SELECT symbol, seq, {', '.join(_PICK.get(c, c) + ' AS ' + c for c in _CAT)} FROM {_JOINED}", " ".join(c for c in _CAT if not c.startswith(("dc_", "ichimoku_"))), d=3)
def w23(spark, root):
    return keep(ind.catalogue(bars_b(spark, root)), *_CAT)

"""Technical indicators over (symbol, seq) bars.

Each ``*_cols`` function adds columns to a haloed frame and declares how many
earlier rows it reads; ``rolled`` supplies them.  Several indicators can share
one pass over one sort.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.frames import (
    div, ewm, full, rmax, rmean, rmin, rolled, rstd, rsum, running, rweighted, span,
)


def C() -> "F.Column":
    return F.col("close")


def H() -> "F.Column":
    return F.col("high")


def L() -> "F.Column":
    return F.col("low")


def V() -> "F.Column":
    return F.col("volume")


def TYPICAL() -> "F.Column":
    return (H() + L() + C()) / 3


def sma(bars: DataFrame, periods=(5, 10, 20, 50, 200)) -> DataFrame:
    return rolled(bars, lambda h, w: h.select("*", *[rmean(C(), n, w).alias(f"sma_{n}") for n in periods]), max(periods))


def ema(bars: DataFrame, periods=(12, 26, 50)) -> DataFrame:
    return ewm(bars, {f"ema_{n}": (C(), span(n)) for n in periods})


def wma(bars: DataFrame, periods=(10, 20), hull=20) -> DataFrame:
    def build(h, w):
        h = h.select("*", *[rweighted(C(), n, w).alias(f"wma_{n}") for n in periods],
                     (2 * rweighted(C(), hull // 2, w) - rweighted(C(), hull, w)).alias("_hull"))
        return h.withColumn(f"hma_{hull}", rweighted(F.col("_hull"), int(math.sqrt(hull)), w)).drop("_hull")

    return rolled(bars, build, max(max(periods), hull) + int(math.sqrt(hull)))


def _rsi(n, w):
    d = F.col("_d")
    gain = rmean(F.when(d > 0, d).otherwise(0.0), n, w)
    loss = rmean(F.when(d < 0, -d).otherwise(0.0), n, w)
    return F.when((loss == 0) & (gain > 0), 100.0).when(loss > 0, 100 - div(100.0, 1 + div(gain, loss)))


def rsi(bars: DataFrame, periods=(14, 21)) -> DataFrame:
    def build(h, w):
        h = h.withColumn("_d", C() - F.lag(C()).over(w))
        return h.select("*", *[_rsi(n, w).alias(f"rsi_{n}") for n in periods]).drop("_d")

    return rolled(bars, build, max(periods) + 1)


def macd(bars: DataFrame) -> DataFrame:
    m = ewm(bars, {"_e12": (C(), span(12)), "_e26": (C(), span(26))}).withColumn("macd", F.col("_e12") - F.col("_e26"))
    m = ewm(m.drop("_e12", "_e26"), {"macd_signal": (F.col("macd"), span(9))})
    return m.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def stochastic(bars: DataFrame, n=14, d=3) -> DataFrame:
    def build(h, w):
        lo, hi = rmin(L(), n, w), rmax(H(), n, w)
        h = h.select("*", (100 * div(C() - lo, hi - lo)).alias(f"stoch_k_{n}"), (-100 * div(hi - C(), hi - lo)).alias(f"williams_r_{n}"))
        return h.withColumn(f"stoch_d_{n}", rmean(F.col(f"stoch_k_{n}"), d, w))

    return rolled(bars, build, n + d)


def roc(bars: DataFrame, periods=(10, 20), volume_period=10) -> DataFrame:
    def build(h, w):
        cols = [(100 * div(C() - F.lag(C(), n).over(w), F.lag(C(), n).over(w))).alias(f"roc_{n}") for n in periods]
        v = F.lag(V(), volume_period).over(w)
        return h.select("*", *cols, (100 * div(V() - v, v)).alias(f"vroc_{volume_period}"))

    return rolled(bars, build, max(periods))


def cci(bars: DataFrame, n=20) -> DataFrame:
    def build(h, w):
        h = h.withColumn("_tp", TYPICAL()).withColumn("_m", rmean(F.col("_tp"), n, w))
        frame = F.collect_list("_tp").over(w.rowsBetween(1 - n, 0))
        h = h.withColumn("_f", frame)
        mad = F.aggregate("_f", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / n
        return h.withColumn(f"cci_{n}", div(F.col("_tp") - F.col("_m"), 0.015 * mad)).drop("_tp", "_m", "_f")

    return rolled(bars, build, n)


def mfi(bars: DataFrame, n=14) -> DataFrame:
    varied = bars.groupBy("symbol").agg((F.min("volume") != F.max("volume")).alias("_var"))

    def build(h, w):
        h = h.withColumn("_tp", TYPICAL()).withColumn("_pt", F.lag("_tp").over(w))
        tp, pt = F.col("_tp"), F.col("_pt")
        pos = rsum(F.when(tp > pt, tp * V()).otherwise(0.0), n, w)
        neg = rsum(F.when(tp < pt, tp * V()).otherwise(0.0), n, w)
        val = F.when((neg == 0) & (pos > 0), 100.0).when(neg > 0, 100 - div(100.0, 1 + div(pos, neg)))
        return h.withColumn(f"mfi_{n}", F.when(F.col("_var"), val)).drop("_tp", "_pt", "_var")

    return rolled(bars.join(varied, "symbol"), build, n + 1)


def bollinger(bars: DataFrame, n=20, k=2.0) -> DataFrame:
    def build(h, w):
        h = h.select("*", rmean(C(), n, w).alias(f"bb_middle_{n}"), rstd(C(), n, w).alias("_sd"))
        m, sd = F.col(f"bb_middle_{n}"), F.col("_sd")
        return h.select("*", (m + k * sd).alias(f"bb_upper_{n}"), (m - k * sd).alias(f"bb_lower_{n}"),
                        (2 * k * sd).alias(f"bb_width_{n}"), div(C() - (m - k * sd), 2 * k * sd).alias(f"bb_percent_{n}")).drop("_sd")

    return rolled(bars, build, n)


def true_range(w):
    pc = F.lag(C()).over(w)
    return F.greatest(H() - L(), F.abs(H() - pc), F.abs(L() - pc))


def atr(bars: DataFrame, n=14) -> DataFrame:
    def build(h, w):
        h = h.withColumn("true_range", true_range(w))
        return h.withColumn(f"atr_{n}", rmean(F.col("true_range"), n, w))

    return rolled(bars, build, n + 1)


def rolling_std(bars: DataFrame, periods=(20, 50)) -> DataFrame:
    return rolled(bars, lambda h, w: h.select("*", *[rstd(C(), n, w).alias(f"std_{n}") for n in periods]), max(periods))


def channels(bars: DataFrame, n=20) -> DataFrame:
    """Keltner (exponential mean and mean range) and Donchian (extremes)."""
    def build(h, w):
        h = h.withColumn("_tr", true_range(w))
        hi, lo = rmax(H(), n, w), rmin(L(), n, w)
        return h.select("*", rmean(F.col("_tr"), n, w).alias("_atr"), hi.alias(f"dc_upper_{n}"), lo.alias(f"dc_lower_{n}"),
                        ((hi + lo) / 2).alias(f"dc_middle_{n}")).drop("_tr")

    out = ewm(rolled(bars, build, n + 1), {f"kc_middle_{n}": (C(), span(n))})
    m, a = F.col(f"kc_middle_{n}"), F.col("_atr")
    return out.select("*", (m + 2 * a).alias(f"kc_upper_{n}"), (m - 2 * a).alias(f"kc_lower_{n}")).drop("_atr")


def money_flow_multiplier():
    return F.coalesce(div((C() - L()) - (H() - C()), H() - L()), F.lit(0.0))


def volume_totals(bars: DataFrame) -> DataFrame:
    """OBV, accumulation line, price-volume trend and VWAP from the series start."""
    b = rolled(bars, lambda h, w: h.withColumn("_pc", F.lag(C()).over(w)), 1)
    pc = F.col("_pc")
    out = running(b, {
        "obv": (F.coalesce(F.signum(C() - pc) * V(), F.lit(0.0)), "sum"),
        "ad_line": (money_flow_multiplier() * V(), "sum"),
        "pvt": (F.coalesce(div(C() - pc, pc) * V(), F.lit(0.0)), "sum"),
        "_pv": (TYPICAL() * V(), "sum"),
        "_v": (V(), "sum"),
    })
    return out.withColumn("vwap", div(F.col("_pv"), F.col("_v"))).drop("_pv", "_v", "_pc")


def cmf(bars: DataFrame, n=20) -> DataFrame:
    return rolled(bars, lambda h, w: h.withColumn(f"cmf_{n}", div(rsum(money_flow_multiplier() * V(), n, w), rsum(V(), n, w))), n)


def adx(bars: DataFrame, n=14) -> DataFrame:
    def build(h, w):
        h = h.select("*", true_range(w).alias("_tr"), (H() - F.lag(H()).over(w)).alias("_up"), (F.lag(L()).over(w) - L()).alias("_dn"))
        up, dn = F.col("_up"), F.col("_dn")
        h = h.select("*", F.when((up > dn) & (up > 0), up).otherwise(0.0).alias("_p"),
                     F.when((dn > up) & (dn > 0), dn).otherwise(0.0).alias("_m"))
        a = rmean(F.col("_tr"), n, w)
        h = h.select("*", (100 * div(rmean(F.col("_p"), n, w), a)).alias(f"plus_di_{n}"),
                     (100 * div(rmean(F.col("_m"), n, w), a)).alias(f"minus_di_{n}"))
        p, m = F.col(f"plus_di_{n}"), F.col(f"minus_di_{n}")
        h = h.withColumn("_dx", 100 * div(F.abs(p - m), p + m))
        return h.withColumn(f"adx_{n}", rmean(F.col("_dx"), n, w)).drop("_tr", "_up", "_dn", "_p", "_m", "_dx")

    return rolled(bars, build, 2 * n + 2)


def aroon(bars: DataFrame, n=25, textbook=False) -> DataFrame:
    """Position of the first extreme in the last n+1 bars, counted from the oldest."""
    def build(h, w):
        f = w.rowsBetween(-n, 0)
        h = h.select("*", F.count(H()).over(f).alias("_k"), F.collect_list(H()).over(f).alias("_h"), F.collect_list(L()).over(f).alias("_l"))
        up = F.array_position("_h", F.array_max("_h")) - 1
        dn = F.array_position("_l", F.array_min("_l")) - 1
        score = (lambda p: 100.0 * p / n) if textbook else (lambda p: 100.0 * (n - p) / n)
        ok = F.col("_k") == n + 1
        h = h.select("*", F.when(ok, score(up)).alias(f"aroon_up_{n}"), F.when(ok, score(dn)).alias(f"aroon_down_{n}"))
        return h.withColumn(f"aroon_osc_{n}", F.col(f"aroon_up_{n}") - F.col(f"aroon_down_{n}")).drop("_k", "_h", "_l")

    return rolled(bars, build, n)


def ichimoku(bars: DataFrame) -> DataFrame:
    def build(h, w):
        mid = lambda n: (rmax(H(), n, w) + rmin(L(), n, w)) / 2
        h = h.select("*", mid(9).alias("tenkan"), mid(26).alias("kijun"), mid(52).alias("_b"))
        return h.select("*", F.lag((F.col("tenkan") + F.col("kijun")) / 2, 26).over(w).alias("senkou_a"),
                        F.lag("_b", 26).over(w).alias("senkou_b"), F.lead(C(), 26).over(w).alias("chikou")).drop("_b")

    return rolled(bars, build, 52 + 26, 26)


def supertrend(bars: DataFrame, n=10, k=3.0) -> DataFrame:
    """Trend state is the last band crossing; the line is the opposite band."""
    def build(h, w):
        h = h.withColumn("_tr", true_range(w))
        return h.withColumn("_atr", rmean(F.col("_tr"), n, w)).drop("_tr")

    b = rolled(bars, build, n + 1)
    mid = (H() + L()) / 2
    up, lo = mid + k * F.col("_atr"), mid - k * F.col("_atr")
    event = F.when(F.col("seq") >= n, F.when(C() > up, 1).when(C() <= lo, -1))
    b = running(b, {"_state": (event, "last")})
    line = F.when(F.coalesce("_state", F.lit(1)) == 1, lo).otherwise(up)
    return b.withColumn("supertrend", F.when(F.col("seq") >= n, line)).drop("_state", "_atr")


def moments(bars: DataFrame) -> DataFrame:
    """Return volatility 20/50 and bias-corrected rolling skew and kurtosis 20."""
    def build(h, w):
        h = h.withColumn("_r", div(C(), F.lag(C()).over(w)) - 1)
        r, f, n = F.col("_r"), w.rowsBetween(-19, 0), 20
        g1 = full(F.skewness(r), r, f, n) * math.sqrt(n * (n - 1)) / (n - 2)
        g2 = ((n + 1) * full(F.kurtosis(r), r, f, n) + 6) * (n - 1) / ((n - 2) * (n - 3))
        return h.select("*", rstd(r, 20, w).alias("volatility_20d"), rstd(r, 50, w).alias("volatility_50d"),
                        g1.alias("returns_skew_20d"), g2.alias("returns_kurt_20d")).drop("_r")

    return rolled(bars, build, 51)


def catalogue(bars: DataFrame) -> DataFrame:
    """Every windowed indicator in one frame with stable names."""
    def rolling(h, w):
        hi14, lo14, hi20, lo20 = rmax(H(), 14, w), rmin(L(), 14, w), rmax(H(), 20, w), rmin(L(), 20, w)
        mid = lambda n: (rmax(H(), n, w) + rmin(L(), n, w)) / 2
        f26 = w.rowsBetween(-25, 0)
        h = h.select(
            "*", (C() - F.lag(C()).over(w)).alias("_d"), true_range(w).alias("_tr"), TYPICAL().alias("_tp"),
            (H() - F.lag(H()).over(w)).alias("_up"), (F.lag(L()).over(w) - L()).alias("_dn"),
            *[rmean(C(), n, w).alias(f"sma_{n}") for n in (5, 10, 20, 50, 200)],
            *[rweighted(C(), n, w).alias(f"wma_{n}") for n in (10, 20)],
            (100 * div(C() - lo14, hi14 - lo14)).alias("stoch_k_14"), (-100 * div(hi14 - C(), hi14 - lo14)).alias("williams_r_14"),
            *[(100 * div(C() - F.lag(C(), n).over(w), F.lag(C(), n).over(w))).alias(f"roc_{n}") for n in (10, 20)],
            (100 * div(V() - F.lag(V(), 10).over(w), F.lag(V(), 10).over(w))).alias("vroc_10"),
            *[rstd(C(), n, w).alias(f"std_{n}") for n in (20, 50)],
            hi20.alias("dc_upper_20"), lo20.alias("dc_lower_20"), ((hi20 + lo20) / 2).alias("dc_middle_20"),
            div(rsum(money_flow_multiplier() * V(), 20, w), rsum(V(), 20, w)).alias("cmf_20"),
            mid(9).alias("ichimoku_tenkan"), mid(26).alias("ichimoku_kijun"), mid(52).alias("_b52"),
            F.collect_list(H()).over(f26).alias("_h"), F.collect_list(L()).over(f26).alias("_l"))
        m, sd, up, dn, tp = F.col("sma_20"), F.col("std_20"), F.col("_up"), F.col("_dn"), F.col("_tp")
        h = h.select(
            "*", *[_rsi(n, w).alias(f"rsi_{n}") for n in (14, 21)],
            (2 * F.col("wma_10") - F.col("wma_20")).alias("_hull"), rmean(F.col("stoch_k_14"), 3, w).alias("stoch_d_14"),
            rmean(tp, 20, w).alias("_m20"), F.collect_list(tp).over(w.rowsBetween(-19, 0)).alias("_f20"), F.lag(tp).over(w).alias("_ptp"),
            rmean(F.col("_tr"), 14, w).alias("atr_14"), rmean(F.col("_tr"), 20, w).alias("_atr20"),
            (m + 2 * sd).alias("bb_upper_20"), m.alias("bb_middle_20"), (m - 2 * sd).alias("bb_lower_20"), (4 * sd).alias("bb_width_20"),
            div(C() - (m - 2 * sd), 4 * sd).alias("bb_percent_20"),
            F.when((up > dn) & (up > 0), up).otherwise(0.0).alias("_p"), F.when((dn > up) & (dn > 0), dn).otherwise(0.0).alias("_m"),
            F.lag((F.col("ichimoku_tenkan") + F.col("ichimoku_kijun")) / 2, 26).over(w).alias("ichimoku_senkou_a"),
            F.lag("_b52", 26).over(w).alias("ichimoku_senkou_b"), F.lead(C(), 26).over(w).alias("ichimoku_chikou"),
            F.when(F.size("_h") == 26, 100.0 * (26 - F.array_position("_h", F.array_max("_h"))) / 25).alias("aroon_up_25"),
            F.when(F.size("_l") == 26, 100.0 * (26 - F.array_position("_l", F.array_min("_l"))) / 25).alias("aroon_down_25"))
        pos = rsum(F.when(tp > F.col("_ptp"), tp * V()).otherwise(0.0), 14, w)
        neg = rsum(F.when(tp < F.col("_ptp"), tp * V()).otherwise(0.0), 14, w)
        mad = F.aggregate("_f20", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m20"))) / 20
        h = h.select(
            "*", rweighted(F.col("_hull"), 4, w).alias("hma_20"), div(tp - F.col("_m20"), 0.015 * mad).alias("cci_20"),
            F.when((neg == 0) & (pos > 0), 100.0).when(neg > 0, 100 - div(100.0, 1 + div(pos, neg))).alias("mfi_14"),
            (100 * div(rmean(F.col("_p"), 14, w), F.col("atr_14"))).alias("plus_di_14"),
            (100 * div(rmean(F.col("_m"), 14, w), F.col("atr_14"))).alias("minus_di_14"),
            (F.col("aroon_up_25") - F.col("aroon_down_25")).alias("aroon_osc_25"))
        p, q = F.col("plus_di_14"), F.col("minus_di_14")
        h = h.withColumn("_dx", 100 * div(F.abs(p - q), p + q))
        h = h.withColumn("adx_14", rmean(F.col("_dx"), 14, w))
        return h.drop("_d", "_tp", "_up", "_dn", "_h", "_l", "_b52", "_hull", "_m20", "_f20", "_ptp", "_p", "_m", "_dx", "_tr")

    # narrow recurrences first, so the wide rows are shuffled once, at the end
    def narrow(h, w):
        h = h.withColumns({"_pc": F.lag(C()).over(w), "_tr": true_range(w)})
        return h.withColumn("_atr10", rmean(F.col("_tr"), 10, w)).drop("_tr")

    out = ewm(rolled(bars, narrow, 11), {**{f"ema_{n}": (C(), span(n)) for n in (12, 26, 50)}, "kc_middle_20": (C(), span(20))})
    out = out.withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    out = ewm(out, {"macd_signal": (F.col("macd"), span(9))}).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    mid, a10, pc = (H() + L()) / 2, F.col("_atr10"), F.col("_pc")
    up, lo = mid + 3 * a10, mid - 3 * a10
    out = running(out, {
        "obv": (F.coalesce(F.signum(C() - pc) * V(), F.lit(0.0)), "sum"), "ad_line": (money_flow_multiplier() * V(), "sum"),
        "pvt": (F.coalesce(div(C() - pc, pc) * V(), F.lit(0.0)), "sum"), "_pv": (TYPICAL() * V(), "sum"), "_v": (V(), "sum"),
        "_state": (F.when(F.col("seq") >= 10, F.when(C() > up, 1).when(C() <= lo, -1)), "last")})
    line = F.when(F.coalesce("_state", F.lit(1)) == 1, lo).otherwise(up)
    out = out.select("*", div(F.col("_pv"), F.col("_v")).alias("vwap"), F.when(F.col("seq") >= 10, line).alias("supertrend_10_3")).drop("_pv", "_v", "_state", "_atr10", "_pc")
    out = rolled(out, rolling, 200, 26)
    k, a20 = F.col("kc_middle_20"), F.col("_atr20")
    return out.select("*", (k + 2 * a20).alias("kc_upper_20"), (k - 2 * a20).alias("kc_lower_20")).drop("_atr20")


def latest_band_signal(bars: DataFrame, top=5) -> DataFrame:
    """Latest bar per symbol with band position, RSI and a -1/0/1 signal."""
    def build(h, w):
        h = h.select("*", rmean(C(), 20, w).alias("_m"), rstd(C(), 20, w).alias("_sd"), (C() - F.lag(C()).over(w)).alias("_d"), true_range(w).alias("_tr"))
        lower = F.col("_m") - 2 * F.col("_sd")
        return h.select("*", div(C() - lower, 4 * F.col("_sd")).alias("bb_percent_20"), _rsi(14, w).alias("rsi_14"), rmean(F.col("_tr"), 14, w).alias("atr_14"))

    cols = ["close", "bb_percent_20", "rsi_14", "atr_14"]
    last = rolled(bars, build, 21).groupBy("symbol").agg(
        F.max("seq").alias("seq"), *[F.max_by(c, "seq").alias(c) for c in cols])
    b, r = F.col("bb_percent_20"), F.col("rsi_14")
    signal = F.when((b < 0) | (r < 30), 1).when((b > 1) | (r > 70), -1).otherwise(0)
    return last.withColumn("signal", signal).orderBy(F.abs(b - 0.5).desc(), "symbol").limit(top)

"""Runs, regions, n-grams, weighted statistics and the parabolic stop line."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import div, full, number_rows, quantiles, rolled, rstd, run_ids, running
from tapeline.functions.scan import scan

YEAR = 252
RISK_FREE = 0.02


def one():
    return F.count(F.lit(1))


def annual(total: Column, n: Column) -> Column:
    return F.pow(1 + total, YEAR / n) - 1


def rolling_risk(returns: DataFrame, window=252, least=30) -> DataFrame:
    """Return, volatility, Sharpe, drawdown and 5% quantile over the last ``window`` rows."""
    eq = running(returns, {"_eq": (1 + F.col("r"), "product")})
    worst = lambda a: F.aggregate(
        a, F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("dd")),
        lambda s, x: F.struct(F.greatest(s.top, x).alias("top"), F.least(s.dd, (x - F.greatest(s.top, x)) / F.greatest(s.top, x)).alias("dd")),
        lambda s: F.abs(s.dd))

    def build(h, w):
        f, r = w.rowsBetween(1 - window, 0), F.col("r")
        h = h.select("*", F.count(r).over(f).alias("_n"), (F.product(1 + r).over(f) - 1).alias("_t"), F.stddev_samp(r).over(f).alias("_s"),
                     F.percentile(r, F.lit(0.05)).over(f).alias("_v"), F.collect_list("_eq").over(f).alias("_a"))
        ok = lambda c: F.when(F.col("_n") >= least, c)
        vol = F.col("_s") * math.sqrt(YEAR)
        sharpe = F.when(vol == 0, 0.0).otherwise((annual(F.col("_t"), F.col("_n")) - RISK_FREE) / vol)
        return h.select("symbol", "seq", "_c", ok(F.col("_t")).alias("rolling_return"), ok(vol).alias("rolling_volatility"), ok(sharpe).alias("rolling_sharpe"),
                        ok(worst(F.col("_a"))).alias("rolling_max_drawdown"), ok(F.col("_v")).alias("rolling_var"))

    return rolled(eq, build, window)


def equity(returns: DataFrame, by=("symbol",)) -> DataFrame:
    """Equity curve, running peak and drawdown ratio."""
    e = running(returns, {"equity": (1 + F.col("r"), "product")}, by)
    e = running(e, {"peak": (F.col("equity"), "max")}, by)
    return e.withColumn("drawdown", (F.col("equity") - F.col("peak")) / F.col("peak"))


def longest_runs(df: DataFrame, flag: Column, by=("symbol",), names=("longest_true", "longest_false")) -> DataFrame:
    """Longest run of true and of false rows per series."""
    r = run_ids(df.withColumn("_flag", flag), F.col("_flag"), by)
    g = r.groupBy(*by, "run").agg(F.first("_flag").alias("_flag"), one().alias("_n"))
    z = lambda c, n: F.coalesce(F.max(F.when(c, F.col("_n"))), F.lit(0)).alias(n)
    return g.groupBy(*by).agg(z(F.col("_flag"), names[0]), z(~F.col("_flag"), names[1]))


def regions(df: DataFrame, flag: Column, min_length: int, by=("symbol",), value=None) -> DataFrame:
    """Maximal true runs of at least ``min_length`` rows as [start, end)."""
    r = run_ids(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), F.col("_flag"), by).filter("_flag")
    extra = [F.max(value).alias("max_value"), F.avg(value).alias("mean_value")] if value else []
    g = r.groupBy(*by, "run").agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), *extra)
    return g.filter(F.col("end") - F.col("start") >= min_length).withColumn("duration", F.col("end") - F.col("start")).drop("run")


def regime_runs(regimes: DataFrame) -> DataFrame:
    """One row per regime run with its start and the start of the next run."""
    r = run_ids(regimes, F.col("regime"))
    g = r.groupBy("symbol", "run").agg(F.first("regime").alias("regime"), F.min("ts").alias("start_ts"), one().alias("bars"))
    g = g.withColumnRenamed("run", "seq")
    return rolled(g, lambda h, w: h.select("*", F.lead("start_ts").over(w).alias("next_ts"), F.lead("regime").over(w).alias("next_regime")), 0, 1)


def change_points(regimes: DataFrame, min_days: int) -> DataFrame:
    """Changes out of regimes that lasted at least ``min_days`` days."""
    d = F.datediff("next_ts", "start_ts")
    return regime_runs(regimes).filter(F.col("next_ts").isNotNull() & (d >= min_days)).select(
        "symbol", F.col("next_ts").alias("ts"), F.col("regime").alias("from_regime"), F.col("next_regime").alias("to_regime"), d.alias("duration_days"))


def persistence(regimes: DataFrame) -> DataFrame:
    """Duration statistics per regime over closed runs."""
    d = regime_runs(regimes).filter("next_ts IS NOT NULL").select("symbol", "regime", F.datediff("next_ts", "start_ts").alias("days"))
    g = d.groupBy("symbol", "regime").agg(F.avg("days").alias("avg_days"), F.max("days").alias("max_days"), F.min("days").alias("min_days"), F.stddev_pop("days").alias("std_days"), one().alias("occurrences"))
    return g.join(quantiles(d, ["symbol", "regime"], "days", {"median_days": 0.5}), ["symbol", "regime"])


def current_age(regimes: DataFrame) -> DataFrame:
    """Latest regime per symbol and how many rows it has lasted."""
    return regime_runs(regimes).filter("next_ts IS NULL").select("symbol", "regime", F.col("bars").alias("age"))


def ngrams(patterns: DataFrame, n=5, label="type") -> DataFrame:
    """Every full window of ``n`` consecutive labels."""
    d = rolled(patterns, lambda h, w: h.withColumn("gram", F.collect_list(label).over(w.rowsBetween(0, n - 1))), 0, n - 1)
    return d.filter(F.size("gram") == n).select("symbol", "seq", "gram")


def rolling_accuracy(df: DataFrame, correct: Column, sign_match: Column, window=20, sign_window=10) -> DataFrame:
    """Hit rate over up to ``window`` rows and full-frame sign agreement."""
    def build(h, w):
        s = sign_match.cast("double")
        return h.select("symbol", "seq", "_c", F.avg(correct.cast("double")).over(w.rowsBetween(1 - window, 0)).alias("hit_rate"),
                        full(F.avg(s), s, w.rowsBetween(1 - sign_window, 0), sign_window).alias("sign_agreement"))

    return rolled(df, build, window)


def exponential_moments(returns: DataFrame, halflife=60) -> DataFrame:
    """Annualised exponential mean and bias-corrected variance at the last row."""
    last = returns.groupBy("symbol").agg(F.max("seq").alias("_z"))
    d = returns.join(last, "symbol").withColumn("_w", F.pow(F.lit(0.5), (F.col("_z") - F.col("seq")) / halflife))
    w, r = F.col("_w"), F.col("r")
    m = d.groupBy("symbol").agg((F.sum(w * r) / F.sum(w)).alias("_m"))
    g = d.join(m, "symbol").groupBy("symbol").agg(
        F.first("_m").alias("_m"), F.sum(w).alias("s1"), F.sum(w * w).alias("s2"), F.sum(w * (r - F.col("_m")) * (r - F.col("_m"))).alias("q"))
    var = F.col("q") / F.col("s1") * F.col("s1") * F.col("s1") / (F.col("s1") * F.col("s1") - F.col("s2"))
    return g.select("symbol", (F.col("_m") * YEAR).alias("exp_mean"), (var * YEAR).alias("exp_var"))


def training_sequences(patterns: DataFrame, bars: DataFrame, length=15) -> DataFrame:
    """Sliding windows of ``length`` patterns with array moments and symbol volatility."""
    vol = rolled(bars, lambda h, w: h.withColumn("_r", F.try_divide("close", F.lag("close").over(w)) - 1), 1).groupBy("symbol").agg(F.stddev_samp("_r").alias("symbol_volatility"))
    d = rolled(patterns, lambda h, w: h.select("*", F.collect_list(F.struct("type", "strength", "price_change")).over(w.rowsBetween(0, length - 1)).alias("_s")), 0, length - 1)
    d = d.filter(F.size("_s") == length)
    x = F.transform("_s", lambda s: s.price_change)
    total = lambda f: F.aggregate("x", F.lit(0.0), lambda a, v: a + f(v))
    d = d.select("symbol", "seq", x.alias("x"), F.array_join(F.transform("_s", lambda s: s.type), ">").alias("types"))
    n = float(length)
    d = d.withColumn("mean", total(lambda v: v) / n)
    dev = lambda k: total(lambda v: F.pow(v - F.col("mean"), k)) / n
    d = d.select("*", dev(2.0).alias("m2"), dev(3.0).alias("m3"), dev(4.0).alias("m4"), total(lambda v: v * v).alias("energy"), F.array_max(F.transform("x", F.abs)).alias("max_abs"))
    share = lambda v: v * v / F.col("energy")
    ent = -total(lambda v: share(v) * F.log2(share(v) + 1e-10))
    return d.join(vol, "symbol").select("symbol", "seq", "types", "max_abs", "energy", ent.alias("entropy"), div(F.col("m3"), F.pow("m2", F.lit(1.5))).alias("skew"),
                                        (div(F.col("m4"), F.col("m2") * F.col("m2")) - 3).alias("kurt"), "symbol_volatility")


def parabolic_sar(bars: DataFrame, step=0.02, top=0.2) -> DataFrame:
    """Stop-and-reverse line.  A reversal resets the state, so chunk ends settle quickly."""

    def kernel(a, state):
        high, low, line = a["high"], a["low"], np.empty(len(a["high"]))
        i = 0
        if state is None:
            bull, af, ep, sar = True, step, high[0], a["close"][0]
            line[0], i = sar, 1
        else:
            bull, af, ep, sar = state["bull"], state["af"], state["ep"], state["sar"]
        for i in range(i, len(high)):
            sar = sar + af * (ep - sar)
            beyond = high[i] if bull else low[i]
            if (low[i] < sar) if bull else (high[i] > sar):
                sar, bull, af = ep, not bull, step
                ep = high[i] if bull else low[i]
            elif (beyond > ep) if bull else (beyond < ep):
                ep, af = beyond, min(af + step, top)
            line[i] = sar
        return {"psar": line}, {"bull": bool(bull), "af": float(af), "ep": float(ep), "sar": float(sar)}

    return scan(bars, ["high", "low", "close"], kernel, {"psar": "double"}, "struct<bull:boolean,af:double,ep:double,sar:double>")

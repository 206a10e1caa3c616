"""Risk, trade, backtest and model-evaluation reports.

Ratios that are infinite for a zero denominator are NULL here.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tapeline.functions import arrays as A
from tapeline.functions.frames import div, number_rows, quantiles, ranked_values, rolled, run_ids, running
from tapeline.functions.scan import scan
from tapeline.operators.aggregates import cut_bin, share
from tapeline.operators.joins import first_touch
from tapeline.operators.sequences import RISK_FREE, YEAR, annual, equity, longest_runs

# Standard normal quantiles at 95% and 99%.
Z95 = 1.6448536269514722
Z99 = 2.3263478740408408


def one():
    return F.count(F.lit(1))


def zero(c, name=None):
    return F.coalesce(c, F.lit(0.0))


def drawdowns(returns: DataFrame, by) -> DataFrame:
    """Maximum and average drawdown and the longest stretch under water."""
    e = equity(returns, by)
    g = e.groupBy(*by).agg(F.abs(F.min("drawdown")).alias("max_drawdown"), zero(F.abs(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))))).alias("average_drawdown"))
    return g.join(longest_runs(e, F.col("drawdown") < 0, by, ("max_duration", "_u")).drop("_u"), list(by))


def risk_metrics(returns: DataFrame, by=("symbol",), rf=RISK_FREE, confidence=0.95) -> DataFrame:
    """Return, volatility, ratios, tails and drawdown per series in one table."""
    by, r = list(by), F.col("r")
    q = quantiles(returns, by, "r", {"value_at_risk": 1 - confidence, "_q05": 0.05, "_q95": 0.95})
    tail = returns.join(q, by).filter(r <= F.col("value_at_risk")).groupBy(*by).agg(F.avg("r").alias("cvar"))
    g = returns.groupBy(*by).agg(
        one().alias("n"), (F.product(1 + r) - 1).alias("total_return"), (F.stddev_pop(r) * math.sqrt(YEAR)).alias("volatility"),
        zero(F.stddev_pop(F.when(r < 0, r)) * math.sqrt(YEAR)).alias("downside_volatility"), F.skewness(r).alias("skewness"), F.kurtosis(r).alias("kurtosis"),
        div(F.sum(F.when(r > 0, r)), -F.sum(F.when(r <= 0, r))).alias("omega_ratio"))
    g = g.withColumn("annual_return", annual(F.col("total_return"), F.col("n")))
    g = g.join(q, by).join(tail, by).join(drawdowns(returns, by), by)
    a, dd = F.col("annual_return"), F.col("max_drawdown")
    return g.select(
        *by, "n", "total_return", "annual_return", "volatility", "downside_volatility", zero(div(a - rf, F.col("volatility"))).alias("sharpe_ratio"),
        zero(div(a - rf, F.col("downside_volatility"))).alias("sortino_ratio"), div(a, dd).alias("calmar_ratio"), div(F.col("total_return"), dd).alias("recovery_factor"),
        "max_drawdown", "average_drawdown", F.col("max_duration").alias("max_drawdown_duration"), "value_at_risk", "cvar", "skewness", "kurtosis",
        div(F.col("_q95"), F.abs("_q05")).alias("tail_ratio"), "omega_ratio")


def benchmark_metrics(returns: DataFrame, benchmark: DataFrame, on="ts", rf=RISK_FREE) -> DataFrame:
    """Information ratio, beta (ddof 1 over ddof 0) and alpha against ``benchmark(on, bench)``."""
    j = returns.join(benchmark, on)
    r, b = F.col("r"), F.col("bench")
    ann = lambda x: F.pow(F.product(1 + x), YEAR / one()) - 1
    g = j.groupBy("symbol").agg(ann(r - b).alias("_aa"), (F.stddev_pop(r - b) * math.sqrt(YEAR)).alias("_te"), F.covar_samp(r, b).alias("_cv"), F.var_pop(b).alias("_vb"), ann(r).alias("_ar"), ann(b).alias("_ab"))
    beta = F.coalesce(div(F.col("_cv"), F.col("_vb")), F.lit(1.0))
    return g.select("symbol", zero(div(F.col("_aa"), F.col("_te"))).alias("information_ratio"), beta.alias("beta"), (F.col("_ar") - (rf + beta * (F.col("_ab") - rf))).alias("alpha"))


def trade_statistics(trades: DataFrame, by, pnl: str) -> DataFrame:
    """Win rate, profit factor, expectancy, average win and loss, capped Kelly share."""
    x = F.col(pnl)
    g = trades.groupBy(*by).agg(
        one().alias("trades"), share(x > 0).alias("win_rate"), div(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))).alias("profit_factor"),
        zero(F.avg(F.when(x > 0, x))).alias("avg_win"), zero(F.avg(F.when(x < 0, x))).alias("_l"))
    wr, aw, al = F.col("win_rate"), F.col("avg_win"), F.abs("_l")
    ratio = div(aw, al)
    kelly = F.least(F.greatest(div(wr * ratio - (1 - wr), ratio), F.lit(0.0)), F.lit(0.25))
    return g.select(*by, "trades", "win_rate", "profit_factor", (wr * aw + (1 - wr) * F.col("_l")).alias("expectancy"), "avg_win", al.alias("avg_loss"),
                    F.when(al == 0, 0.0).otherwise(zero(kelly)).alias("kelly"))


def dual_var(returns: DataFrame) -> DataFrame:
    """Lower of parametric and historical VaR at 95/99, conditional means, and ratios."""
    r = F.col("r")
    g = returns.groupBy("symbol").agg(F.avg(r).alias("_m"), F.stddev_pop(r).alias("_s0"), F.stddev_samp(r).alias("_s1"), F.stddev_samp(F.when(r < 0, r)).alias("_ds"))
    g = g.join(quantiles(returns, ["symbol"], "r", {"_h95": 0.05, "_h99": 0.01}), "symbol")
    g = g.select("*", F.least(F.col("_m") - Z95 * F.col("_s0"), F.col("_h95")).alias("_v95"), F.least(F.col("_m") - Z99 * F.col("_s0"), F.col("_h99")).alias("_v99"))
    c = returns.join(g.select("symbol", "_v95", "_v99"), "symbol").groupBy("symbol").agg(F.avg(F.when(r <= F.col("_v95"), r)).alias("_c95"), F.avg(F.when(r <= F.col("_v99"), r)).alias("_c99"))
    dd = equity(returns).groupBy("symbol").agg(F.abs(F.min("drawdown")).alias("max_drawdown"))
    year = math.sqrt(YEAR)
    return g.join(c, "symbol").join(dd, "symbol").select(
        "symbol", F.abs("_v95").alias("var_95"), F.abs("_v99").alias("var_99"), F.abs(F.coalesce("_c95", "_v95")).alias("cvar_95"), F.abs(F.coalesce("_c99", "_v99")).alias("cvar_99"), "max_drawdown",
        zero(div(F.col("_m"), F.col("_s1")) * year).alias("sharpe_ratio"), zero(div(F.col("_m"), F.coalesce("_ds", "_s1")) * year).alias("sortino_ratio"), zero(div(F.col("_m") * YEAR, F.col("max_drawdown"))).alias("calmar_ratio"))


# Stress scenarios as (kind, size).
SCENARIOS = {
    "market_crash": ("shock", -0.20),
    "flash_crash": ("shock", -0.10),
    "volatility_spike": ("scale", 3.0),
    "correlation_breakdown": ("scale", -1.0),
    "black_swan": ("shock", -0.30),
}


def stress(returns: DataFrame, scenarios=None) -> DataFrame:
    """Risk metrics per symbol and scenario: scaled returns or one shocked middle row."""
    s = scenarios or SCENARIOS
    dim = returns.sparkSession.createDataFrame([(k, *v) for k, v in s.items()], "scenario string, kind string, size double")
    mid = returns.groupBy("symbol").agg(F.floor(one() / 2).alias("_mid"))
    d = returns.join(mid, "symbol").crossJoin(F.broadcast(dim))
    r = F.when(F.col("kind") == "scale", F.col("r") * F.col("size")).when(F.col("seq") == F.col("_mid"), F.col("size")).otherwise(F.col("r"))
    return risk_metrics(d.withColumn("r", r), ("symbol", "scenario")).select("symbol", "scenario", "total_return", "max_drawdown", "sharpe_ratio", F.col("value_at_risk").alias("var_95"), F.col("cvar").alias("cvar_95"))


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted return per date."""
    return returns.join(weights, "symbol").groupBy("ts").agg(F.sum(F.col("r") * F.col("weight")).alias("r"))


def worst_days(returns: DataFrame, k=5) -> DataFrame:
    """Mean of the k smallest returns."""
    return returns.orderBy("r").limit(k).agg(F.avg("r").alias("worst"))


def portfolio_stress(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Historical worst days, crash, doubled volatility and joint single-asset minima."""
    p = portfolio_returns(returns, weights)
    low = returns.groupBy("symbol").agg(F.min("r").alias("m")).agg(F.avg("m").alias("correlation_breakdown"))
    return worst_days(p).select(F.col("worst").alias("historical_worst")).crossJoin(weights.agg((F.sum("weight") * -0.20).alias("market_crash"))).crossJoin(
        p.agg((F.stddev_samp("r") * -4).alias("high_volatility"))).crossJoin(low)


def assess_portfolio(returns: DataFrame, weights: DataFrame, pairs: DataFrame, max_weight=0.25, max_corr=0.8, max_var=0.02) -> DataFrame:
    """Concentration, correlation, diversification, VaR use and warnings; ``pairs`` has a < b corr."""
    p = portfolio_returns(returns, weights).withColumn("symbol", F.lit("portfolio"))
    q = quantiles(p, ["symbol"], "r", {"_h": 0.05})
    m = p.groupBy("symbol").agg(F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s0"), F.stddev_samp("r").alias("portfolio_vol")).join(q, "symbol")
    m = m.withColumn("var_95", F.abs(F.least(F.col("_m") - Z95 * F.col("_s0"), F.col("_h"))))
    c = pairs.filter("a < b").agg(F.avg("corr").alias("average_correlation"), F.max("corr").alias("maximum_correlation"))
    v = returns.groupBy("symbol").agg(F.stddev_samp("r").alias("_v")).join(weights, "symbol").agg(F.sum(F.col("_v") * F.col("weight")).alias("_wv"), F.max("weight").alias("concentration"))
    x = m.crossJoin(c).crossJoin(v).withColumn("diversification_ratio", div(F.col("_wv"), F.col("portfolio_vol"))).withColumn("risk_utilization", F.col("var_95") / max_var)
    warn = F.array_compact(F.array(
        F.when(F.col("concentration") > max_weight, "High concentration risk"), F.when(F.col("maximum_correlation") > max_corr, "High correlation risk"),
        F.when(F.col("risk_utilization") > 0.8, "High risk utilization")))
    return x.select("concentration", "average_correlation", "maximum_correlation", "diversification_ratio", "var_95", "risk_utilization", warn.alias("warnings"))


def position_size(signals: DataFrame, portfolio=100000.0, max_risk=0.02, max_weight=0.25) -> DataFrame:
    """Blend of fixed-fraction, volatility-target and Kelly sizes over (entry, stop, confidence, volatility)."""
    e, s, conf, vol = F.col("entry"), F.col("stop"), F.col("confidence"), F.col("volatility")
    risk = F.abs(e - s)
    fixed = div(portfolio * max_risk, risk)
    target = F.when(vol > 0, 0.02 / vol * portfolio / e).otherwise(fixed)
    win, loss = 0.5 + conf * 0.3, risk / e
    kelly = F.when(loss > 0, F.greatest(F.lit(0.0), F.least((win * 0.02 - (1 - win) * loss) / 0.02, F.lit(0.25)))).otherwise(0.1)
    base = 0.4 * fixed + 0.3 * target + 0.3 * kelly * portfolio / e
    cap = portfolio * max_weight / e
    return signals.select("*", kelly.alias("kelly_fraction"), base.alias("base_size"), F.least(base * conf, cap).alias("final_size"), cap.alias("max_size"), (e + 2 * risk).alias("take_profit"))


def trade_report(trades: DataFrame, order, bucket, by=("symbol",), r="net_return") -> DataFrame:
    """Backtest summary of a trade log; trades are ordered before the drawdown."""
    x = F.col(r)
    t = number_rows(trades, order, bucket, by).withColumn("r", x)
    dd = equity(t, by).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))
    g = t.groupBy(*by).agg(
        one().alias("trades"), F.count_if(x > 0).alias("winning"), F.count_if(x <= 0).alias("losing"), F.sum(x).alias("total_return"), share(x > 0).alias("win_rate"),
        zero(F.avg(F.when(x > 0, x))).alias("avg_win"), zero(F.avg(F.when(x <= 0, x))).alias("avg_loss"),
        zero(div(F.avg(x), F.stddev_pop(x)) * math.sqrt(YEAR)).alias("sharpe_ratio"), div(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x <= 0, x)))).alias("profit_factor"))
    return g.join(dd, list(by))


def forecast_backtest(f: DataFrame, horizon: int, least=5, by=("symbol",)) -> DataFrame:
    """Report over (seq, r, kind, hit) forecasts: win rate, cumulative drawdown, Sharpe, streaks, type accuracy."""
    by, r = list(by), F.col("r")
    c = running(running(f, {"_cum": (r, "sum")}, by), {"_t": (F.col("_cum"), "max")}, by)
    dd = c.groupBy(*by).agg(F.max(F.col("_t") - F.col("_cum")).alias("max_drawdown"))
    g = f.groupBy(*by).agg(one().alias("forecasts"), share(r > 0).alias("win_rate"), F.avg(r).alias("avg_return"), div(F.sum(F.when(r > 0, r)), F.abs(F.sum(F.when(r < 0, r)))).alias("profit_factor"),
                           zero(div(F.avg(r), F.stddev_pop(r)) * math.sqrt(YEAR / horizon)).alias("sharpe_ratio"))
    t = f.groupBy(*by, "kind").agg(one().alias("_n"), share(F.col("hit")).alias("_a")).filter(F.col("_n") >= least)
    best = t.groupBy(*by).agg(F.max("_a").alias("best_type_accuracy"), F.avg("_a").alias("mean_type_accuracy"))
    return g.join(dd, by).join(longest_runs(f, r > 0, by, ("max_wins", "max_losses")), by).join(best, by, "left")


def flip_trades(signals: DataFrame) -> DataFrame:
    """Entry and exit rows of a long/short rule that goes flat on the opposite signal.

    ``signals`` has (symbol, seq, sig, price) with sig in +1, -1.
    """
    def kernel(a, state):
        pos, px = (state["pos"], state["px"]) if state else (0, 0.0)
        kind, ret = [], []
        for s, p in zip(a["sig"], a["price"]):
            if pos == 0:
                pos, px = int(s), float(p)
                kind.append("entry_long" if pos > 0 else "entry_short")
                ret.append(None)
            elif s == -pos:
                kind.append("exit")
                ret.append(float(pos * (p - px) / px))
                pos, px = 0, 0.0
            else:
                kind.append(None)
                ret.append(None)
        return {"kind": kind, "trade_return": ret}, {"pos": pos, "px": px}

    return scan(signals, ["sig", "price"], kernel, {"kind": "string", "trade_return": "double"}, "struct<pos:int,px:double>").filter("kind IS NOT NULL")


def signal_ledger(signals: DataFrame, value=10000.0, slippage=0.0005, commission=0.001, take=0.25, stop=0.20, hold=20) -> DataFrame:
    """One fixed-notional trade per signal with slippage, commission and first-touch exit."""
    side = F.col("side")
    entry = F.col("close") * (1 + side * slippage)
    t = first_touch(signals, take, stop, hold, side, side.isNotNull(), entry, at_end=True)
    t = t.withColumn("entry_price", entry).withColumn("quantity", value / F.col("entry_price")).withColumn("exit_price", F.col("exit_px") * (1 - side * slippage))
    gross = side * F.col("quantity") * (F.col("exit_price") - F.col("entry_price"))
    fees = commission * (value + F.col("quantity") * F.col("exit_price"))
    return t.select("symbol", "seq", "exit_seq", "side", "entry_price", "exit_price", "quantity", fees.alias("commission"), (gross - fees).alias("pnl"), "reason")


def walk_forward_summary(returns: DataFrame, window: int) -> DataFrame:
    """Per-window return, Sharpe and drawdown, combined per symbol."""
    d = returns.withColumn("window", F.floor(F.col("seq") / window)).withColumn("seq", F.col("seq") % window)
    by = ["symbol", "window"]
    g = d.groupBy(*by).agg((F.product(1 + F.col("r")) - 1).alias("t"), zero(div(F.avg("r") * YEAR - RISK_FREE, F.stddev_samp("r") * math.sqrt(YEAR))).alias("s"))
    g = g.join(equity(d, by).groupBy(*by).agg(F.abs(F.min("drawdown")).alias("d")), by)
    return g.groupBy("symbol").agg(one().alias("windows"), F.avg("t").alias("mean_return"), F.stddev_pop("t").alias("std_return"), F.avg("s").alias("mean_sharpe"), F.stddev_pop("s").alias("std_sharpe"),
                                   F.avg("d").alias("mean_max_drawdown"), F.max("d").alias("worst_drawdown"), share(F.col("t") > 0).alias("consistency"))


def equity_ratios(returns: DataFrame, rf=RISK_FREE) -> DataFrame:
    """Arithmetic Sharpe and calendar-day Calmar of an equity curve."""
    e = equity(returns)
    g = e.groupBy("symbol").agg(
        zero(div(F.avg("r") * YEAR - rf, F.stddev_samp("r") * math.sqrt(YEAR))).alias("sharpe_ratio"), F.min_by("equity", "seq").alias("_a"), F.max_by("equity", "seq").alias("_z"),
        (F.datediff(F.max("ts"), F.min("ts")) / 365.25).alias("years"), F.abs(F.min("drawdown")).alias("max_drawdown"))
    ann = F.pow(F.col("_z") / F.col("_a"), div(1.0, F.col("years"))) - 1
    return g.select("symbol", "sharpe_ratio", ann.alias("annual_return"), "max_drawdown", div(ann, F.col("max_drawdown")).alias("calmar_ratio"))


def regression_report(p: DataFrame, by) -> DataFrame:
    """Error metrics of (seq, y_true, y_pred) per group; direction compares successive rows."""
    by = list(by)
    y, h = F.col("y_true"), F.col("y_pred")
    e = y - h
    d = rolled(p.select("symbol", "seq", *[b for b in by if b != "symbol"], "y_true", "y_pred"),
               lambda f, w: f.withColumn("_dir", (y > F.lag(y).over(w)) == (h > F.lag(h).over(w))), 1)
    d = d.withColumn("_e", e).withColumn("_ae", F.abs(e))
    g = d.groupBy(*by).agg(
        one().alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg("_ae").alias("mae"), F.avg(F.abs(div(e, y))).alias("mape"),
        (1 - div(F.avg(e * e), F.var_pop(y))).alias("r2"), (1 - div(F.var_pop(e), F.var_pop(y))).alias("explained_variance"), F.avg(e).alias("mean_residual"), F.stddev_pop(e).alias("std_residual"),
        F.skewness(e).alias("skew_residual"), F.kurtosis(e).alias("kurtosis_residual"), F.max("_ae").alias("max_error"), F.avg(F.col("_dir").cast("double")).alias("directional_accuracy"))
    return g.join(quantiles(d, by, "_ae", {"percentile_95_error": 0.95}), by)


def confusion(p: DataFrame, by=()) -> DataFrame:
    return p.groupBy(*by, "actual", "pred").agg(one().alias("n"))


def class_metrics(p: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, and a support-weighted row."""
    c = confusion(p)
    a = c.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    b = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    m = a.join(b, "label", "left")
    pr, rc = zero(div(F.col("tp"), F.col("predicted"))), zero(div(F.col("tp"), F.col("support")))
    m = m.withColumn("precision", pr).withColumn("recall", rc)
    m = m.withColumn("f1", zero(div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("label", "support", "precision", "recall", "f1")
    w = lambda k: (F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k)
    return m.unionByName(m.agg(F.lit("weighted").alias("label"), F.sum("support").alias("support"), w("precision"), w("recall"), w("f1")))


def binary_scores(p: DataFrame, by) -> DataFrame:
    """Accuracy, log loss and rank-sum AUC of (prob, up) per group."""
    by = list(by)
    y, q = F.col("up"), F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-15)), F.lit(1e-15))
    r = ranked_values(p, by, "prob").select(*by, "prob", (F.col("below") + (F.col("n") + 1) / 2).alias("_rank"))
    g = p.join(r, [*by, "prob"]).groupBy(*by).agg(
        share((F.col("prob") > 0.5) == y).alias("accuracy"), (-F.avg(F.when(y, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"),
        F.sum(F.when(y, F.col("_rank"))).alias("_rs"), F.count_if(y).alias("_p"), F.count_if(~y).alias("_q"))
    auc = div(F.col("_rs") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q"))
    return g.select(*by, "accuracy", "log_loss", auc.alias("auc"))


def signal_returns(p: DataFrame, cost=0.001) -> DataFrame:
    """Returns of following the sign of the prediction into the next row."""
    def build(h, w):
        return h.select("symbol", "seq", "_c", (F.signum("y_pred") * F.lead("y_true").over(w)).alias("s"), (F.signum("y_pred") != F.lag(F.signum("y_pred")).over(w)).alias("_chg"))

    d = rolled(p, build, 1, 1)
    s, x = F.col("s"), d.filter("s IS NOT NULL")
    c = running(x.select("symbol", "seq", "s"), {"_c2": (s, "sum")})
    c = running(c, {"_t": (F.col("_c2"), "max")})
    dd = c.groupBy("symbol").agg(F.min((F.col("_c2") - F.col("_t")) / (F.col("_t") + 1e-6)).alias("max_drawdown"))
    g = d.groupBy("symbol").agg(F.sum(s).alias("_s"), F.avg(s).alias("_m"), F.stddev_pop(s).alias("_sd"), F.count_if(F.col("_chg")).alias("number_of_trades"), share(s > 0).alias("_w"), one().alias("_n"),
                                F.sum(F.when(s > 0, s).otherwise(0.0)).alias("_g"), F.abs(F.sum(F.when(s < 0, s).otherwise(0.0))).alias("_l"))
    net = F.col("_s") - F.col("number_of_trades") * cost
    return g.join(dd, "symbol").select("symbol", net.alias("total_return"), (F.col("_m") / (F.col("_sd") + 1e-6) * math.sqrt(YEAR)).alias("sharpe_ratio"), "max_drawdown", F.col("_w").alias("win_rate"),
                                       (F.col("_g") / (F.col("_l") + 1e-6)).alias("profit_factor"), "number_of_trades", (net / (F.col("number_of_trades") + 1e-6)).alias("avg_return_per_trade"))


def paired_test(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Paired t statistic and effect size of two performance columns."""
    d = F.col(a) - F.col(b)
    g = scores.agg(one().alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_pop(a).alias("std_a"), F.stddev_pop(b).alias("std_b"), F.avg(d).alias("_m"), F.stddev_samp(d).alias("_s"), F.stddev_pop(d).alias("_p"))
    t = div(F.col("_m") * F.sqrt("n"), F.col("_s"))
    p = t_tail(t, F.col("n") - 1)
    who = F.when(p < 0.05, F.when(F.col("_m") > 0, a).otherwise(b)).otherwise("No significant difference")
    return g.select("n", "mean_a", "mean_b", "std_a", "std_b", t.alias("t_statistic"), div(F.col("_m"), F.col("_p")).alias("effect_size"), p.alias("p_value"), who.alias("winner"))


@F.pandas_udf(DoubleType())
def t_tail(t: pd.Series, freedom: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t: Simpson's rule over cos(x)^(freedom - 1) with 2,000 steps; one value per report, not per row."""

    def one_tail(x, v):
        if not (x == x and v >= 1):
            return None
        x = np.linspace(0, math.atan(min(abs(x), 40.0) / math.sqrt(v)), 2001)
        y = np.cos(x) ** (v - 1)
        area = (x[1] - x[0]) / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())
        return max(0.0, 1 - 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * area)

    return pd.Series([one_tail(a, b) for a, b in zip(t, freedom)], dtype="float64")


def normal_cdf(x: Column) -> Column:
    """Standard normal CDF for x >= 0 (Abramowitz-Stegun 26.2.17, error below 7.5e-8)."""
    k = 1 / (1 + 0.2316419 * x)
    # Polynomial coefficients of the published approximation.
    coef = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]
    poly = reduce(lambda acc, c: acc * k + c, reversed(coef), F.lit(0.0)) * k
    return 1 - F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly


def calibration(p: DataFrame, hit: Column, bins=10, closed="right") -> DataFrame:
    """Reliability table.  Right-closed bins drop probability 0, left-closed drop 1."""
    b = F.ceil(F.col("prob") * bins) - 1 if closed == "right" else F.floor(F.col("prob") * bins)
    d = p.withColumn("bin", b.cast("long")).withColumn("_h", hit.cast("double")).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    g = d.groupBy("bin").agg(one().alias("n"), F.avg("prob").alias("mean_prob"), F.avg("_h").alias("accuracy"))
    return g.withColumn("std_error", F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")))


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def error_profile(p: DataFrame) -> DataFrame:
    """Error mean, population std and slope of |error| on confidence, overall and per hour with quartiles."""
    d = p.withColumn("err", F.col("y_true") - F.col("y_pred")).withColumn("hour", F.hour("ts"))
    q = quantiles(d, ["hour"], "err", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    g = d.groupBy("hour").agg(one().alias("n"), F.avg("err").alias("mean"), F.stddev_pop("err").alias("std"), F.regr_slope(F.abs("err"), "prob").alias("confidence_slope"))
    return g.join(q, "hour")


def horizon_accuracy(p: DataFrame, horizons=(1, 3, 5)) -> DataFrame:
    """Share of rows whose predicted class equals the actual class h steps ahead, per class."""
    steps = rolled(p.select("symbol", "seq", "pred", "actual"), lambda h, w: h.select("symbol", "seq", "_c", "pred", F.array(*[F.struct(F.lit(k).alias("horizon"), F.lead("actual", k - 1).over(w).alias("a")) for k in horizons]).alias("s")), 0, max(horizons))
    d = steps.select("pred", F.explode("s").alias("s")).filter("s.a IS NOT NULL")
    return d.groupBy(F.col("s.horizon").alias("horizon"), "pred").agg(one().alias("support"), share(F.col("pred") == F.col("s.a")).alias("accuracy"))


def hash_split(df: DataFrame, keys, test_percent=20, name="part") -> DataFrame:
    """Deterministic train/test tag from the key digest; independent of partitioning and engine."""
    return df.withColumn(name, F.when(A.key_below(keys, test_percent / 100), "test").otherwise("train"))


def cost_report(trades: DataFrame) -> DataFrame:
    return trades.agg(one().alias("trades"), F.sum("commission").alias("total_commission"), F.avg("commission").alias("average_commission"),
                      (F.sum("commission") / F.sum(F.col("quantity") * F.col("price"))).alias("commission_share"), F.sum("slippage").alias("total_slippage"), F.avg("slippage").alias("average_slippage"),
                      F.max(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("largest_win"), F.min(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("largest_loss"))


def cost_columns(trades: DataFrame, spread=0.0001, impact=0.0005, rate=0.001, minimum=1.0) -> DataFrame:
    """Spread, tiered market impact and commission with a floor; (side, quantity, close, volume)."""
    share_of = div(F.col("quantity"), F.col("volume"))
    imp = F.when(F.col("volume") == 0, impact).when(share_of < 0.01, 0.0).when(share_of < 0.05, impact * share_of * 20).otherwise(impact * share_of * 50)
    way = F.col("side")
    px = F.col("close") * (1 + way * spread) * (1 + way * imp)
    d = trades.withColumn("market_impact", imp).withColumn("fill_price", px)
    return d.select("*", F.greatest(F.col("quantity") * F.col("fill_price") * rate, F.lit(minimum)).alias("commission"), (F.abs(F.col("fill_price") - F.col("close")) * F.col("quantity")).alias("slippage"))


def average_cost(trades: DataFrame, by="symbol") -> DataFrame:
    """Average-cost book per key in time order: (seq, side, quantity, price, commission)."""
    def kernel(a, state):
        st = state or {"open": False, "qty": 0.0, "cost": 0.0, "avg": 0.0}
        held, qty, cost, avg = st["open"], st["qty"], st["cost"], st["avg"]
        out = {"position": [], "average_price": [], "realized_pnl": []}
        for side, q, p, fee in zip(*(a[c].tolist() for c in ("side", "quantity", "price", "commission"))):
            pnl = None
            if not held:
                held, qty, cost, avg = True, side * q, q * p, p
            elif side > 0:
                qty, cost = qty + q, cost + q * p
                avg = cost / qty if qty != 0 else 0.0
            else:
                full = abs(qty) <= q
                basis = cost if full else avg * q
                pnl = (q * p - basis if qty > 0 else basis - q * p) - fee
                if full:
                    held, qty, cost, avg = False, 0.0, 0.0, 0.0
                else:
                    qty -= q
                    cost = avg * qty
            out["position"].append(float(qty))
            out["average_price"].append(float(avg))
            out["realized_pnl"].append(None if pnl is None else float(pnl))
        return out, {"open": bool(held), "qty": float(qty), "cost": float(cost), "avg": float(avg)}

    return scan(trades, ["side", "quantity", "price", "commission"], kernel, {"position": "double", "average_price": "double", "realized_pnl": "double"},
                "struct<open:boolean,qty:double,cost:double,avg:double>", by)


def mark_to_market(book: DataFrame, last_price: DataFrame, by="symbol") -> DataFrame:
    """Realised total, open position and unrealised pnl at the last price."""
    g = book.groupBy(by).agg(zero(F.sum("realized_pnl")).alias("realized"), F.max_by("position", "seq").alias("position"), F.max_by("average_price", "seq").alias("average_price"))
    return g.join(last_price, by).withColumn("unrealized", F.col("position") * (F.col("last_price") - F.col("average_price")))

"""Cross-sectional moments: covariance, correlation and portfolio quantities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import div, number_rows

YEAR = 252


def calendar_age(returns: DataFrame) -> DataFrame:
    """Returns with ``age``: trading days between the row and the newest date of the panel."""
    days = number_rows(returns.select("ts").distinct().withColumn("_k", F.lit(0)), [F.col("ts").desc()], -F.floor(F.unix_timestamp("ts") / (86400 * 1024)), by=["_k"], name="age")
    return returns.join(days.drop("_k"), "ts")


def pair_moments(returns: DataFrame, weight: Column | None = None, block=256, days=256) -> DataFrame:
    """Weighted co-moments of every symbol pair over their common dates.

    Rows (a, b, n, sw, sw2, sa, sb, saa, sbb, sab) with a <= b.  Symbols are grouped
    into blocks; one task multiplies the (dates x symbols) tiles of a block pair
    for a slice of dates, so no per-date pair rows are produced.  The slices are
    then added up by (a, b).
    """
    ids = number_rows(returns.select("symbol").distinct().withColumn("_k", F.lit(0)), ["symbol"], F.lit(0), by=["_k"], name="idx").drop("_k")
    w = F.lit(1.0) if weight is None else weight
    mean = returns.groupBy("symbol").agg(F.avg("r").alias("_m"))
    x = returns.withColumn("w", w).join(mean, "symbol").join(ids, "symbol").select(
        "symbol", "ts", "w", (F.col("r") - F.col("_m")).alias("r"), F.floor(F.col("idx") / block).alias("blk"), F.floor(F.unix_timestamp("ts") / (86400 * days)).alias("slice"))
    top = ids.agg(F.floor(F.max("idx") / block).alias("_top"))
    x = x.crossJoin(F.broadcast(top))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_top")), lambda o: F.struct(F.least(o, F.col("blk")).alias("p"), F.greatest(o, F.col("blk")).alias("q")))
    x = x.withColumn("_pq", F.explode(pairs)).select("symbol", "ts", "w", "r", "slice", "blk", "_pq.p", "_pq.q")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.blk == pdf.p], pdf[pdf.blk == pdf.q]
        dates = pd.Index(pdf.ts.unique())

        def mats(d):
            names = pd.Index(sorted(d.symbol.unique()))
            v = np.zeros((len(dates), len(names)))
            m = np.zeros_like(v)
            i, j = dates.get_indexer(d.ts), names.get_indexer(d.symbol)
            v[i, j], m[i, j] = d.r, 1.0
            return names, v, m

        wt = pdf.drop_duplicates("ts").set_index("ts").w.reindex(dates).to_numpy()[:, None]
        na, va, ma = mats(left)
        nb, vb, mb = mats(right)
        parts = {"n": ma.T @ mb, "sw": (wt * ma).T @ mb, "sw2": (wt * wt * ma).T @ mb, "sa": (wt * va).T @ mb, "sb": (wt * ma).T @ vb,
                 "saa": (wt * va * va).T @ mb, "sbb": (wt * ma).T @ (vb * vb), "sab": (wt * va).T @ vb}
        out = pd.DataFrame({"a": np.repeat(na, len(nb)), "b": np.tile(nb, len(na)), **{k: p.ravel() for k, p in parts.items()}})
        return out[(out.n > 0) & (out.a <= out.b)]

    cols = ["n", "sw", "sw2", "sa", "sb", "saa", "sbb", "sab"]
    t = x.groupBy("p", "q", "slice").applyInPandas(tile, "a string, b string, " + ", ".join(f"{c} double" for c in cols))
    return t.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in cols])


def mirror(pairs: DataFrame, values) -> DataFrame:
    """Full symmetric table from the a <= b half."""
    low = pairs.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), *values)
    return pairs.select("a", "b", *values).unionByName(low)


def covariance(returns: DataFrame) -> DataFrame:
    """Pairwise-complete sample covariance (x252) and correlation, a <= b."""
    m = pair_moments(returns)
    sxy = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    sx, sy = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    return m.select("a", "b", F.col("n").cast("long").alias("n"), (div(sxy, F.col("n") - 1) * YEAR).alias("cov"), div(sxy, F.sqrt(sx * sy)).alias("corr"))


def exponential_covariance(returns: DataFrame, halflife=60) -> DataFrame:
    """Bias-corrected exponential covariance at the newest date (x252), a <= b."""
    m = pair_moments(calendar_age(returns), F.pow(F.lit(0.5), F.col("age") / halflife))
    raw = F.col("sab") / F.col("sw") - F.col("sa") * F.col("sb") / (F.col("sw") * F.col("sw"))
    fix = div(F.col("sw") * F.col("sw"), F.col("sw") * F.col("sw") - F.col("sw2"))
    return m.select("a", "b", (raw * fix * YEAR).alias("cov"))


def expected_returns(returns: DataFrame, rf=0.02, halflife=60) -> DataFrame:
    """Historical, exponential and market-beta expected annual return per symbol."""
    d = calendar_age(returns).withColumn("_w", F.pow(F.lit(0.5), F.col("age") / halflife))
    market = returns.groupBy("ts").agg(F.avg("r").alias("mkt"))
    mk = market.agg(F.avg("mkt").alias("_mm"), F.var_samp("mkt").alias("_mv"))
    g = d.join(market, "ts").groupBy("symbol").agg(
        (F.avg("r") * YEAR).alias("historical"), (F.sum(F.col("_w") * F.col("r")) / F.sum("_w") * YEAR).alias("exponential"), F.covar_samp("r", "mkt").alias("_cv"))
    beta = F.col("_cv") / F.col("_mv")
    return g.crossJoin(F.broadcast(mk)).select("symbol", "historical", "exponential", (rf + beta * (F.col("_mm") * YEAR - rf)).alias("capm"), beta.alias("beta"))


def shrunk_covariance(returns: DataFrame) -> DataFrame:
    """Ledoit-Wolf covariance (x252) over dates on which every symbol has a return."""
    size = returns.agg(F.countDistinct("symbol").alias("_p"))
    full = returns.groupBy("ts").agg(F.count(F.lit(1)).alias("_k")).crossJoin(F.broadcast(size)).filter("_k = _p")
    d = returns.join(full.select("ts"), "ts", "left_semi")
    mean = d.groupBy("symbol").agg(F.avg("r").alias("_m"))
    c = d.join(mean, "symbol").select("symbol", "ts", (F.col("r") - F.col("_m")).alias("r"))
    m = pair_moments(c)
    e = m.select("a", "b", "n", ((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.col("n")).alias("s"))
    both = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    t = e.agg(F.max("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("tr"), F.sum(both * F.col("s") * F.col("s")).alias("d2"), F.count_if(F.col("a") == F.col("b")).alias("p"))
    q = c.groupBy("ts").agg(F.sum(F.col("r") * F.col("r")).alias("_q")).agg(F.sum(F.col("_q") * F.col("_q")).alias("b2"))
    t = t.crossJoin(q)
    mu = F.col("tr") / F.col("p")
    delta = (F.col("d2") - 2 * mu * F.col("tr") + F.col("p") * mu * mu) / F.col("p")
    beta = (F.col("b2") / F.col("n") - F.col("d2")) / (F.col("p") * F.col("n"))
    t = t.select(mu.alias("mu"), F.coalesce(div(F.least(beta, delta), delta), F.lit(0.0)).alias("shrinkage"))
    cov = (1 - F.col("shrinkage")) * F.col("s") + F.when(F.col("a") == F.col("b"), F.col("shrinkage") * F.col("mu")).otherwise(0.0)
    return e.crossJoin(F.broadcast(t)).select("a", "b", (cov * YEAR).alias("cov"), "shrinkage")


def risk_contribution(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """Marginal, component and percent contribution of each symbol; ``cov`` is the a <= b half."""
    full = mirror(cov, ["cov"])
    wb = weights.select(F.col("symbol").alias("b"), F.col("weight").alias("_w"))
    row = full.join(wb, "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("_w")).alias("_cw")).withColumnRenamed("a", "symbol").join(weights, "symbol")
    vol = row.agg(F.sqrt(F.sum(F.col("weight") * F.col("_cw"))).alias("portfolio_volatility"))
    r = row.crossJoin(F.broadcast(vol)).withColumn("marginal", F.col("_cw") / F.col("portfolio_volatility"))
    comp = F.col("weight") * F.col("marginal")
    return r.select("symbol", "weight", "marginal", comp.alias("component"), (comp / F.col("portfolio_volatility")).alias("percent"), "portfolio_volatility")


def inverse_variance(cov: DataFrame) -> DataFrame:
    v = cov.filter("a = b").select(F.col("a").alias("symbol"), (1 / F.col("cov")).alias("_i"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("_i").alias("_t")))).select("symbol", (F.col("_i") / F.col("_t")).alias("weight"))


def allocation_report(cov: DataFrame, expected: DataFrame, rf=0.02) -> DataFrame:
    """Inverse-variance portfolio: return, risk, Sharpe, diversification, effective assets.  ``cov`` is daily."""
    w = inverse_variance(cov)
    full = mirror(cov, ["cov"])
    wa, wb = w.select(F.col("symbol").alias("a"), F.col("weight").alias("_wa")), w.select(F.col("symbol").alias("b"), F.col("weight").alias("_wb"))
    risk = full.join(wa, "a").join(wb, "b").agg(F.sqrt(F.sum(F.col("cov") * F.col("_wa") * F.col("_wb"))).alias("expected_risk"))
    diag = cov.filter("a = b").select(F.col("a").alias("symbol"), F.sqrt("cov").alias("_v"))
    g = w.join(diag, "symbol").join(expected.select("symbol", "historical"), "symbol").agg(
        F.sum(F.col("weight") * F.col("historical")).alias("expected_return"), F.sum(F.col("weight") * F.col("_v")).alias("_av"), F.floor(1 / F.sum(F.col("weight") * F.col("weight"))).alias("effective_assets"))
    return g.crossJoin(risk).select("expected_return", "expected_risk", ((F.col("expected_return") - rf) / F.col("expected_risk")).alias("sharpe"),
                                    (F.col("_av") / F.col("expected_risk")).alias("diversification_ratio"), "effective_assets")


def blended(expected: DataFrame, cov: DataFrame, views: DataFrame) -> DataFrame:
    """Confidence-weighted expected return and inflated variance; missing views keep history."""
    v = expected.join(views, "symbol", "left").join(cov.filter("a = b").select(F.col("a").alias("symbol"), "cov"), "symbol")
    conf = F.coalesce("confidence", F.lit(0.5))
    e = F.when(F.col("view").isNull(), F.col("historical")).otherwise(conf * F.col("view") + (1 - conf) * F.col("historical"))
    u = 1 + (1 - conf) * 0.5
    return v.select("symbol", e.alias("expected_return"), (F.col("cov") * u * u).alias("variance"))

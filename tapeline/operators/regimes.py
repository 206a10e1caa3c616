"""Market regimes, model combination and forecasts."""

from __future__ import annotations

import math

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import div, full, number_rows, rmax, rmean, rmin, rolled, rstd
from tapeline.functions.lineage import cut, store
from tapeline.operators.aggregates import share
from tapeline.operators.indicators import _rsi, true_range
from tapeline.operators.linkage import thinned
from tapeline.operators.selection import top_k


def C() -> "F.Column":
    return F.col("close")


def H() -> "F.Column":
    return F.col("high")


def L() -> "F.Column":
    return F.col("low")


def V() -> "F.Column":
    return F.col("volume")


def one():
    return F.count(F.lit(1))


def vectors(df: DataFrame, columns, name="features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


def scaled(df: DataFrame, name="features") -> DataFrame:
    """Standardised vectors in column ``scaled``; materialised because fits read them many times."""
    df = cut(df)
    return StandardScaler(inputCol=name, outputCol="scaled", withMean=True, withStd=True).fit(df).transform(df)


def kmeans(df: DataFrame, k: int, name="scaled", seed=42) -> DataFrame:
    """Cluster labels and the distance cost of the fit as ``inertia``."""
    m = KMeans(featuresCol=name, predictionCol="cluster", k=k, seed=seed).fit(df)
    return m.transform(df).withColumn("inertia", F.lit(float(m.summary.trainingCost)))


def elbow(df: DataFrame, ks, name="scaled", seed=42) -> DataFrame:
    """(k, cost, chosen): cost of k-means for each of ``ks``; the k with the largest second difference is chosen. One fit for each k when the frame is built."""
    df, ks = df.select(name).cache(), list(ks)
    cost = [float(KMeans(featuresCol=name, k=k, seed=seed).fit(df).summary.trainingCost) for k in ks]
    df.unpersist()
    second = [cost[i - 1] - 2 * cost[i] + cost[i + 1] for i in range(1, len(cost) - 1)]
    best = ks[1 + max(range(len(second)), key=second.__getitem__)]
    return df.sparkSession.createDataFrame([(k, c, k == best) for k, c in zip(ks, cost)], "k int, cost double, chosen boolean")


def bisecting(df: DataFrame, k: int, name="scaled", seed=42) -> DataFrame:
    return BisectingKMeans(featuresCol=name, predictionCol="cluster", k=k, seed=seed).fit(df).transform(df)


def mixture(df: DataFrame, k: int, name="scaled", seed=42) -> DataFrame:
    """Gaussian-mixture regime label and probabilities."""
    m = GaussianMixture(featuresCol=name, predictionCol="regime", probabilityCol="_p", k=k, seed=seed).fit(df)
    return m.transform(df).withColumn("probability", vector_to_array("_p")).drop("_p")


def projection(df: DataFrame, name="scaled") -> DataFrame:
    """First two principal components."""
    d = PCA(k=2, inputCol=name, outputCol="_pc").fit(df).transform(df).withColumn("_a", vector_to_array("_pc"))
    return d.withColumns({"pc1": F.col("_a")[0], "pc2": F.col("_a")[1]}).drop("_pc", "_a")


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Component label (smallest id) by repeated min-label steps; edges hold both directions."""
    d = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = edges.join(d, edges["b"] == d["id"]).groupBy("a").agg(F.min("component").alias("_m"))
        # one hop through neighbours, then one jump through the label's own label
        n = d.join(near, d["id"] == near["a"], "left").select("id", F.col("component").alias("_o"), F.least("component", F.coalesce("_m", "component")).alias("component"))
        up = n.select(F.col("id").alias("_i"), F.col("component").alias("_c2"))
        n = cut(n.join(up, n["component"] == up["_i"]).select("id", "_o", F.least("component", "_c2").alias("component")))
        if n.filter("component <> _o").isEmpty():
            return n.select("id", "component")
        d = n.drop("_o")


def density(pairs: DataFrame, nodes: DataFrame, eps: float, least: int, nearest=None) -> DataFrame:
    """Density clusters from (a, b, distance) pairs with a < b; noise joins the nearest cluster.

    With ``nearest(ids, core ids) -> (a, b, distance)``, the nearest core member of each other one, pairs up to ``eps`` are enough.
    """
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    near = pairs.filter(F.col("distance") <= eps)
    core = near.select(ends.alias("x")).groupBy("x.a").agg(one().alias("_k")).filter(F.col("_k") + 1 >= least).select(F.col("a").alias("id"))
    core = cut(core)
    # the clusters are those of a spanning forest of the links
    links = near.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    comp = connected(store(thinned(links).select(ends.alias("x")).select("x.*")), core)
    label = comp.select(F.col("id").alias("b"), "component")
    rest = nodes.join(core, "id", "left_anti").select(F.col("id").alias("a"))
    if nearest:
        far = nearest(rest.select(F.col("a").alias("id")).distinct(), core)
    else:
        far = pairs.select(ends.alias("x"), "distance").select("x.*", "distance").join(rest, "a", "left_semi")
    nearest = far.join(label, "b").groupBy(F.col("a").alias("id")).agg(F.min_by("component", F.struct("distance", "b")).alias("component"), F.min("distance").alias("_d"))
    border = nearest.select("id", "component", (F.col("_d") > eps).alias("noise"))
    return comp.withColumn("noise", F.lit(False)).unionByName(border)


def cluster_statistics(pairs: DataFrame) -> DataFrame:
    """Medoid, intra/inter distance, compactness, separation and mean silhouette per cluster, from (a, b, distance, cluster_a, cluster_b) pairs with a < b."""
    ends = F.explode(F.array(F.struct("a", "b", F.col("cluster_a").alias("ca"), F.col("cluster_b").alias("cb")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("cluster_b").alias("ca"), F.col("cluster_a").alias("cb"))))
    both = pairs.select(ends.alias("x"), "distance").select("x.*", "distance")
    p = both.groupBy("a", "ca", "cb").agg(F.sum("distance").alias("s"), one().alias("n"), F.max("distance").alias("mx"), F.sum(F.col("distance") * F.col("distance")).alias("s2"))
    own = F.col("ca") == F.col("cb")
    i = p.groupBy("a", F.col("ca").alias("cluster")).agg(F.max(F.when(own, F.col("s"))).alias("si"), F.max(F.when(own, F.col("n"))).alias("ni"), F.max(F.when(own, F.col("mx"))).alias("mi"), F.max(F.when(own, F.col("s2"))).alias("s2i"),
                                                            F.sum(F.when(~own, F.col("s"))).alias("so"), F.sum(F.when(~own, F.col("n"))).alias("no"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("bo"))
    ai = F.col("si") / F.col("ni")
    i = i.withColumn("sil", F.coalesce(div(F.col("bo") - ai, F.greatest(F.col("bo"), ai)), F.lit(0.0)))
    g = i.groupBy("cluster").agg(one().alias("size"), F.min_by("a", F.struct(F.coalesce("si", F.lit(0.0)), F.col("a"))).alias("medoid"), (F.sum("si") / F.sum("ni")).alias("intra_mean"), F.max("mi").alias("intra_max"),
                                 F.sqrt(F.sum("s2i") / F.sum("ni") - F.pow(F.sum("si") / F.sum("ni"), 2)).alias("intra_std"), (F.sum("so") / F.sum("no")).alias("inter_mean"), F.avg("sil").alias("silhouette"))
    return g.withColumn("separation", div(F.col("inter_mean"), F.col("intra_mean")))


def regime_features(bars: DataFrame) -> DataFrame:
    """20-row return moments, down share, relative volume, position and range, RSI, range ratio and mean gap."""
    def build(h, w):
        h = h.withColumn("_r", div(C(), F.lag(C()).over(w)) - 1).withColumn("_d", C() - F.lag(C()).over(w)).withColumn("_tr", true_range(w))
        r, f, n = F.col("_r"), w.rowsBetween(-19, 0), 20
        lo, hi = rmin(C(), n, w), rmax(C(), n, w)
        return h.select(
            "symbol", "seq", "_c", rmean(r, n, w).alias("mean"), rstd(r, n, w).alias("std"), (full(F.skewness(r), r, f, n) * math.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
            full(F.avg((r < 0).cast("double")), r, f, n).alias("down_share"), div(V(), rmean(V(), n, w)).alias("relative_volume"), div(C() - lo, hi - lo).alias("position"), div(hi - lo, rmean(C(), n, w)).alias("range"),
            _rsi(14, w).alias("rsi"), div(rmean(F.col("_tr"), 14, w), C()).alias("atr_ratio"), (div(rmean(C(), 20, w), rmean(C(), 50, w)) - 1).alias("sma_gap"))

    return rolled(bars, build, 51)


def rule_regime(bars: DataFrame, rows=100) -> DataFrame:
    """Volatility level, trend direction and market state over the last ``rows`` rows per symbol."""
    last = bars.groupBy("symbol").agg(F.max("seq").alias("_z"))
    d = rolled(bars, lambda h, w: h.withColumn("_r", div(C(), F.lag(C()).over(w)) - 1), 1).join(last, "symbol")
    d = d.withColumn("_age", F.col("_z") - F.col("seq")).filter(F.col("_age") < rows)
    d = d.withColumn("_r", F.when(F.col("_age") < rows - 1, F.col("_r")))
    tail = lambda n, x: F.when(F.col("_age") < n, x)
    g = d.groupBy("symbol").agg(
        F.stddev_samp("_r").alias("sd"), F.stddev_samp(tail(20, F.col("_r"))).alias("sd20"), F.avg(tail(20, C())).alias("sma20"), F.avg(tail(50, C())).alias("sma50"), F.max_by(C(), "seq").alias("px"),
        (F.max(H()) - F.min(L())).alias("rng"), F.avg(H() - L()).alias("bar"), F.avg(tail(5, F.col("_r"))).alias("m5"), F.avg(tail(10, F.col("_r"))).alias("m10"))
    c = F.col
    level = F.when(c("sd20") < c("sd") * 0.7, "low").when(c("sd20") > c("sd") * 1.3, "high").otherwise("medium")
    trend = F.when((c("px") > c("sma20")) & (c("sma20") > c("sma50")), "bullish").when((c("px") < c("sma20")) & (c("sma20") < c("sma50")), "bearish").otherwise("neutral")
    state = F.when(c("rng") < c("bar") * 2, "ranging").when(F.abs("m5") > c("sd") * 2, "breakout").when(c("m10") * c("m5") < 0, "reversal").otherwise("trending")
    return g.select("symbol", level.alias("volatility_level"), trend.alias("trend_direction"), state.alias("market_state"))


def strategy_parameters(r: DataFrame) -> DataFrame:
    """Position size, stop, target and timeframe for a labelled regime."""
    high, state = F.col("volatility_level") == "high", F.col("market_state")
    size = F.when(state == "breakout", 1.5).when(state == "reversal", 0.3).when(high, 0.5).otherwise(1.0)
    stop = F.when(state == "reversal", 0.015).when(high, 0.03).otherwise(0.02)
    names = F.array_compact(F.array(F.when(high, "ATR"), *[
        F.when(state == s, n) for s, pair in {"trending": ("MA_crossover", "ADX"), "ranging": ("RSI", "Bollinger_Bands"), "breakout": ("Volume", "Momentum"), "reversal": ("Divergence", "Support_Resistance")}.items() for n in pair]))
    return r.select("*", size.alias("position_size"), stop.alias("stop_loss"), F.when(state == "ranging", 0.02).otherwise(0.04).alias("take_profit"),
                    F.when(state == "trending", "long").otherwise("medium").alias("timeframe"), names.alias("indicators"))


def regime_performance(returns: DataFrame) -> DataFrame:
    """Mean, deviation, Sharpe, win rate, average win and loss and time share per regime."""
    r = F.col("r")
    t = returns.agg(one().alias("_t"))
    g = returns.groupBy("regime").agg(one().alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), share(r > 0).alias("win_rate"), F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(r < 0, r)), F.lit(0.0)).alias("avg_loss"))
    return g.crossJoin(F.broadcast(t)).select("regime", "n", "mean", "std", F.coalesce(div(F.col("mean"), F.col("std")), F.lit(0.0)).alias("sharpe"), "win_rate", "avg_win", "avg_loss", (F.col("n") / F.col("_t")).alias("share"))


def volatility_tags(returns: DataFrame) -> DataFrame:
    """Market class by annualised deviation, last-20 against full volatility, and return trend."""
    last = returns.groupBy("symbol").agg(F.max("seq").alias("_z"))
    g = returns.join(last, "symbol").groupBy("symbol").agg(
        (F.stddev_pop("r") * math.sqrt(252)).alias("volatility"), (F.stddev_pop(F.when(F.col("seq") > F.col("_z") - 20, F.col("r"))) * math.sqrt(252)).alias("recent"), F.regr_slope("r", "seq").alias("_t"))
    v, q, t = F.col("volatility"), F.col("recent"), F.col("_t")
    market = F.when(v > 0.25, "high_volatility").when(v < 0.10, "low_volatility").otherwise("normal_volatility")
    vol = F.when(q > v * 1.5, "elevated").when(q < v * 0.7, "compressed").otherwise("normal")
    return g.select("symbol", "volatility", "recent", market.alias("market_regime"), vol.alias("volatility_regime"), F.when(t > 0.001, "upward").when(t < -0.001, "downward").otherwise("sideways").alias("trend"))


def walk_forward_splits(rows: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """(fold, part) tags of every row by expanding each row to the folds that use it; no join on ranges."""
    n = rows.groupBy("symbol").agg(one().alias("_n"))
    lo = F.greatest(F.lit(0), F.ceil((F.col("seq") - (train + test) + 1) / step))
    hi = F.least(F.floor(F.col("seq") / step), F.floor((F.col("_n") - train - test) / step))
    d = rows.join(n, "symbol").filter(lo <= hi).withColumn("fold", F.explode(F.sequence(lo, hi)))
    at = F.col("seq") - F.col("fold") * step
    return d.withColumn("part", F.when(at < train, "train").otherwise("test")).drop("_n")


def combine(long: DataFrame, key: str) -> DataFrame:
    """Weighted mean, median and most confident prediction over models (model, prediction, weight): few rows per key."""
    g = long.groupBy(key).agg((F.sum(F.col("weight") * F.col("prediction")) / F.sum("weight")).alias("weighted_mean"), F.percentile("prediction", F.lit(0.5)).alias("median"),
                              F.max_by("prediction", F.struct(F.abs("prediction"), F.col("model"))).alias("strongest"))
    return g


def inverse_error_weights(errors: DataFrame, window=100) -> DataFrame:
    """Weights 1/(rolling mean error + 1e-6) normalised over the models at each step."""
    d = rolled(errors, lambda h, w: h.select("symbol", "seq", "_c", (1 / (F.avg("error").over(w.rowsBetween(1 - window, 0)) + 1e-6)).alias("_w")), window)
    total = d.groupBy("seq").agg(F.sum("_w").alias("_t"))
    return d.join(total, "seq").select("symbol", "seq", (F.col("_w") / F.col("_t")).alias("weight"))


def weight_search(long: DataFrame, step=0.1) -> DataFrame:
    """Accuracy of every weight triple on a grid over three models' class scores.

    ``long`` has (id, actual, s1, s2, s3), each s a map class -> score of a
    small class set; the grid is a bounded broadcast table.
    """
    n = round(1 / step)
    grid = [(i / n, j / n, (n - i - j) / n) for i in range(n + 1) for j in range(n + 1 - i)]
    g = long.sparkSession.createDataFrame(grid, "w1 double, w2 double, w3 double")
    x = long.crossJoin(F.broadcast(g))
    classes = F.array_distinct(F.concat(F.map_keys("s1"), F.map_keys("s2"), F.map_keys("s3")))
    val = lambda m, c: F.coalesce(F.element_at(m, c), F.lit(0.0))
    score = F.transform(F.array_sort(classes), lambda c: F.struct((F.col("w1") * val("s1", c) + F.col("w2") * val("s2", c) + F.col("w3") * val("s3", c)).alias("v"), c.alias("c")))
    return x.withColumn("_best", F.array_max(score)["c"]).groupBy("w1", "w2", "w3").agg(share(F.col("_best") == F.col("actual")).alias("accuracy"))


def forecast_tree(matrix: DataFrame, start: DataFrame, depth=3, branch=3, decay=0.9) -> DataFrame:
    """All paths of the top branches with decayed confidence; the matrix is bounded by its states."""
    t = top_k(matrix, ["from"], [F.col("p").desc(), "to"], branch).select(F.col("from").alias("_f"), F.col("to").alias("_t"), F.col("p").alias("_p"))
    d = start.select("symbol", F.col("state").alias("_at"), F.lit("").alias("path"), F.lit(1.0).alias("probability"), F.lit(1.0).alias("confidence"))
    for k in range(1, depth + 1):
        d = d.join(F.broadcast(t), d["_at"] == t["_f"]).select("symbol", F.col("_t").alias("_at"), F.concat_ws(">", F.nullif("path", F.lit("")), F.col("_t").cast("string")).alias("path"),
                                                             (F.col("probability") * F.col("_p")).alias("probability"), (F.col("confidence") * F.col("_p") * decay ** k).alias("confidence"))
    return d.drop("_at")


# Price effect per step and default successor of each chart pattern.
PATTERN_EFFECT = {
    "flag_bull": 0.02,
    "flag_bear": -0.02,
    "double_bottom": 0.03,
    "double_top": -0.03,
    "triangle_ascending": 0.015,
    "triangle_descending": -0.015,
    "wedge_rising": 0.01,
    "wedge_falling": -0.01,
    "head_shoulders": -0.025,
}
NEXT_PATTERN = {
    "double_bottom": "flag_bull",
    "double_top": "flag_bear",
    "triangle_ascending": "flag_bull",
    "triangle_descending": "flag_bear",
    "flag_bull": "wedge_rising",
    "flag_bear": "wedge_falling",
    "wedge_rising": "double_top",
    "wedge_falling": "double_bottom",
    "head_shoulders": "flag_bear",
}
MODEL_FACTOR = {"lstm": 0.9, "gru": 0.95, "transformer": 1.05, "ensemble": 1.0}


def price_projection(patterns: DataFrame, horizon=1, kind="type", price="price") -> DataFrame:
    """Projected price per model factor and the default next pattern."""
    k = F.col(kind)
    effect = F.coalesce(*[F.when(k == n, F.lit(v)) for n, v in PATTERN_EFFECT.items()], F.lit(0.0))
    after = F.coalesce(*[F.when(k == n, F.lit(v)) for n, v in NEXT_PATTERN.items()], F.lit("triangle_ascending"))
    p = F.col(price)
    return patterns.select("*", *[(p + p * effect * horizon * f).alias(m) for m, f in MODEL_FACTOR.items()], after.alias("next_pattern"))


def history_confidence(scores: DataFrame, n=10) -> DataFrame:
    """1 - |z|/3 of the prediction against the previous ``n``; 0.5 until there are ``n``."""
    def build(h, w):
        f, p = w.rowsBetween(-n, -1), F.col("prediction")
        z = F.coalesce(div(F.abs(p - F.avg(p).over(f)), F.stddev_pop(p).over(f)), F.lit(0.0))
        return h.withColumn("confidence", F.when(F.count(p).over(f) < n, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - z / 3))))

    return rolled(scores, build, n)


def confidence_vote(votes: DataFrame, key: str) -> DataFrame:
    """Winning class by confidence x weight, normalised by the total weight."""
    t = votes.groupBy(key).agg(F.sum("weight").alias("_t"))
    g = votes.groupBy(key, "label").agg(F.sum(F.col("weight") * F.col("confidence")).alias("_s")).join(t, key).withColumn("score", F.col("_s") / F.col("_t"))
    return g.groupBy(key).agg(F.max_by("label", F.struct("score", "label")).alias("winner"), F.max("score").alias("score"), F.count_if(F.col("score") > 0.1).alias("alternatives"))

"""Grouped statistics.  All aggregates have map-side partials; exact quantiles and
drawdowns use the chunked helpers so that one hot group is still split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import div, number_rows, quantiles, ranked_values, rolled, running
from tapeline.operators.selection import top_k

# The five window pattern types.
PATTERN_TYPES = ["trend_up", "trend_down", "reversal_top", "reversal_bottom", "consolidation"]


def one():
    return F.count(F.lit(1))


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def type_statistics(patterns: DataFrame) -> DataFrame:
    """Count, means and share per pattern type; absent types show zeros."""
    dim = patterns.sparkSession.createDataFrame([(t,) for t in PATTERN_TYPES], "type string")
    g = patterns.groupBy("type").agg(one().alias("n"), F.avg("strength").alias("s"), F.avg("price_change").alias("p"), F.avg("volatility").alias("v"))
    total = g.agg(F.sum("n").alias("t"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return F.broadcast(dim).join(g, "type", "left").crossJoin(F.broadcast(total)).select(
        "type", F.coalesce("n", F.lit(0)).alias("count"), z("s").alias("avg_strength"), z("p").alias("avg_price_change"), z("v").alias("avg_volatility"),
        F.coalesce(F.col("n") / F.col("t"), F.lit(0.0)).alias("frequency"))


def frequency_analysis(patterns: DataFrame) -> DataFrame:
    """Counts by symbol, type, symbol x type, day, week and month in one pass."""
    p = patterns.select("symbol", "type", *[F.date_trunc(u, "ts").cast("timestamp_ntz").alias(u) for u in ("day", "week", "month")])
    sets = [["symbol"], ["type"], ["symbol", "type"], ["day"], ["week"], ["month"]]
    cols = ["symbol", "type", "day", "week", "month"]
    return p.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(one().alias("n"))


def quality_analysis(df: DataFrame, value: str, dims) -> DataFrame:
    """Mean, std and quartiles overall and for each dimension."""
    out = None
    for d in [None, *dims]:
        by = [d] if d else []
        x = df.select(*by, value)
        g = x.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        q = quantiles(x, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
        j = g.join(q, by) if by else g.crossJoin(q)
        part = j.select(F.lit(d or "all").alias("dim"), (F.col(d).cast("string") if d else F.lit("all")).alias("key"), "mean", "std", "q1", "median", "q3")
        out = part if out is None else out.unionByName(part)
    return out


def cut_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based right-closed equal-width bin; the minimum falls in bin 0."""
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((x - lo) / ((hi - lo) / bins)) - 1)).cast("long")


def with_cut(df: DataFrame, value: str, bins: int, name: str) -> DataFrame:
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = df.crossJoin(F.broadcast(span))
    return d.withColumn(name, cut_bin(F.col(value), F.col("_lo"), F.col("_hi"), bins)).drop("_lo", "_hi")


def histogram(df: DataFrame, value: str, bins=10) -> DataFrame:
    return with_cut(df, value, bins, "bin").groupBy("bin").agg(one().alias("n"))


def direction_accuracy(df: DataFrame, pred: Column, actual: Column, kind: str, quality: str, bins=5) -> DataFrame:
    """Accuracy overall, by type and by quality bin, and the 2x2 counts, in long form."""
    d = with_cut(df.withColumn("_p", pred.cast("int")).withColumn("_a", actual.cast("int")), quality, bins, "_bin")
    ok = share(F.col("_p") == F.col("_a"))
    row = lambda section, key, v: (F.lit(section).alias("section"), key.cast("string").alias("key"), v.alias("value"))
    parts = [
        d.agg(ok.alias("v")).select(*row("overall", F.lit("all"), F.col("v"))),
        d.groupBy(kind).agg(ok.alias("v")).select(*row("type", F.col(kind), F.col("v"))),
        d.groupBy("_bin").agg(ok.alias("v")).select(*row("quality_bin", F.col("_bin"), F.col("v"))),
        d.groupBy("_a", "_p").agg(one().cast("double").alias("v")).select(*row("confusion", F.concat_ws(">", "_a", "_p"), F.col("v"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cumulative_drawdown(df: DataFrame, by, value: str, order, bucket) -> DataFrame:
    """Largest fall of the cumulative sum below its running maximum, per group."""
    d = number_rows(df.select(*by, value, *[c for c in order if c not in (*by, value)]), order, bucket, by)
    d = running(d, {"_cum": (F.col(value), "sum")}, by)
    d = running(d, {"_top": (F.col("_cum"), "max")}, by)
    return d.groupBy(*by).agg(F.max(F.col("_top") - F.col("_cum")).alias("max_drawdown"))


def group_risk(df: DataFrame, by: str, r: str, order, bucket) -> DataFrame:
    """Return, risk and tail metrics per group; an infinite profit factor is NULL."""
    x = F.col(r)
    d = df.filter(x.isNotNull())
    q = quantiles(d, [by], r, {"var_95": 0.05})
    tail = d.join(q, by).filter(x <= F.col("var_95")).groupBy(by).agg(F.avg(r).alias("cvar_95"))
    g = d.groupBy(by).agg(
        F.avg(r).alias("avg_return"), F.stddev_samp(r).alias("volatility"), share(x > 0).alias("win_rate"),
        F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(x < 0, x)), F.lit(0.0)).alias("avg_loss"),
        F.abs(div(F.sum(F.when(x > 0, x)), F.sum(F.when(x < 0, x)))).alias("profit_factor"))
    g = g.withColumn("sharpe", F.when(F.col("volatility") > 0, F.col("avg_return") / F.col("volatility")).otherwise(0.0))
    return g.join(q, by).join(tail, by).join(cumulative_drawdown(d, [by], r, order, bucket), by)


def counts_over_time(df: DataFrame, kind: str, ts: str) -> DataFrame:
    """Daily counts per type and their running total (one row per type and day)."""
    g = df.groupBy(kind, F.to_date(ts).alias("day")).agg(one().alias("n"))
    return g.withColumn("cumulative", F.sum("n").over(Window.partitionBy(kind).orderBy("day")))


def pivot_mean(df: DataFrame, row: str, column: str, values, value: str) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def cooccurrence(df: DataFrame, kind: str, values, ts: str, unit="hour") -> DataFrame:
    """Correlation of per-slot counts between every two types, in long form."""
    p = df.groupBy(F.date_trunc(unit, ts).alias("_t")).pivot(kind, list(values)).count().na.fill(0)
    pairs = [(a, b) for a in values for b in values]
    wide = p.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])
    return wide.select(F.explode(items).alias("x")).select("x.a", "x.b", "x.corr")


def duration_by_type(intervals: DataFrame, kind: str, start: Column, end: Column) -> DataFrame:
    d = intervals.select(kind, ((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).alias("hours"))
    q = quantiles(d, [kind], "hours", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return d.groupBy(kind).agg(one().alias("n"), F.avg("hours").alias("mean"), F.min("hours").alias("lo"), F.max("hours").alias("hi")).join(q, kind)


def monthly_returns(returns: DataFrame) -> DataFrame:
    """Compound return per symbol, year and month; months as columns."""
    d = returns.withColumn("year", F.year("ts")).withColumn("_m", F.month("ts"))
    g = d.groupBy("symbol", "year").pivot("_m", list(range(1, 13))).agg(F.product(1 + F.col("r")) - 1)
    return g.select("symbol", "year", *[F.col(str(m)).alias(f"m{m}") for m in range(1, 13)])


def autocorrelation(df: DataFrame, column: str, max_lag=20) -> DataFrame:
    """Lags 0..max_lag-1 about the global mean with the biased denominator."""
    mean = df.groupBy("symbol").agg(F.avg(column).alias("_m"))
    d = df.join(mean, "symbol").withColumn("_x", F.col(column) - F.col("_m"))
    d = rolled(d, lambda h, w: h.select("symbol", "seq", "_c", *[(F.col("_x") * (F.lag("_x", k).over(w) if k else F.col("_x"))).alias(f"_p{k}") for k in range(max_lag)]), max_lag)
    g = d.groupBy("symbol").agg(*[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(max_lag)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.coalesce(div(F.col(f"_p{k}"), F.col("_p0")), F.lit(0.0)).alias("acf")) for k in range(max_lag)])
    return g.select("symbol", F.explode(rows).alias("x")).select("symbol", "x.lag", "x.acf")


def correlated_columns(df: DataFrame, columns, threshold=0.95) -> DataFrame:
    """A column is removed when a later column correlates with it above the threshold."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = df.agg(*[F.abs(F.corr(columns[i], columns[j])).alias(f"_{i}_{j}") for i, j in pairs])
    drop = lambda i: reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_{i}_{j}") > threshold, F.lit(False)) for j in range(i + 1, len(columns))], F.lit(False))
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), drop(i).alias("removed")) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("x")).select("x.feature", "x.removed")


def long_features(series: DataFrame) -> DataFrame:
    """(id, label, feature, x) rows of array ``v``."""
    return series.select("id", "label", F.posexplode("v").alias("feature", "x"))


def f_score(long: DataFrame) -> DataFrame:
    """One-way ANOVA F per feature against the label, and its share of the maximum."""
    g = long.groupBy("feature", "label").agg(one().alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    t = g.groupBy("feature").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"))
    ssb = F.col("s2") - F.col("N") * F.col("gm") * F.col("gm")
    t = t.select("feature", div(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("N") - F.col("k"))).alias("f"))
    return t.crossJoin(F.broadcast(t.agg(F.max("f").alias("_mx")))).select("feature", "f", (F.col("f") / F.col("_mx")).alias("score"))


def mutual_information(long: DataFrame, bins=10) -> DataFrame:
    """Plug-in mutual information of the quantile-binned feature and the label."""
    r = ranked_values(long, ["feature"], "x").select("feature", "x", F.floor(F.col("below") * bins / F.col("total")).alias("bin"))
    c = long.join(r, ["feature", "x"]).groupBy("feature", "bin", "label").agg(one().alias("n"))
    a = c.groupBy("feature", "bin").agg(F.sum("n").alias("na"))
    b = c.groupBy("feature", "label").agg(F.sum("n").alias("nb"))
    t = c.groupBy("feature").agg(F.sum("n").alias("tot"))
    j = c.join(a, ["feature", "bin"]).join(b, ["feature", "label"]).join(t, "feature")
    mi = j.groupBy("feature").agg(F.sum(F.col("n") / F.col("tot") * F.ln(F.col("n") * F.col("tot") / (F.col("na") * F.col("nb")))).alias("mi"))
    return mi.crossJoin(F.broadcast(mi.agg(F.max("mi").alias("_mx")))).select("feature", "mi", (F.col("mi") / F.col("_mx")).alias("score"))


def position_band(series: DataFrame) -> DataFrame:
    """Mean and population std at every array position, per label."""
    return long_features(series).groupBy("label", F.col("feature").alias("pos")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def prediction_log(p: DataFrame, last=10) -> DataFrame:
    """Use and confidence per model, with the mean of the last ten."""
    g = p.groupBy("model").agg(one().alias("n"), F.avg("prob").alias("mean_confidence"), F.max("ts").alias("last_seen"))
    tail = top_k(p.select("model", "ts", "id", "prob"), ["model"], [F.col("ts").desc(), F.col("id").desc()], last)
    return g.join(tail.groupBy("model").agg(F.avg("prob").alias("recent_confidence")), "model")

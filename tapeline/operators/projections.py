"""Row-level columns, windows to arrays, imputation and scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import arrays as A
from tapeline.functions.frames import (
    div, full, number_rows, quantiles, ranked_values, rmax, rmean, rmin, rolled, rstd, running,
)


def C() -> "F.Column":
    return F.col("close")


def H() -> "F.Column":
    return F.col("high")


def L() -> "F.Column":
    return F.col("low")


def V() -> "F.Column":
    return F.col("volume")


def ret(n, w) -> Column:
    return div(C(), F.lag(C(), n).over(w)) - 1


def with_returns(bars: DataFrame) -> DataFrame:
    """Simple return of the close, 0 on the first bar."""
    return rolled(bars, lambda h, w: h.withColumn("returns", F.coalesce(ret(1, w), F.lit(0.0))), 1)


def return_columns(bars: DataFrame) -> DataFrame:
    def build(h, w):
        return h.select("*", *[ret(n, w).alias(f"returns_{n}d") for n in (1, 5, 20)],
                        *[F.ln(div(C(), F.lag(C(), n).over(w))).alias(f"log_returns_{n}d") for n in (1, 5)])

    return rolled(bars, build, 20)


def price_position(bars: DataFrame, periods=(20, 50)) -> DataFrame:
    def build(h, w):
        return h.select("*", div(H(), L()).alias("high_low_ratio"), div(C(), F.col("open")).alias("close_open_ratio"),
                        *[div(C() - rmin(C(), n, w), rmax(C(), n, w) - rmin(C(), n, w)).alias(f"price_position_{n}d") for n in periods])

    return rolled(bars, build, max(periods))


def calendar(df: DataFrame, ts="ts") -> DataFrame:
    """Calendar columns; ``is_month_start/end`` are the loose (<=5, >=25) flags and
    ``first_of_month``/``last_of_month`` the exact ones."""
    t = F.col(ts)
    dow, month = F.weekday(t), F.month(t)
    turn = 2 * math.pi
    return df.select(
        "*", dow.alias("day_of_week"), F.dayofmonth(t).alias("day_of_month"), month.alias("month"), F.quarter(t).alias("quarter"),
        F.hour(t).alias("hour"), F.sin(turn * dow / 7).alias("day_of_week_sin"), F.cos(turn * dow / 7).alias("day_of_week_cos"),
        F.sin(turn * month / 12).alias("month_sin"), F.cos(turn * month / 12).alias("month_cos"),
        (dow == 0).cast("int").alias("is_monday"), (dow == 4).cast("int").alias("is_friday"), (dow >= 5).cast("int").alias("is_weekend"),
        (F.dayofmonth(t) <= 5).cast("int").alias("is_month_start"), (F.dayofmonth(t) >= 25).cast("int").alias("is_month_end"),
        (F.dayofmonth(t) == 1).cast("int").alias("first_of_month"), (F.to_date(t) == F.last_day(t)).cast("int").alias("last_of_month"))


def lags(df: DataFrame, column: str, steps) -> DataFrame:
    steps = [k for k in steps if k > 0]
    return rolled(df, lambda h, w: h.select("*", *[F.lag(column, k).over(w).alias(f"{column}_lag_{k}") for k in steps]), max(steps))


def rolling_grid(df: DataFrame, column: str, windows=(5, 10, 20)) -> DataFrame:
    x = F.col(column)
    kinds = {"mean": rmean, "std": rstd, "min": rmin, "max": rmax}
    return rolled(df, lambda h, w: h.select("*", *[f(x, n, w).alias(f"{column}_{k}_{n}") for n in windows for k, f in kinds.items()]), max(windows))


def targets(bars: DataFrame, horizon=5) -> DataFrame:
    """Forward return and its direction; the last rows have no return and direction 0."""
    def build(h, w):
        fwd = div(F.lead(C(), horizon).over(w), C()) - 1
        return h.select("*", fwd.alias("target_return"), F.when(fwd > 0, 1).otherwise(0).alias("target_direction"))

    return rolled(bars, build, 0, horizon)


def condition_labels(bars: DataFrame) -> DataFrame:
    """Ordered market condition label; thresholds are whole-series quantiles."""
    def build(h, w):
        h = h.withColumn("r", ret(1, w))
        return h.select("*", rstd(F.col("r"), 20, w).alias("vol"), rmean(V(), 20, w).alias("vma"))

    b = rolled(bars, build, 21)
    q = quantiles(b, ["symbol"], "vol", {"vq": 0.75}).join(quantiles(b, ["symbol"], "r", {"r80": 0.8, "r20": 0.2}), "symbol")
    label = (F.when(F.col("seq") < 20, "unknown").when(F.col("vol") > F.col("vq"), "high_volatility").when(V() > 2 * F.col("vma"), "high_volume")
             .when(F.col("r") > F.col("r80"), "strong_uptrend").when(F.col("r") < F.col("r20"), "strong_downtrend").otherwise("normal"))
    return b.join(q, "symbol").withColumn("condition", label).drop("vma", "vq", "r80", "r20")


def sliding_windows(bars: DataFrame, size: int, horizon: int) -> DataFrame:
    """Array of the ``size`` closes before each bar, with the up/down label at ``horizon``."""
    def build(h, w):
        f = w.rowsBetween(-size, -1)
        return h.select("*", F.when(F.count(C()).over(f) == size, F.collect_list(C()).over(f)).alias("window"),
                        F.when(F.lead(C(), horizon).over(w) > C(), 1).otherwise(0).alias("label"), F.lead("seq", horizon).over(w).alias("_f"))

    return rolled(bars, build, size, horizon).filter("window IS NOT NULL AND _f IS NOT NULL").select("symbol", "seq", "window", "label")


def supervised_sequences(bars: DataFrame, size: int, horizon: int) -> DataFrame:
    """Input array of ``size`` rows and the array of the next ``horizon`` values."""
    def build(h, w):
        fin, fout = w.rowsBetween(0, size - 1), w.rowsBetween(size, size + horizon - 1)
        ok = (F.count(C()).over(fin) == size) & (F.count(C()).over(fout) == horizon)
        return h.select("*", F.when(ok, F.collect_list(C()).over(fin)).alias("x"), F.collect_list(C()).over(fout).alias("y"))

    return rolled(bars, build, 0, size + horizon).filter("x IS NOT NULL").select("symbol", "seq", "x", "y")


def subsequences(series: DataFrame, lengths, step) -> DataFrame:
    """Every strided subsequence of array ``v``; ``step`` maps a length to its stride."""
    specs = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(step(n)).alias("step")) for n in lengths])
    d = series.withColumn("_s", F.explode(specs)).filter(F.size("v") >= F.col("_s.len"))
    start = F.explode(F.sequence(F.lit(0), F.size("v") - F.col("_s.len"), F.col("_s.step")))
    d = d.select("*", start.alias("start"))
    return d.select(*[c for c in series.columns if c != "v"], F.col("_s.len").alias("length"), "start", F.slice("v", F.col("start") + 1, F.col("_s.len")).alias("sub"))


def fill_gaps(df: DataFrame, column: str) -> DataFrame:
    """Linear interpolation between known values, then back and forward fill."""
    x, s = F.col(column), F.col("seq")
    known = F.when(x.isNotNull(), F.struct(s.alias("s"), x.alias("x")))
    d = running(df, {"_prev": (known, "last")})
    d = running(d, {"_next": (known, "last")}, reverse=True)
    p, n = F.col("_prev"), F.col("_next")
    blend = p.x + (n.x - p.x) * div((s - p.s).cast("double"), n.s - p.s)
    return d.withColumn(column + "_filled", F.coalesce(x, blend, n.x, p.x)).drop("_prev", "_next")


def impute(df: DataFrame, by, columns, how="mean") -> DataFrame:
    """Fill NULLs with the group mean or median, or drop incomplete rows."""
    if how == "drop":
        return df.dropna(subset=list(columns))
    if how == "mean":
        stats = df.groupBy(*by).agg(*[F.avg(c).alias("_i_" + c) for c in columns])
    else:
        stats = None
        for c in columns:
            q = quantiles(df, by, c, {"_i_" + c: 0.5})
            stats = q if stats is None else stats.join(q, list(by), "full_outer")
    out = df.join(stats, list(by), "left")
    return out.select(*[F.coalesce(F.col(c), F.col("_i_" + c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def scale(train: DataFrame, test: DataFrame, by, column: str) -> DataFrame:
    """Standard, robust and min-max scaling of ``test`` with statistics of ``train``."""
    by, x = list(by), F.col(column)
    stats = train.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    stats = stats.join(quantiles(train, by, column, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}), by)
    return test.join(stats, by).select(
        *test.columns, div(x - F.col("_m"), F.col("_s")).alias(column + "_standard"),
        div(x - F.col("_q2"), F.col("_q3") - F.col("_q1")).alias(column + "_robust"),
        div(x - F.col("_lo"), F.col("_hi") - F.col("_lo")).alias(column + "_minmax"))


def normalise(series: DataFrame, eps=1e-8) -> DataFrame:
    """Per-array z-score (zeros for a flat array) and min-max."""
    d = A.hold(series, _m=A.mean("v"))
    d = A.hold(d, _s=A.std("v", F.col("_m")), _lo=F.array_min("v"), _hi=F.array_max("v"))
    z = F.transform("v", lambda x: F.when(F.col("_s") < eps, F.lit(0.0)).otherwise((x - F.col("_m")) / F.col("_s")))
    mm = F.transform("v", lambda x: F.coalesce(div(x - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    return d.select(*series.columns, z.alias("z"), mm.alias("minmax"))


def library_view(patterns: DataFrame, types=None, symbols=None, tags=None, order="quality") -> DataFrame:
    """Filter by type, symbol and tags; order by quality, frequency or recency."""
    d = patterns
    if types:
        d = d.filter(F.col("type").isin(list(types)))
    if symbols:
        d = d.filter(F.col("symbol").isin(list(symbols)))
    if tags:
        d = d.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if order == "frequency":
        d = d.join(d.groupBy("type").agg(F.count(F.lit(1)).alias("frequency")), "type")
    key = {"quality": "strength", "frequency": "frequency", "recency": "ts"}[order]
    return d.orderBy(F.col(key).desc(), "symbol", "seq")


def detail_levels(bars: DataFrame, max_points: int) -> DataFrame:
    """Thinned copies of each series: a base step and up to five halving levels."""
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    base = F.struct(F.lit(-1).alias("level"), F.floor(F.col("_n") / max_points).alias("step"))
    # level k exists while the previous level still has more than max_points rows
    prev = lambda k: F.when(k == 0, F.col("_n")).otherwise(F.ceil(F.col("_n") / F.pow(F.lit(2.0), k)))
    ks = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: prev(k) > max_points)
    lods = F.transform(ks, lambda k: F.struct(k.alias("level"), F.pow(F.lit(2.0), k + 1).cast("long").alias("step")))
    plan = n.filter(F.col("_n") > max_points).select("symbol", F.explode(F.concat(F.array(base), lods)).alias("_l"))
    return bars.join(plan, "symbol").filter(F.col("seq") % F.col("_l.step") == 0).select("symbol", "seq", "close", F.col("_l.level").alias("level"))


def page(df: DataFrame, offset: int, rows: int) -> DataFrame:
    """Rows ``offset .. offset+rows-1`` of each ordered series."""
    return df.filter((F.col("seq") >= offset) & (F.col("seq") < offset + rows))


def head_tail(df: DataFrame, n=10) -> DataFrame:
    """First and last ``n`` rows of each series."""
    size = df.groupBy("symbol").agg(F.max("seq").alias("_last"))
    d = df.join(size, "symbol")
    part = F.when(F.col("seq") < n, "head").when(F.col("seq") > F.col("_last") - n, "tail")
    return d.withColumn("part", part).filter("part IS NOT NULL").drop("_last")


def sample_rows(df: DataFrame, fraction: float, seed=42) -> DataFrame:
    """Repeatable sample by hash of the series key, independent of partitioning."""
    return df.filter(A.key_below(["symbol", "seq", F.lit(seed)], fraction))


def percent_rank(df: DataFrame, column: str, by=("symbol",)) -> DataFrame:
    """Average-tie percentile rank of ``column`` within the series."""
    r = ranked_values(df, by, column).select(*by, column, ((F.col("below") + (F.col("n") + 1) / 2) / F.col("total")).alias(column + "_rank"))
    return df.join(r, [*by, column], "left")


def trend_state(bars: DataFrame) -> DataFrame:
    """+1/-1 by the 20/50 mean crossover and percentile rank of the 20-bar volatility."""
    def build(h, w):
        h = h.withColumn("returns", F.coalesce(ret(1, w), F.lit(0.0)))
        trend = F.when(rmean(C(), 20, w) > rmean(C(), 50, w), 1).otherwise(-1)
        return h.select("*", trend.alias("trend"), rstd(F.col("returns"), 20, w).alias("vol"))

    return percent_rank(rolled(bars, build, 50), "vol")


def trading_signals(state: DataFrame, predicted: Column, threshold=0.001) -> DataFrame:
    """Threshold the prediction, veto against the trend, halve in the top volatility fifth."""
    raw = F.when(predicted > threshold, 1.0).when(predicted < -threshold, -1.0).otherwise(0.0)
    s = state.withColumn("_raw", raw)
    s = s.withColumn("signal", F.when(F.col("_raw") * F.col("trend") < 0, 0.0).otherwise(F.col("_raw")))
    return s.withColumn("signal", F.when(F.col("vol_rank") > 0.8, F.col("signal") * 0.5).otherwise(F.col("signal"))).drop("_raw")


# Direction multiplier of each chart pattern.
PATTERN_MULTIPLIER = {
    "double_top": -1.2,
    "double_bottom": 1.2,
    "head_shoulders": -1.1,
    "inverse_head_shoulders": 1.1,
    "triangle": 0.8,
    "wedge": 0.9,
    "flag": 1.0,
    "pennant": 0.9,
}


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def signal_levels(df: DataFrame, kind="pattern_type", quality="quality", price="price", volatility="volatility", table=None) -> DataFrame:
    """Signal class, stop and take levels and risk-reward from quality and type."""
    factor = F.coalesce(map_literal(table or PATTERN_MULTIPLIER)[F.col(kind)], F.lit(1.0))
    d = df.withColumn("_s", F.col(quality) * factor)
    s, p, v = F.col("_s"), F.col(price), F.coalesce(F.col(volatility), F.lit(0.02))
    d = d.withColumn("signal_type", F.when(s > 0.7, "STRONG_BUY").when(s > 0.3, "BUY").when(s < -0.7, "STRONG_SELL").when(s < -0.3, "SELL").otherwise("HOLD"))
    way = F.when(F.col("signal_type").contains("BUY"), 1.0).otherwise(-1.0)
    d = d.select("*", F.abs(s).alias("signal_strength"), (p * (1 - 2 * way * v)).alias("stop_loss"), (p * (1 + 3 * way * v)).alias("take_profit"))
    return d.withColumn("risk_reward", F.abs(div(F.col("take_profit") - p, p - F.col("stop_loss")))).drop("_s")


def complexity(skew, kurt, entropy) -> Column:
    score = F.abs(skew) * 0.3 + F.abs(kurt - 3) * 0.3 + entropy * 0.4
    return F.when(score < 0.3, "Simple").when(score < 0.6, "Moderate").otherwise("Complex")


def ratio(a, b) -> Column:
    """a / b of doubles; a zero below gives infinity, or NaN for 0 / 0, instead of an error."""
    return F.when(b == 0, F.when(a == 0, math.nan).otherwise(F.signum(a) * math.inf)).otherwise(F.try_divide(a, b))


def insight_tags(trend, accuracy, occurrences) -> Column:
    return F.array_compact(F.array(
        F.when(trend > 0.02, "Strong upward trend detected").when(trend < -0.02, "Strong downward trend detected"),
        F.when(accuracy > 0.8, "High prediction reliability"),
        F.when(occurrences > 20, "Frequently occurring pattern")))


def recommendation(accuracy, hit_rate) -> Column:
    return F.when((accuracy > 0.7) & (hit_rate > 0.6), "Consider trading this pattern with appropriate risk management").otherwise(
        "Monitor pattern but wait for improved metrics before trading")

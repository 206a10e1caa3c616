"""Joins over ordered series: as-of, offset, first-touch, range and set joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import div, number_rows, quantiles, rolled, running


def asof_forward(left: DataFrame, right: DataFrame, bucket, tolerance: Column, payload) -> DataFrame:
    """Next right row at or after each left row of the same symbol.

    Both sides are (symbol, ts, tie, ...).  They are merged into one ordered
    stream, and the next right row is carried backwards chunk by chunk, so no
    pairs are produced and a hot symbol is split.
    """
    lcols = [c for c in left.columns if c not in ("symbol", "ts", "tie")]
    rec = F.struct(F.col("ts").alias("ts"), *[F.col(c).alias(c) for c in payload])
    l = left.select("symbol", "ts", "tie", F.lit(0).alias("side"), F.struct(*lcols).alias("left"))
    r = right.select("symbol", "ts", "tie", F.lit(1).alias("side"), rec.alias("right"))
    u = l.unionByName(r, allowMissingColumns=True)
    u = number_rows(u, ["ts", "side", "tie"], bucket)
    u = running(u, {"match": (F.col("right"), "last")}, reverse=True).filter("side = 0")
    ok = F.col("match.ts") <= F.col("ts") + tolerance
    return u.select("symbol", "ts", "tie", *[F.col("left." + c).alias(c) for c in lcols], F.when(ok, F.col("match")).alias("match"))


def forward_outcome(events: DataFrame, bars: DataFrame, at: str, horizon: int, clip=True) -> DataFrame:
    """Close at ``at`` and at ``at+horizon`` (clipped to the last bar when ``clip``)."""
    last = bars.groupBy("symbol").agg(F.max("seq").alias("_last"))
    e = events.join(last, "symbol")
    target = F.col(at) + horizon
    e = e.withColumn("_to", F.least(target, F.col("_last")) if clip else target)
    px = bars.select("symbol", F.col("seq").alias("_s"), F.col("close").alias("_px"))
    e = e.join(px.withColumnsRenamed({"_s": at, "_px": "start_px"}), ["symbol", at])
    e = e.join(px.withColumnsRenamed({"_s": "_to", "_px": "end_px"}), ["symbol", "_to"], "left" if clip else "inner")
    fwd = F.when(F.col(at) >= F.col("_last"), 0.0).otherwise(div(F.col("end_px") - F.col("start_px"), F.col("start_px")))
    return e.withColumn("outcome", fwd).drop("_to", "_last")


def first_touch(bars: DataFrame, take: float, stop: float, hold: int, side: Column | None = None, entries: Column | None = None,
                basis: Column | None = None, at_end=False) -> DataFrame:
    """Exit of every entry bar: first close past take or stop, else after ``hold`` bars.

    The next ``hold`` closes come from a forward frame of the same pass, so no
    range join and no pair rows are needed.  ``basis`` is the entry price.  Entries
    without an exit are dropped, or leave at the last bar when ``at_end``.
    """
    side = F.lit(1) if side is None else side
    basis = F.col("close") if basis is None else basis

    def build(h, w):
        return h.withColumn("_f", F.collect_list("close").over(w.rowsBetween(1, hold)))

    b = rolled(bars, build, 0, hold)
    if entries is not None:
        b = b.filter(entries)
    b = b.withColumn("_side", side).withColumn("_px", basis)
    hits = F.transform("_f", lambda x: (F.col("_side") * (x - F.col("_px")) / F.col("_px")))
    b = b.withColumn("_r", hits)
    b = b.withColumn("_k", F.array_position(F.transform("_r", lambda r: (r >= take) | (r <= -stop)), True))
    k = F.when(F.col("_k") > 0, F.col("_k")).when(F.size("_f") == hold, F.lit(hold))
    if at_end:
        k = k.when(F.size("_f") > 0, F.size("_f"))
    k = k.cast("int")
    b = b.withColumn("_x", k).filter("_x IS NOT NULL")
    r = F.try_element_at("_r", F.col("_x"))
    why = F.when((F.col("_k") == 0) & (F.col("_x") < hold), "end_of_backtest").when(F.col("_k") == 0, "max_holding").when(r >= take, "take_profit").otherwise("stop_loss")
    return b.select(*bars.columns, (F.col("seq") + F.col("_x")).alias("exit_seq"), F.try_element_at("_f", F.col("_x")).alias("exit_px"), why.alias("reason"))


def by_regime(returns: DataFrame, regimes: DataFrame, keys=("symbol", "ts")) -> DataFrame:
    """Inner join on key and date, then the per-regime metric set."""
    j = returns.join(regimes.select(*keys, "regime"), list(keys))
    total = j.groupBy("symbol").agg(F.count(F.lit(1)).alias("_all"))
    g = j.groupBy("symbol", "regime").agg(
        F.count(F.lit(1)).alias("days"), F.product(1 + F.col("r")).alias("_p"), F.sum(F.log1p("r")).alias("log_growth"), F.avg("r").alias("avg_return"),
        (F.stddev_samp("r") * 252 ** 0.5).alias("volatility"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))
    return g.join(total, "symbol").select("symbol", "regime", "days", (F.col("days") / F.col("_all")).alias("share"),
                                          (F.col("_p") - 1).alias("total_return"), "log_growth", "avg_return", "volatility", "win_rate")


def semi(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Rows of ``left`` whose key appears in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def resolve_members(sequences: DataFrame, members: DataFrame, key: str, fields) -> DataFrame:
    """Replace an array of ids by the array of member structs, order kept."""
    ids = sequences.select("seq_id", F.posexplode(key).alias("pos", "_id"))
    rec = F.struct("pos", *fields)
    return ids.join(members, ids["_id"] == members["id"]).groupBy("seq_id").agg(F.array_sort(F.collect_list(rec)).alias("members"))


def align(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Position-aligned returns: row k of a series against row k of the benchmark."""
    return returns.join(benchmark.select("seq", F.col("r").alias("bench")), "seq")


def next_label(patterns: DataFrame, label="type") -> DataFrame:
    """Label of the next pattern in the same series."""
    return rolled(patterns, lambda h, w: h.withColumn("next_" + label, F.lead(label).over(w)), 0, 1).filter(f"next_{label} IS NOT NULL")


def turnover(old: DataFrame, new: DataFrame, threshold=0.05) -> DataFrame:
    """Half the absolute weight change over the key union, and whether to rebalance."""
    j = old.select("symbol", F.col("weight").alias("_o")).join(new.select("symbol", F.col("weight").alias("_n")), "symbol", "full_outer")
    diff = F.abs(F.coalesce("_n", F.lit(0.0)) - F.coalesce("_o", F.lit(0.0)))
    return j.agg((F.sum(diff) / 2).alias("turnover"), F.count(F.lit(1)).alias("names")).withColumn("rebalance", 2 * F.col("turnover") > threshold)


def price_at(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Close of the bar with exactly the event's timestamp; unmatched events drop."""
    return events.join(bars.select("symbol", "ts", F.col("close").alias("price")), ["symbol", "ts"])


def context_slice(intervals: DataFrame, bars: DataFrame, periods=20) -> DataFrame:
    """Bars within ``periods`` median spacings of each interval.

    The range join is an equi-join on coarse time cells: an interval is written
    to each cell it overlaps, a bar to its own cell.
    """
    gaps = rolled(bars, lambda h, w: h.withColumn("_g", F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))), 1)
    med = quantiles(gaps, ["symbol"], "_g", {"_med": 0.5})
    cell = lambda x: F.floor(x / (86400 * 64))
    i = intervals.join(med, "symbol").select(
        "*", (F.unix_timestamp("start_ts") - periods * F.col("_med")).alias("_a"), (F.unix_timestamp("end_ts") + periods * F.col("_med")).alias("_z"))
    i = i.withColumn("_cell", F.explode(F.sequence(cell(F.col("_a")), cell(F.col("_z")))))
    b = bars.select("symbol", "ts", "seq", "close", F.unix_timestamp("ts").alias("_t")).withColumn("_cell", cell(F.col("_t")))
    return i.join(b, ["symbol", "_cell"]).filter((F.col("_t") >= F.col("_a")) & (F.col("_t") <= F.col("_z"))).drop("_cell", "_a", "_z", "_t", "_med")

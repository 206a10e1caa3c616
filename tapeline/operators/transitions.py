"""Transition models over state sequences (symbol, seq, state).

Counts come from ``lead`` on haloed chunks followed by a partial aggregation;
the matrices are long tables (from, to, p) bounded by the number of states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.frames import rolled, run_ids, running


def one():
    return F.count(F.lit(1))


def steps(seqs: DataFrame, order: int, by=("symbol",)) -> DataFrame:
    """Rows with an order-k state (array) and the state that follows it."""
    def build(h, w):
        arr = F.array(*[F.lead("state", k).over(w) if k else F.col("state") for k in range(order)])
        return h.select("*", arr.alias("from"), F.lead("state", order).over(w).alias("to"))

    return rolled(seqs, build, 0, order, by).filter("to IS NOT NULL")


def state_code(arr: Column, n: int) -> Column:
    """Base-n index of an order-k state."""
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, s: a * n + s)


def transition_matrix(seqs: DataFrame, n: int, order=1, smoothing=0.01, dense=True, extra=()) -> DataFrame:
    """Smoothed, row-normalised transition probabilities of the given order.

    ``dense`` lists every cell; otherwise only seen cells (an unseen cell of a
    seen row is ``smoothing / row_total``).
    """
    t = steps(seqs, order).withColumn("from", state_code(F.col("from"), n))
    c = t.groupBy(*extra, "from", "to").agg(one().alias("n"))
    if dense:
        ids = seqs.sparkSession.range(n ** order).select(F.col("id").alias("from"))
        tos = seqs.sparkSession.range(n).select(F.col("id").cast("int").alias("to"))
        grid = ids.crossJoin(F.broadcast(tos))
        if extra:
            grid = grid.crossJoin(F.broadcast(c.select(*extra).distinct()))
        c = F.broadcast(grid).join(c, [*extra, "from", "to"], "left").na.fill({"n": 0})
    row = Window.partitionBy(*extra, "from")
    total = F.sum("n").over(row) + n * smoothing
    return c.withColumn("p", (F.col("n") + smoothing) / total)


def empirical_matrix(seqs: DataFrame, absorbing=False) -> DataFrame:
    """Unsmoothed first-order shares; states without a successor get a self loop."""
    c = steps(seqs, 1).select(F.col("state").alias("from"), "to").groupBy("from", "to").agg(one().alias("n"))
    m = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))
    if not absorbing:
        return m
    ends = seqs.select(F.col("state").alias("from")).distinct().join(c.select("from").distinct(), "from", "left_anti")
    return m.unionByName(ends.select("from", F.col("from").alias("to"), F.lit(0).cast("long").alias("n"), F.lit(1.0).alias("p")))


def in_condition_runs(seqs: DataFrame) -> DataFrame:
    """Keep maximal runs of one condition with at least two members, as own sequences."""
    r = run_ids(seqs, F.col("cond"))
    size = r.groupBy("symbol", "run").agg(one().alias("_len"), F.min("seq").alias("_first"))
    r = r.join(size.filter("_len >= 2"), ["symbol", "run"])
    return r.select(F.struct("symbol", "run").alias("symbol"), (F.col("seq") - F.col("_first")).alias("seq"), "state", "cond")


def conditional_matrix(seqs: DataFrame, n: int, order=1, smoothing=0.01) -> DataFrame:
    """Transition matrix per market condition."""
    return transition_matrix(in_condition_runs(seqs), n, order, smoothing, extra=("cond",))


def markov_model(seqs: DataFrame, eps=1e-6) -> DataFrame:
    """Order-2 next-state probabilities over every type, unseen types at ``eps``."""
    c = steps(seqs, 2).groupBy("from", "to").agg(one().alias("n"))
    seen = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("from")))
    grid = c.select("from").distinct().crossJoin(F.broadcast(c.select("to").distinct()))
    p = grid.join(seen, ["from", "to"], "left").withColumn("p", F.coalesce("p", F.lit(eps)))
    return p.select("from", "to", (F.col("p") / F.sum("p").over(Window.partitionBy("from"))).alias("p"))


def as_matrix(m: DataFrame, n: int) -> DataFrame:
    """One row holding the n x n matrix as nested arrays; n is the number of states."""
    cell = m.groupBy().agg(F.map_from_entries(F.collect_list(F.struct((F.col("from") * n + F.col("to")).alias("k"), F.col("p").alias("v")))).alias("_m"))
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    get = lambda i, j: F.coalesce(F.try_element_at("_m", (i * n + j).cast("long")), F.lit(0.0))
    return cell.select(F.transform(idx, lambda i: F.transform(idx, lambda j: get(i, j))).alias("matrix"))


def _step(vec, n):
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(idx, lambda j: F.aggregate(idx, F.lit(0.0), lambda a, i: a + vec[i] * F.col("matrix")[i][j]))


def stationary(m: DataFrame, n: int, iterations=64) -> DataFrame:
    """Stationary distribution by power iteration from the uniform vector."""
    start = F.array_repeat(F.lit(1.0 / n), n)
    pi = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda v, _: _step(v, n))
    return as_matrix(m, n).select(F.posexplode(pi).alias("state", "p"))


def forecast_steps(m: DataFrame, n: int, current: DataFrame, horizon=5) -> DataFrame:
    """Distribution after 1..horizon steps from each current state (symbol, state)."""
    e = current.crossJoin(F.broadcast(as_matrix(m, n)))
    vec = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.col("state"), 1.0).otherwise(0.0))
    e = e.withColumn("v0", vec)
    for h in range(1, horizon + 1):
        e = e.withColumn(f"v{h}", _step(F.col(f"v{h - 1}"), n))
    rows = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"v{h}").alias("v")) for h in range(1, horizon + 1)])
    return e.select("symbol", F.explode(rows).alias("x")).select("symbol", F.col("x.h").alias("horizon"), F.posexplode("x.v").alias("state", "p"))


def transition_features(seqs: DataFrame, n: int) -> DataFrame:
    """Mean/std/min/max of first-order probabilities, order-2 mean/std, geometric likelihood."""
    m1 = transition_matrix(seqs, n).select(F.col("from").alias("_f"), "to", "p")
    s1 = steps(seqs, 1).withColumn("_f", F.col("state").cast("long")).join(F.broadcast(m1), ["_f", "to"])
    g1 = s1.groupBy("symbol").agg(
        F.avg("p").alias("trans_prob_mean"), F.stddev_pop("p").alias("trans_prob_std"), F.min("p").alias("trans_prob_min"), F.max("p").alias("trans_prob_max"),
        F.exp(F.avg(F.ln("p"))).alias("sequence_likelihood"))
    m2 = transition_matrix(seqs, n, 2).select(F.col("from").alias("_f"), "to", "p")
    s2 = steps(seqs, 2).withColumn("_f", state_code(F.col("from"), n)).join(m2, ["_f", "to"])
    g2 = s2.groupBy("symbol").agg(F.avg("p").alias("trans_prob_order2_mean"), F.stddev_pop("p").alias("trans_prob_order2_std"))
    return g1.join(g2, "symbol", "left")


def row_entropy(m: DataFrame) -> DataFrame:
    return m.groupBy("from").agg((-F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))).alias("h"))


def entropy_features(seqs: DataFrame, n: int) -> DataFrame:
    """State entropy, mean/max row entropy of the states present, order-2 conditional entropy."""
    share = seqs.groupBy("symbol", "state").agg(one().alias("k"))
    share = share.withColumn("q", F.col("k") / F.sum("k").over(Window.partitionBy("symbol")))
    h1 = row_entropy(transition_matrix(seqs, n)).withColumnRenamed("from", "state")
    a = share.join(F.broadcast(h1), "state").groupBy("symbol").agg(
        (-F.sum(F.col("q") * F.ln(F.col("q") + 1e-10))).alias("pattern_entropy"), F.avg("h").alias("mean_transition_entropy"), F.max("h").alias("max_transition_entropy"))
    h2 = row_entropy(transition_matrix(seqs, n, 2)).withColumnRenamed("from", "_f")
    b = steps(seqs, 2).withColumn("_f", state_code(F.col("from"), n)).join(h2, "_f").groupBy("symbol").agg(F.avg("h").alias("conditional_entropy"))
    return a.join(b, "symbol", "left")


def stability_features(seqs: DataFrame, n: int) -> DataFrame:
    """Self-transition mean/min, longest run and change rate."""
    self_p = transition_matrix(seqs, n).filter("from = to").select(F.col("from").cast("int").alias("state"), "p")
    a = seqs.join(F.broadcast(self_p), "state").groupBy("symbol").agg(F.avg("p").alias("mean_pattern_stability"), F.min("p").alias("min_pattern_stability"))
    r = run_ids(seqs, F.col("state"))
    b = r.groupBy("symbol", "run").agg(one().alias("len")).groupBy("symbol").agg(
        F.max("len").alias("max_consecutive_patterns"), ((F.count(F.lit(1)) - 1) / (F.sum("len") - 1)).alias("pattern_change_rate"))
    return a.join(b, "symbol")


def cycles(seqs: DataFrame, shortest=2, longest=10) -> DataFrame:
    """Distinct immediate repeats per sequence: a block followed by itself."""
    size = seqs.groupBy("symbol").agg(one().alias("_n"))
    ahead = rolled(seqs, lambda h, w: h.withColumn("_f", F.collect_list("state").over(w.rowsBetween(0, 2 * longest - 1))), 0, 2 * longest)
    d = ahead.join(size, "symbol").withColumn("len", F.explode(F.sequence(F.lit(shortest), F.lit(longest))))
    ok = (F.col("len") < F.floor(F.col("_n") / 2)) & (F.size("_f") >= 2 * F.col("len"))
    d = d.filter(ok & (F.slice("_f", F.lit(1), F.col("len")) == F.slice("_f", F.col("len") + 1, F.col("len"))))
    return d.select("symbol", F.slice("_f", F.lit(1), F.col("len")).alias("cycle"), "len").distinct()


def cycle_features(seqs: DataFrame) -> DataFrame:
    c = cycles(seqs).groupBy("symbol").agg(one().alias("c"), F.avg("len").alias("a"), F.max("len").alias("m"))
    return seqs.select("symbol").distinct().join(c, "symbol", "left").select(
        "symbol", F.coalesce("c", F.lit(0)).alias("num_cycles"), F.coalesce("a", F.lit(0.0)).alias("avg_cycle_length"), F.coalesce("m", F.lit(0)).alias("max_cycle_length"))


def conditional_features(seqs: DataFrame, n: int, conditions) -> DataFrame:
    """Per-condition probability mean/std, condition change rate and change ratio."""
    m = conditional_matrix(seqs, n).select("cond", F.col("from").alias("_f"), "to", "p")
    s = steps(seqs, 1).withColumn("_f", F.col("state").cast("long")).join(F.broadcast(m), ["cond", "_f", "to"])
    a = s.groupBy("symbol").pivot("cond", list(conditions)).agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))
    a = a.select("symbol", *[F.col(f"{c}_{k}").alias(f"trans_prob_{c}_{k}") for c in conditions for k in ("mean", "std")])
    ch = rolled(seqs, lambda h, w: h.select("symbol", "seq", "_c", (F.lag("cond").over(w) != F.col("cond")).cast("int").alias("cc"), (F.lag("state").over(w) != F.col("state")).cast("int").alias("pc")), 1)
    b = ch.groupBy("symbol").agg(F.sum("cc").alias("_cc"), F.sum("pc").alias("_pc"), one().alias("_n"))
    ratio = F.when(F.col("_cc") > 0, F.col("_pc") / F.col("_cc")).otherwise(0.0)
    return a.join(b.select("symbol", (F.col("_cc") / (F.col("_n") - 1)).alias("condition_change_rate"), ratio.alias("pattern_condition_correlation")), "symbol")


def distribution_features(patterns: DataFrame, types, by=("symbol",)) -> DataFrame:
    """Type shares, run statistics, frequency, strength trend and moments per sequence."""
    by = list(by)
    g = patterns.groupBy(*by).agg(
        *[F.avg((F.col("type") == t).cast("double")).alias(f"{t}_ratio") for t in types],
        one().alias("_n"), F.min("ts").alias("_a"), F.max("ts").alias("_z"), F.regr_slope("strength", "seq").alias("_t"), F.max_by("strength", "seq").alias("recent_strength"),
        F.avg("price_change").alias("mean_price_change"), F.stddev_pop("price_change").alias("std_price_change"), F.min("price_change").alias("min_price_change"), F.max("price_change").alias("max_price_change"),
        F.avg("strength").alias("mean_strength"), F.stddev_pop("strength").alias("std_strength"), F.avg("volatility").alias("mean_volatility"), F.stddev_pop("volatility").alias("std_volatility"))
    hours = (F.unix_timestamp("_z") - F.unix_timestamp("_a")) / 3600
    g = g.withColumn("pattern_frequency", F.coalesce(F.try_divide("_n", hours), F.lit(0.0))).withColumn("strength_trend", F.coalesce("_t", F.lit(0.0)))
    r = run_ids(patterns, F.col("type"), by).groupBy(*by, "run").agg(one().alias("len")).groupBy(*by).agg(
        F.avg("len").alias("avg_run_length"), F.max("len").alias("max_run_length"), (one() - 1).alias("_ch"))
    out = g.join(r, by).withColumn("transition_rate", F.coalesce(F.try_divide("_ch", F.col("_n") - 1), F.lit(0.0)))
    return out.drop("_n", "_a", "_z", "_t", "_ch")


def pattern_vector(patterns: DataFrame, types) -> DataFrame:
    """One row per pattern: one-hot type, strength, change, duration, shape block, time of day/week/month."""
    return patterns.select(
        "symbol", "seq", *[(F.col("type") == t).cast("double").alias(f"is_{t}") for t in types], "strength", "price_change",
        (F.col("end_seq") - F.col("start_seq")).cast("double").alias("duration"), F.coalesce("volatility", F.lit(0.0)).alias("volatility"),
        F.coalesce("price_range", F.lit(0.0)).alias("price_range"), F.coalesce("trend_strength", F.lit(0.0)).alias("trend_strength"),
        (F.hour("ts") / 24).alias("hour_of_day"), (F.weekday("ts") / 6).alias("day_of_week"), (F.dayofmonth("ts") / 31).alias("day_of_month"))


def gap_sequences(patterns: DataFrame, start: Column, length: Column, max_gap: int, min_length=2) -> DataFrame:
    """Number sequences; a new one starts when the gap after the previous pattern exceeds ``max_gap``."""
    d = patterns.withColumn("_a", start).withColumn("_l", length)
    d = rolled(d, lambda h, w: h.withColumn("_new", F.when(F.col("_a") - (F.lag("_a").over(w) + F.lag("_l").over(w)) > max_gap, 1).otherwise(0)), 1)
    d = running(d, {"sequence": (F.col("_new"), "sum")}).drop("_new")
    size = d.groupBy("symbol", "sequence").agg(one().alias("members"), F.min("_a").alias("first"), F.max("_a").alias("last"))
    return d.join(size.filter(F.col("members") >= min_length), ["symbol", "sequence"]).drop("_a", "_l")


def sequence_statistics(members: DataFrame, label="type") -> DataFrame:
    """Totals, distinct labels and min/avg/max length over gap sequences."""
    s = members.groupBy("symbol", "sequence").agg(one().alias("n"))
    a = s.agg(one().alias("sequences"), F.sum("n").alias("patterns"), F.min("n").alias("min_length"), F.avg("n").alias("avg_length"), F.max("n").alias("max_length"))
    return a.crossJoin(members.agg(F.countDistinct(label).alias("labels")))

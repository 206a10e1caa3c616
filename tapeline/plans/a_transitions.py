"""Transition-model queries."""

from pyspark.sql import functions as F

from tapeline.operators import aggregates as A
from tapeline.operators import transitions as T
from tapeline.plans.registry import cte, query
from tapeline.plans.w_indicators import W, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import ticks_u

cte("states", "SELECT symbol, seq, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS state, CASE WHEN price < 20 THEN 'low' WHEN price < 60 THEN 'mid' ELSE 'high' END AS cond FROM ticks_u", "ticks_u")
cte("grid", 'SELECT i AS "from", j AS "to" FROM range(5) a(i), range(5) b(j)')
cte("m1", f"""SELECT "from", "to", n, (n + 0.01) / (sum(n) OVER (PARTITION BY "from") + 0.05) AS p FROM (SELECT g.*, count(t) AS n FROM grid g LEFT JOIN (SELECT state AS f, lead(state) OVER w AS t FROM states {W}) x ON x.f = g."from" AND x.t = g."to" GROUP BY ALL)""", "states grid")
cte("m2", f"""SELECT "from", "to", n, (n + 0.01) / (sum(n) OVER (PARTITION BY "from") + 0.05) AS p FROM (SELECT i AS "from", j AS "to", count(t) AS n FROM range(25) a(i) CROSS JOIN range(5) b(j)
  LEFT JOIN (SELECT state * 5 + lead(state) OVER w AS f, lead(state, 2) OVER w AS t FROM states {W}) x ON x.f = i AND x.t = j GROUP BY ALL)""", "states")
cte("crun", f"""SELECT *, count(*) OVER (PARTITION BY symbol, run) AS len FROM (SELECT *, sum(chg) OVER w AS run FROM (SELECT *, CASE WHEN lag(cond) OVER w <> cond THEN 1 ELSE 0 END AS chg FROM states {W}) {W})""", "states")
cte("mc", """SELECT cond, "from", "to", n, (n + 0.01) / (sum(n) OVER (PARTITION BY cond, "from") + 0.05) AS p FROM (SELECT c.cond, g.*, count(t) AS n FROM (SELECT DISTINCT cond FROM crun WHERE len >= 2) c CROSS JOIN grid g
  LEFT JOIN (SELECT cond, state AS f, lead(state) OVER (PARTITION BY symbol, run ORDER BY seq) AS t FROM crun) x ON x.cond = c.cond AND x.f = g."from" AND x.t = g."to" GROUP BY ALL)""", "crun grid")

# State code of each event type.
CODES = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def states(spark, root):
    code = F.lit(4)
    for k, v in CODES.items():
        code = F.when(F.col("event_type") == k, v).otherwise(code)
    p = F.col("price")
    return ticks_u(spark, root).select("symbol", "seq", code.alias("state"), F.when(p < 20, "low").when(p < 60, "mid").otherwise("high").alias("cond"))


@query("a14_transition_matrix", "m1", "SELECT * FROM m1", "p")
def a14(spark, root):
    return T.transition_matrix(states(spark, root), 5).withColumn("to", F.col("to").cast("long"))


@query("a15_order_k_matrix", "states", f"""SELECT f AS "from", t AS "to", n, (n + 0.01) / (sum(n) OVER (PARTITION BY f) + 0.05) AS p FROM (SELECT f, t, count(*) AS n FROM (
  SELECT CAST((state * 5 + lead(state) OVER w) * 5 + lead(state, 2) OVER w AS BIGINT) AS f, lead(state, 3) OVER w AS t FROM states {W}) WHERE t IS NOT NULL GROUP BY ALL)""", "p")
def a15(spark, root):
    return T.transition_matrix(states(spark, root), 5, 3, dense=False)


@query("a16_conditional_matrix", "mc", "SELECT * FROM mc", "p")
def a16(spark, root):
    return T.conditional_matrix(states(spark, root), 5).withColumn("to", F.col("to").cast("long"))


@query("a17_empirical_matrix", "patterns", f"""SELECT f AS "from", t AS "to", n, n / sum(n) OVER (PARTITION BY f) AS p FROM (
  SELECT f, t, count(*) AS n FROM (SELECT type AS f, lead(type) OVER w AS t FROM patterns {W}) WHERE t IS NOT NULL GROUP BY ALL)""", "p")
def a17(spark, root):
    p = D.patterns(spark, root).select("symbol", "seq", F.col("type").alias("state"))
    return T.empirical_matrix(p, absorbing=True)


@query("a18_markov_order2", "states", f"""WITH c AS (SELECT f, t, count(*) AS n FROM (SELECT state * 10 + lead(state) OVER w AS f, lead(state, 2) OVER w AS t FROM states {W}) WHERE t IS NOT NULL GROUP BY ALL),
  g AS (SELECT f, t, coalesce(p, 1e-6) AS p FROM (SELECT DISTINCT f FROM c) CROSS JOIN (SELECT DISTINCT t FROM c) LEFT JOIN (SELECT f, t, n / sum(n) OVER (PARTITION BY f) AS p FROM c) USING (f, t))
  SELECT f // 10 AS s1, f % 10 AS s2, t AS "to", p / sum(p) OVER (PARTITION BY f) AS p FROM g""", "p")
def a18(spark, root):
    return T.markov_model(states(spark, root)).select(F.col("from")[0].alias("s1"), F.col("from")[1].alias("s2"), "to", "p")


_VEC = "[list_sum([v[i] * m[i][j] for i in range(1, 6)]) for j in range(1, 6)]"
_MAT = """mat AS (SELECT list(r ORDER BY f) AS m FROM (SELECT "from" AS f, list(p ORDER BY "to") AS r FROM m1 GROUP BY 1))"""


@query("a19_stationary", "m1", f"WITH RECURSIVE {_MAT}, it AS (SELECT 0 AS k, [0.2::DOUBLE, 0.2, 0.2, 0.2, 0.2] AS v UNION ALL SELECT k + 1, {_VEC} FROM it, mat WHERE k < 64) SELECT j AS state, v[j + 1] AS p FROM it, range(5) t(j) WHERE k = 64", "p", d=9)
def a19(spark, root):
    return T.stationary(T.transition_matrix(states(spark, root), 5), 5).withColumn("state", F.col("state").cast("long"))


@query("a20_multi_step", "m1", f"""WITH RECURSIVE {_MAT}, it AS (SELECT 0 AS k, symbol, list_transform(range(5), lambda i: CASE WHEN i = s THEN 1.0::DOUBLE ELSE 0.0 END) AS v FROM (SELECT symbol, arg_max(state, seq) AS s FROM states GROUP BY symbol)
  UNION ALL SELECT k + 1, symbol, {_VEC} FROM it, mat WHERE k < 5) SELECT symbol, CAST(k AS INT) AS horizon, j AS state, v[j + 1] AS p FROM it, range(5) t(j) WHERE k > 0""", "p", d=9)
def a20(spark, root):
    s = states(spark, root)
    now = s.groupBy("symbol").agg(F.max_by("state", "seq").alias("state"))
    return T.forecast_steps(T.transition_matrix(s, 5), 5, now).withColumn("state", F.col("state").cast("long"))


_A21 = "trans_prob_mean trans_prob_std trans_prob_min trans_prob_max sequence_likelihood trans_prob_order2_mean trans_prob_order2_std"


@query("a21_transition_features", "m1 m2", f"""SELECT * FROM (SELECT symbol, avg(p) AS trans_prob_mean, stddev_pop(p) AS trans_prob_std, min(p) AS trans_prob_min, max(p) AS trans_prob_max, exp(avg(ln(p))) AS sequence_likelihood
  FROM (SELECT symbol, state AS f, lead(state) OVER w AS t FROM states {W}) JOIN m1 ON f = "from" AND t = "to" GROUP BY symbol) LEFT JOIN (SELECT symbol, avg(p) AS trans_prob_order2_mean, stddev_pop(p) AS trans_prob_order2_std
  FROM (SELECT symbol, state * 5 + lead(state) OVER w AS f, lead(state, 2) OVER w AS t FROM states {W}) JOIN m2 ON f = "from" AND t = "to" GROUP BY symbol) USING (symbol)""", _A21)
def a21(spark, root):
    return T.transition_features(states(spark, root), 5)


@query("a22_entropy_features", "m1 m2", f"""WITH h1 AS (SELECT "from" AS s, -sum(p * ln(p + 1e-10)) AS h FROM m1 GROUP BY 1), h2 AS (SELECT "from" AS s, -sum(p * ln(p + 1e-10)) AS h FROM m2 GROUP BY 1),
  q AS (SELECT symbol, state, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS q FROM states GROUP BY symbol, state)
  SELECT * FROM (SELECT symbol, -sum(q * ln(q + 1e-10)) AS pattern_entropy, avg(h) AS mean_transition_entropy, max(h) AS max_transition_entropy FROM q JOIN h1 ON s = state GROUP BY symbol)
  LEFT JOIN (SELECT symbol, avg(h) AS conditional_entropy FROM (SELECT symbol, state * 5 + lead(state) OVER w AS f, lead(state, 2) OVER w AS t FROM states {W}) JOIN h2 ON f = s WHERE t IS NOT NULL GROUP BY symbol) USING (symbol)""",
       "pattern_entropy mean_transition_entropy max_transition_entropy conditional_entropy")
def a22(spark, root):
    return T.entropy_features(states(spark, root), 5)


@query("a23_stability_features", "m1", f"""SELECT * FROM (SELECT symbol, avg(p) AS mean_pattern_stability, min(p) AS min_pattern_stability FROM states JOIN m1 ON "from" = state AND "to" = state GROUP BY symbol) JOIN (
  SELECT symbol, max(len) AS max_consecutive_patterns, (count(*) - 1) / (sum(len) - 1) AS pattern_change_rate FROM (SELECT symbol, run, count(*) AS len FROM (SELECT *, sum(chg) OVER w AS run FROM (
   SELECT *, CASE WHEN lag(state) OVER w <> state THEN 1 ELSE 0 END AS chg FROM states {W}) {W}) GROUP BY ALL) GROUP BY symbol) USING (symbol)""", "mean_pattern_stability min_pattern_stability pattern_change_rate")
def a23(spark, root):
    return T.stability_features(states(spark, root), 5)


@query("a24_cycles", "states", """WITH f AS (SELECT symbol, list(state) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS f, count(*) OVER (PARTITION BY symbol) AS n FROM states),
  c AS (SELECT DISTINCT symbol, f[1:k] AS cyc, k FROM f, range(2, 11) t(k) WHERE k < n // 2 AND len(f) >= 2 * k AND f[1:k] = f[k + 1:2 * k])
  SELECT s.symbol, count(k) AS num_cycles, coalesce(avg(k), 0) AS avg_cycle_length, CAST(coalesce(max(k), 0) AS INT) AS max_cycle_length FROM (SELECT DISTINCT symbol FROM states) s LEFT JOIN c USING (symbol) GROUP BY s.symbol""", "avg_cycle_length")
def a24(spark, root):
    return T.cycle_features(states(spark, root))


_A25 = " ".join(f"trans_prob_{c}_{k}" for c in ("low", "mid", "high") for k in ("mean", "std")) + " condition_change_rate pattern_condition_correlation"


@query("a25_conditional_features", "mc", "SELECT * FROM (SELECT symbol, " + ", ".join(f"avg(p) FILTER (cond = '{c}') AS trans_prob_{c}_mean, stddev_pop(p) FILTER (cond = '{c}') AS trans_prob_{c}_std" for c in ("low", "mid", "high"))
       + f""" FROM (SELECT symbol, cond AS c, state AS f, lead(state) OVER w AS t FROM states {W}) JOIN mc ON c = cond AND f = "from" AND t = "to" GROUP BY symbol) JOIN (
  SELECT symbol, sum(cc) / (count(*) - 1) AS condition_change_rate, CASE WHEN sum(cc) > 0 THEN sum(pc) / sum(cc) ELSE 0 END AS pattern_condition_correlation FROM (
   SELECT symbol, CAST(lag(cond) OVER w <> cond AS INT) AS cc, CAST(lag(state) OVER w <> state AS INT) AS pc FROM states {W}) GROUP BY symbol) USING (symbol)""", _A25)
def a25(spark, root):
    return T.conditional_features(states(spark, root), 5, ["low", "mid", "high"])


TY = A.PATTERN_TYPES
_A26 = " ".join(f"{t}_ratio" for t in TY) + " recent_strength mean_price_change std_price_change min_price_change max_price_change mean_strength std_strength mean_volatility std_volatility pattern_frequency strength_trend avg_run_length transition_rate"


@query("a26_distribution_features", "patterns", "SELECT * FROM (SELECT symbol, " + ", ".join(f"avg(CAST(type = '{t}' AS DOUBLE)) AS {t}_ratio" for t in TY) + f""", arg_max(strength, seq) AS recent_strength, avg(price_change) AS mean_price_change, stddev_pop(price_change) AS std_price_change,
  min(price_change) AS min_price_change, max(price_change) AS max_price_change, avg(strength) AS mean_strength, stddev_pop(strength) AS std_strength, avg(volatility) AS mean_volatility, stddev_pop(volatility) AS std_volatility,
  count(*) / ((epoch(max(ts)) - epoch(min(ts))) / 3600) AS pattern_frequency, regr_slope(strength, seq) AS strength_trend FROM patterns GROUP BY symbol) JOIN (
  SELECT symbol, avg(len) AS avg_run_length, max(len) AS max_run_length, (count(*) - 1) / (sum(len) - 1) AS transition_rate FROM (SELECT symbol, run, count(*) AS len FROM (SELECT *, sum(chg) OVER w AS run FROM (
   SELECT *, CASE WHEN lag(type) OVER w <> type THEN 1 ELSE 0 END AS chg FROM patterns {W}) {W}) GROUP BY ALL) GROUP BY symbol) USING (symbol)""", _A26)
def a26(spark, root):
    return T.distribution_features(D.patterns(spark, root), TY)


_A27 = "strength price_change duration volatility price_range trend_strength hour_of_day day_of_week day_of_month"


@query("a27_pattern_vector", "patterns", "SELECT symbol, seq, " + ", ".join(f"CAST(type = '{t}' AS DOUBLE) AS is_{t}" for t in TY) + ", strength, price_change, CAST(end_seq - start_seq AS DOUBLE) AS duration, volatility, price_range, trend_strength, hour(ts) / 24 AS hour_of_day, (isodow(ts) - 1) / 6 AS day_of_week, day(ts) / 31 AS day_of_month FROM patterns", _A27)
def a27(spark, root):
    return T.pattern_vector(D.patterns(spark, root), TY)


cte("gapseq", f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol, sequence) AS members, min(start_seq) OVER (PARTITION BY symbol, sequence) AS first, max(start_seq) OVER (PARTITION BY symbol, sequence) AS last FROM (
  SELECT *, CAST(sum(nw) OVER w AS BIGINT) AS sequence FROM (SELECT *, CASE WHEN start_seq - (lag(start_seq) OVER w + 20) > 0 THEN 1 ELSE 0 END AS nw FROM patterns {W}) {W})) WHERE members >= 2""", "patterns")


def gapseq(spark, root):
    return T.gap_sequences(D.patterns(spark, root), F.col("start_seq"), F.lit(20), 0)


@query("w29_gap_sequences", "gapseq", "SELECT symbol, seq, sequence, members, first, last FROM gapseq")
def w29(spark, root):
    return keep(gapseq(spark, root), "sequence", "members", "first", "last")


@query("a36_sequence_statistics", "gapseq", "SELECT * FROM (SELECT count(*) AS sequences, CAST(sum(n) AS BIGINT) AS patterns, min(n) AS min_length, avg(n) AS avg_length, max(n) AS max_length FROM (SELECT symbol, sequence, count(*) AS n FROM gapseq GROUP BY ALL)), (SELECT count(DISTINCT type) AS labels FROM gapseq)", "avg_length")
def a36(spark, root):
    return T.sequence_statistics(gapseq(spark, root))

"""Array and symbol queries, top-k and set queries."""

from pyspark.sql import functions as F

from tapeline.functions import arrays as AR
from tapeline.operators import aggregates as A
from tapeline.operators import projections as P
from tapeline.operators import selection as SEL
from tapeline.operators import shapes as SH
from tapeline.operators import symbolic as SX
from tapeline.operators import transitions as T
from tapeline.plans.a_transitions import states
from tapeline.plans.registry import cte, query
from tapeline.plans.w_indicators import W, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import bars_b, bars_d, bars_h, series, table

cte("sax", """SELECT id, label, array_to_string([CASE WHEN p <= -0.67 THEN 'a' WHEN p <= 0 THEN 'b' WHEN p <= 0.67 THEN 'c' ELSE 'd' END for p in [list_avg(z[k * 8 + 1:k * 8 + 8]) for k in range(8)]], '') AS sax
  FROM (SELECT id, label, [(x - m) / s for x in v] AS z FROM (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s FROM series))""", "series")


def words(spark, root):
    return SX.sax(series(spark, root))


@query("f01_sax", "sax", "SELECT id, sax FROM sax")
def f01(spark, root):
    return words(spark, root).select("id", "sax")


@query("f02_sax_inverse", "sax", "SELECT id, t AS pos, [-1.17, -0.335, 0.335, 1.17][ascii(sax[t // 8 + 1]) - 96] AS value FROM sax, range(64) r(t)", "value")
def f02(spark, root):
    d = SX.inverse(words(spark, root).select("id", "sax"), 64).select("id", F.posexplode("v").alias("pos", "value"))
    return d.withColumn("pos", F.col("pos").cast("long"))


@query("f03_sax_similarity", "sax", """WITH c AS (SELECT label, arg_min(sax, id) AS ref, min(id) AS rid FROM sax GROUP BY label) SELECT id, rid, len([1 for k in range(1, 9) if sax[k] = ref[k]]) / 8 AS similarity, len([1 for k in range(1, 9) if sax[k] <> ref[k]]) / 8 AS distance,
  len([1 for k in range(1, 9) if sax[k] = (ref[1:5] || repeat(ref[5], 3))[k]]) / 8 AS padded FROM sax JOIN c USING (label)""", "similarity distance padded")
def f03(spark, root):
    s = words(spark, root)
    ref = s.groupBy("label").agg(F.min_by("sax", "id").alias("ref"), F.min("id").alias("rid"))
    sim = SX.similarity(F.col("sax"), F.col("ref"))
    return s.join(ref, "label").select("id", "rid", sim.alias("similarity"), (1 - sim).alias("distance"), SX.padded_similarity(F.col("sax"), F.substr("ref", F.lit(1), F.lit(5))).alias("padded"))


@query("f04_sax_features", "sax", """SELECT id, len(list_distinct(l)) AS unique_symbols, -list_sum([len([1 for x in l if x = u]) / 8 * log2(len([1 for x in l if x = u]) / 8 + 1e-10) for u in list_distinct(l)]) AS symbol_entropy,
  len([1 for k in range(1, 8) if l[k] <> l[k + 1]]) / 7 AS transition_rate FROM (SELECT id, string_split(sax, '') AS l FROM sax)""", "symbol_entropy transition_rate")
def f04(spark, root):
    return SX.features(words(spark, root)).select("id", F.col("unique_symbols").cast("long").alias("unique_symbols"), "symbol_entropy", "transition_rate")


@query("f05_sax_motifs", "sax", """SELECT label, sub, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY frequency DESC, sub) AS rank FROM (SELECT label, sax[i:i + k - 1] AS sub, count(*) AS frequency FROM sax, range(5, 9) a(k), range(1, 5) b(i)
  WHERE i + k - 1 <= 8 GROUP BY ALL) WHERE frequency >= 3) WHERE rank <= 5""")
def f05(spark, root):
    return SX.motifs(words(spark, root), "label").withColumn("rank", F.col("rank").cast("long"))


_F16 = "mean std min max skew kurt q25 q75 median slope mean_diff std_diff up_share variation"


@query("f16_shape_statistics", "series", """WITH d AS (SELECT *, [v[k + 1] - v[k] for k in range(1, 64)] AS d, list_avg(v) AS m FROM series), e AS (SELECT *, list_avg([(x - m) ** 2 for x in v]) AS m2 FROM d)
  SELECT id, m AS mean, sqrt(m2) AS std, list_min(v) AS min, list_max(v) AS max, list_avg([(x - m) ** 3 for x in v]) / m2 ** 1.5 AS skew, list_avg([(x - m) ** 4 for x in v]) / m2 ** 2 - 3 AS kurt, list_aggregate(v, 'quantile_cont', 0.25) AS q25, list_aggregate(v, 'quantile_cont', 0.75) AS q75,
  list_aggregate(v, 'quantile_cont', 0.5) AS median, list_sum([v[k] * (k - 32.5) for k in range(1, 65)]) / (64 * (64 * 64 - 1) / 12) AS slope, len([1 for k in range(2, 64) if v[k] > v[k - 1] and v[k] > v[k + 1]]) AS peaks, len([1 for k in range(2, 64) if v[k] < v[k - 1] and v[k] < v[k + 1]]) AS valleys,
  list_avg(d) AS mean_diff, list_stddev_pop(d) AS std_diff, len([1 for x in d if x > 0]) / 63 AS up_share, list_sum([abs(x) for x in d]) AS variation FROM e""", _F16)
def f16(spark, root):
    d = SH.statistics(series(spark, root)).drop("label")
    return d.withColumns({"peaks": F.col("peaks").cast("long"), "valleys": F.col("valleys").cast("long")})


def to_reference(spark, root):
    """Every series paired with the first series of its label."""
    s = series(spark, root)
    ref = s.groupBy("label").agg(F.min("id").alias("rid"), F.min_by("v", "id").alias("y"))
    return s.join(ref, "label").select("id", "rid", F.col("v").alias("x"), "y")


cte("toref", "SELECT id, rid, v AS x, y FROM series JOIN (SELECT label, min(id) AS rid, arg_min(v, id) AS y FROM series GROUP BY label) USING (label)", "series")
_F22 = "mean_difference std_difference median_difference ks pearson spearman kendall rmse mae max_difference cross_correlation trend_agreement volatility_ratio"


@query("f22_pair_statistics", "toref", """WITH p AS (SELECT *, [x[k] - y[k] for k in range(1, 65)] AS e, [len([1 for b in x if b < a]) + (len([1 for b in x if b = a]) + 1) / 2 for a in x] AS rx, [len([1 for b in y if b < a]) + (len([1 for b in y if b = a]) + 1) / 2 for a in y] AS ry,
   [list_sum([coalesce(x[t + k], 0) * y[t] for t in range(greatest(1, 1 - k), least(65, 65 - k))]) for k in range(-32, 32)] AS cc FROM toref),
  c AS (SELECT id, rid, corr(a, b) AS pearson, corr(ra, rb) AS spearman FROM (SELECT id, rid, unnest(x) AS a, unnest(y) AS b, unnest(rx) AS ra, unnest(ry) AS rb FROM p) GROUP BY ALL)
  SELECT id, rid, list_avg(x) - list_avg(y) AS mean_difference, list_stddev_pop(x) - list_stddev_pop(y) AS std_difference, list_aggregate(x, 'quantile_cont', 0.5) - list_aggregate(y, 'quantile_cont', 0.5) AS median_difference,
   list_max([abs(len([1 for a in x if a <= t]) - len([1 for a in y if a <= t])) / 64 for t in list_concat(x, y)]) AS ks, pearson, spearman, list_sum([list_sum([sign(x[i] - x[j]) * sign(y[i] - y[j]) for j in range(1, i)]) for i in range(2, 65)]) / (64 * 63 / 2) AS kendall,
   sqrt(list_avg([i * i for i in e])) AS rmse, list_avg([abs(i) for i in e]) AS mae, list_max([abs(i) for i in e]) AS max_difference, list_max(cc) AS cross_correlation, CAST(list_position(cc, list_max(cc)) - 1 - 32 AS INT) AS phase_shift,
   len([1 for k in range(1, 64) if sign(x[k + 1] - x[k]) = sign(y[k + 1] - y[k])]) / 63 AS trend_agreement, list_stddev_pop(x) / list_stddev_pop(y) AS volatility_ratio FROM p JOIN c USING (id, rid)""", _F22)
def f22(spark, root):
    return SH.pair_statistics(to_reference(spark, root))


@query("f24_difference_highlight", "toref", "SELECT id, rid, list_max(a) AS max_value, list_position(a, list_max(a)) - 1 AS max_pos FROM (SELECT id, rid, [abs(x[k] - y[k]) for k in range(1, 65)] AS a FROM toref)", "max_value")
def f24(spark, root):
    return SH.difference_highlight(to_reference(spark, root)).withColumn("max_pos", F.col("max_pos").cast("long"))


@query("f26_resample", "series", "SELECT id, k AS pos, v[lo + 1] + (coalesce(v[lo + 2], v[lo + 1]) - v[lo + 1]) * (p - lo) AS value FROM (SELECT id, v, k, k * 63 / 39 AS p, CAST(floor(k * 63 / 39) AS INT) AS lo FROM series, range(40) t(k))", "value")
def f26(spark, root):
    d = series(spark, root).select("id", F.posexplode(AR.resample("v", 40)).alias("pos", "value"))
    return d.withColumn("pos", F.col("pos").cast("long"))


@query("k01_top_k", "patterns", "SELECT type, symbol, seq, strength, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY strength DESC, symbol, seq) AS rank FROM patterns) WHERE rank <= 5", "strength")
def k01(spark, root):
    p = D.patterns(spark, root).select("type", "symbol", "seq", "strength")
    return SEL.top_k(p, ["type"], [F.col("strength").desc(), "symbol", "seq"], 5).withColumn("rank", F.col("rank").cast("long"))


@query("k02_highest_variance", "series", """SELECT id, n AS length, start, var AS variance FROM (SELECT id, n, start, list_var_pop(v[start + 1:start + n]) AS var FROM series, (VALUES (16)) g(n), range(0, 49, 8) t(start)) ORDER BY var DESC, id, start LIMIT 20""", "variance", d=9)
def k02(spark, root):
    s = P.subsequences(series(spark, root), [16], lambda n: n // 2)
    return SEL.highest_variance(s, 20).select("id", "length", "start", "variance")


@query("k04_next_pattern", "m1", 'SELECT "from", "to", p, rank FROM (SELECT *, row_number() OVER (PARTITION BY "from" ORDER BY p DESC, "to") AS rank FROM m1) WHERE rank <= 3', "p")
def k04(spark, root):
    m = T.transition_matrix(states(spark, root), 5).select("from", F.col("to").cast("long").alias("to"), "p")
    return SEL.top_k(m, ["from"], [F.col("p").desc(), "to"], 3).withColumn("rank", F.col("rank").cast("long"))


@query("k05_diverse", "series", """WITH RECURSIVE q AS (SELECT id, v, list_stddev_pop(v) AS q FROM series), st AS (SELECT 0 AS round, [arg_max(id, q)] AS ids FROM q UNION ALL
  SELECT round + 1, list_append(ids, (SELECT arg_max(a.id, g) FROM (SELECT a.id, min(list_distance(a.v, b.v)) AS g FROM q a JOIN q b ON list_contains(st.ids, b.id) WHERE NOT list_contains(st.ids, a.id) GROUP BY a.id) a)) FROM st WHERE round < 4)
  SELECT k AS round, ids[k + 1] AS id FROM st, range(5) t(k) WHERE round = 4""")
def k05(spark, root):
    s = series(spark, root)
    return SEL.diverse(s.select("id", AR.std("v").alias("quality"), "v"), 5).withColumn("round", F.col("round").cast("long"))


@query("k06_frontier", "predictions", """WITH m AS (SELECT model, avg(CAST(pred = actual AS DOUBLE)) AS accuracy, avg(y_pred) AS latency FROM predictions GROUP BY model) SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.latency < a.latency AND b.accuracy >= a.accuracy)""", "accuracy latency")
def k06(spark, root):
    m = D.predictions(spark, root).groupBy("model").agg(A.share(F.col("pred") == F.col("actual")).alias("accuracy"), F.avg("y_pred").alias("latency"))
    return SEL.frontier(m)


@query("u01_tagged_union", "patterns trades", "SELECT 'pattern' AS source, symbol, start_seq AS seq, type AS label FROM patterns UNION ALL SELECT 'trade', symbol, entry_seq, reason FROM trades")
def u01(spark, root):
    return SEL.tagged_union({"pattern": D.patterns(spark, root).select("symbol", F.col("start_seq").alias("seq"), F.col("type").alias("label")),
                             "trade": D.trades(spark, root).select("symbol", F.col("entry_seq").alias("seq"), F.col("reason").alias("label"))})


@query("u02_distinct", "states", """WITH f AS (SELECT symbol, list(state) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS f, count(*) OVER (PARTITION BY symbol) AS n FROM states)
  SELECT DISTINCT array_to_string(f[1:k], '-') AS cycle FROM f, range(2, 11) t(k) WHERE k < n // 2 AND len(f) >= 2 * k AND f[1:k] = f[k + 1:2 * k]""")
def u02(spark, root):
    return T.cycles(states(spark, root)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), "-").alias("cycle")).distinct()


@query("u03_key_sets", "", """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100)
  SELECT 'union' AS source, user_id FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersection', user_id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'left_only', user_id FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'right_only', user_id FROM (FROM b EXCEPT FROM a)""")
def u03(spark, root):
    e = table(spark, root, "events").filter("value > 100")
    return SEL.key_sets(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), "user_id")

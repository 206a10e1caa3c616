"""Feature vectors, timeframes, pair measures, template and vocabulary matching."""

from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.operators import pairs as PR
from tapeline.operators import vectors as V
from tapeline.plans.f_arrays import to_reference
from tapeline.plans.k_kernels import dtw_cte, library
from tapeline.plans.registry import cte, query
from tapeline.sources.tables import series

_ALL = [n for names in V.NAMES.values() for n in names]
PART, STEP = 16, 8


@query("f14_pattern_vector", nums=" ".join(_ALL))
def f14(spark, root):
    return V.pattern_vector(series(spark, root))


@query("f14_scaled_vector", nums=" ".join(_ALL))
def f14_scaled(spark, root):
    return V.standard(store(V.pattern_vector(series(spark, root))), _ALL)


_SOME = V.NAMES["temporal"] + V.NAMES["amplitude"]


@query("f15_feature_groups", "series", """WITH a AS (SELECT id, v, [list_dot_product(v[1:64 - k], v[k + 1:64]) for k in range(64)] AS r, [abs(x) for x in v] AS m FROM series)
  SELECT id, 64.0 AS duration, CAST(coalesce(list_min([k - 1 for k in range(2, 64) if r[k] > r[k - 1] AND r[k] > r[k + 1]]), 16) AS DOUBLE) AS scale, list_position(m, list_max(m)) - 1.0 AS time_to_peak, 64.0 - list_position(m, list_max(m)) AS time_from_peak,
  list_max(v) AS amplitude_max, list_min(v) AS amplitude_min, list_avg(v) AS amplitude_mean, list_stddev_pop(v) AS amplitude_std, list_max(v) - list_min(v) AS amplitude_range FROM a""", " ".join(_SOME))
def f15(spark, root):
    return V.pattern_vector(series(spark, root), ("temporal", "amplitude"))


dtw_cte("dtw_square", "SELECT * FROM toref WHERE id <> rid", "toref", 64, cost="(x[i] - y[j]) ** 2")


@query("f23_similarity_set", "dtw_square", """SELECT id, rid, sqrt(distance) AS dtw_distance, list_dot_product([a - list_avg(x) for a in x], [b - list_avg(y) for b in y]) / 64 / list_stddev_pop(x) / list_stddev_pop(y) AS correlation, list_distance(x, y) AS euclidean, list_cosine_similarity(x, y) AS cosine_similarity
  FROM dtw_square JOIN toref USING (id, rid)""", "dtw_distance correlation euclidean cosine_similarity")
def f23(spark, root):
    return V.pair_measures(to_reference(spark, root).filter("id <> rid"))


@query("f23_comparison_report", "toref", """WITH m AS (SELECT id, rid, list_dot_product([a - list_avg(x) for a in x], [b - list_avg(y) for b in y]) / 64 / list_stddev_pop(x) / list_stddev_pop(y) AS c FROM toref WHERE id <> rid)
  SELECT count(*) AS pairs, avg(c) AS mean_correlation, stddev_pop(c) AS std_correlation, min(c) AS min_correlation, max(c) AS max_correlation, CASE WHEN avg(c) > 0.8 THEN 'high overall similarity' WHEN avg(c) < 0.3 THEN 'low overall similarity' END AS insight, arg_max(id, c) AS best_id, arg_max(rid, c) AS best_rid FROM m""",
       "mean_correlation std_correlation min_correlation max_correlation")
def f23_report(spark, root):
    return V.comparison_report(V.pair_measures(to_reference(spark, root).filter("id <> rid")))


@query("f27_timeframe_features", nums="value")
def f27(spark, root):
    return V.timeframe_features(series(spark, root))


@query("f28_combined_timeframes", nums="value")
def f28(spark, root):
    return V.combined(V.timeframe_features(series(spark, root)))


@query("f28_frame_correlations", nums="correlation")
def f28_correlations(spark, root):
    return V.frame_correlations(series(spark, root))


@query("f29_timeframe_merge", "series", """WITH p AS (SELECT id, w, list_avg(v[65 - n:64]) AS p FROM series, (VALUES (16, 0.2), (32, 0.3), (64, 0.5)) t(n, w))
  SELECT id, sum(w * p) / sum(w) AS weighted, median(p) AS median, arg_max(p, (abs(p), w)) AS most_confident FROM p GROUP BY id""", "weighted median most_confident")
def f29(spark, root):
    """One prediction per timeframe: the mean of its newest points."""
    frames = F.array(*[F.struct(F.lit(p).alias("n"), F.lit(w).alias("weight")) for p, _, _, w in V.FRAMES.values()])
    d = series(spark, root).select("id", "v", F.explode(frames).alias("f"))
    mean = F.aggregate(F.slice("v", -F.col("f.n"), F.col("f.n")), F.lit(0.0), lambda a, x: a + x) / F.col("f.n")
    return V.merged_predictions(d.select("id", "f.weight", mean.alias("prediction")))


@query("d11_template_match", nums="similarity")
def d11(spark, root):
    return V.template_match(series(spark, root), library(spark, root), least=0.5)


def sub_distances(spark, root):
    """(id, start, rid, d): normalised warping distance of every sub-window to every reference pattern.

    Reference patterns are sub-windows of the label means at half-length steps; ``rid`` is label * 4096 + start.
    """
    parts = store(V.strided(series(spark, root), PART, STEP))
    refs = store(V.strided(library(spark, root), PART, STEP)).select(F.col("sid").alias("id"), "v")
    d = PR.cross_distances(parts.select(F.col("sid").alias("id"), "v"), refs)
    return store(parts.select("id", "sid", "start").join(d.select(F.col("a").alias("sid"), F.col("b").alias("rid"), F.col("normalized").alias("d")), "sid").drop("sid"))


_STARTS = "(VALUES (0), (8), (16), (24), (32), (40), (48))"
cte("sub_pairs", f"SELECT id || '-' || t.st AS id, rid * 4096 + u.st AS rid, s.id AS sid, t.st, v[t.st + 1:t.st + 16] AS x, y[u.st + 1:u.st + 16] AS y FROM series s, {_STARTS} t(st), label_means, {_STARTS} u(st)", "series label_means")
dtw_cte("sub_dtw", "SELECT * FROM sub_pairs", "sub_pairs", 16)
cte("sub_dist", "SELECT p.sid AS id, p.st AS start, p.rid, d.distance / 32 AS d FROM sub_pairs p JOIN sub_dtw d USING (id, rid)", "sub_dtw")
cte("sub_near", "SELECT id, start, arg_min(rid, (d, rid)) AS rid FROM sub_dist GROUP BY id, start", "sub_dist")


@query("d27_reference_features", "sub_dist", """WITH b AS (SELECT id, rid, min(d) AS d FROM sub_dist GROUP BY id, rid), l AS (SELECT id, list(d ORDER BY d) AS l, arg_min(rid, (d, rid)) AS nearest FROM b GROUP BY id)
  SELECT id, l[1] AS dtw_min_distance, list_avg(l) AS dtw_mean_distance, list_stddev_pop(l) AS dtw_std_distance, list_median(l) AS dtw_median_distance, nearest, l[1] AS dtw_top1_mean, list_avg(l[1:3]) AS dtw_top3_mean, list_avg(l[1:5]) AS dtw_top5_mean, l[1] / list_avg(l) AS distance_ratio FROM l""",
       "dtw_min_distance dtw_mean_distance dtw_std_distance dtw_median_distance dtw_top1_mean dtw_top3_mean dtw_top5_mean distance_ratio")
def d27(spark, root):
    return V.reference_features(sub_distances(spark, root))


@query("d27_sequence_features", "sub_near", """WITH m AS (SELECT *, rid <> lag(rid) OVER (PARTITION BY id ORDER BY start) AS moved FROM sub_near), c AS (SELECT id, rid, count(*) AS c FROM sub_near GROUP BY id, rid), t AS (SELECT id, arg_max(rid, (c, -rid)) AS dominant, max(c) AS c FROM c GROUP BY id)
  SELECT id, coalesce(sum(CAST(moved AS BIGINT)), 0)::BIGINT AS transitions, 1 - coalesce(sum(CAST(moved AS BIGINT)), 0) / greatest(count(*) - 1, 1) AS stability, any_value(dominant) AS dominant, any_value(c) / count(*) AS dominant_share, count(DISTINCT rid) / 70 AS diversity, regr_slope(rid, start / 64) AS trend_slope, regr_r2(rid, start / 64) AS trend_r2
  FROM m JOIN t USING (id) GROUP BY id""", "stability dominant_share diversity trend_slope trend_r2")
def d27_sequence(spark, root):
    return V.sequence_features(V.nearest_reference(sub_distances(spark, root)), 64, 70)


@query("d28_reference_sequence", "sub_near", "SELECT id, string_agg(CAST(rid AS VARCHAR), '-' ORDER BY start) AS sequence FROM sub_near GROUP BY id")
def d28(spark, root):
    n = V.nearest_reference(sub_distances(spark, root))
    s = F.array_sort(F.collect_list(F.struct("start", "rid")))
    return n.groupBy("id").agg(F.array_join(F.transform(s, lambda x: x.rid.cast("string")), "-").alias("sequence"))


_VOCAB = """WITH c AS (SELECT label, k, avg(v[k]) AS m FROM series, range(1, 65) t(k) GROUP BY ALL), m AS (SELECT label, list(m ORDER BY k) AS c FROM c GROUP BY label),
  w AS (SELECT label AS cluster, arg_min(id, (list_distance(v, c), id)) AS id, arg_min(v, (list_distance(v, c), id)) AS v FROM series JOIN m USING (label) GROUP BY label)"""


def words(spark, root):
    return V.vocabulary(series(spark, root).select(F.col("label").cast("long").alias("cluster"), "id", "v"))


@query("d25_vocabulary", "series", _VOCAB + " SELECT CAST(cluster AS BIGINT) AS cluster, id FROM w")
def d25(spark, root):
    return words(spark, root).select("cluster", "id")


@query("d25_vocabulary_match", "series", _VOCAB + """, r AS (SELECT s.id, CAST(cluster AS BIGINT) AS cluster, list_dot_product([a - list_avg(s.v) for a in s.v], [b - list_avg(w.v) for b in w.v]) / 64 / list_stddev_pop(s.v) / list_stddev_pop(w.v) AS r FROM series s, w)
  SELECT id, arg_max(cluster, (r, -cluster)) AS cluster, max(r) AS similarity FROM r WHERE r >= 0.4 GROUP BY id""", "similarity")
def d25_match(spark, root):
    return V.match_vocabulary(series(spark, root), words(spark, root), 0.4)

"""Kernel and pair-job queries (checked against direct NumPy in the tests)."""

import math

from pyspark.sql import functions as F

from tapeline.functions import kernels as K
from tapeline.functions.lineage import store
from tapeline.operators import cross as CX
from tapeline.operators import pairs as PR
from tapeline.operators import regimes as R
from tapeline.operators import wavelets as WV
from tapeline.plans.f_arrays import to_reference
from tapeline.plans.registry import cte, query
from tapeline.sources.tables import bars_d, bars_h, series

SCALES = [2.0, 4.0, 8.0, 16.0]


def library(spark, root):
    """One mean series per label: the bounded reference side."""
    rows = series(spark, root).select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("x"))
    arr = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return rows.groupBy(F.col("label").cast("long").alias("id")).agg(F.transform(arr, lambda r: r.x).alias("v"))


def dtw_cte(name: str, source: str, needs: str, n: int, ok: str = "TRUE", cost: str = "abs(x[i] - y[j])") -> None:
    """CTE (id, rid, distance, steps) of warping distances: the table is filled cell by cell, the last row of it is carried.

    Predecessors are tried up, left, diagonal, the first of the cheapest is taken, as the path does.
    """
    cte(name, f"""WITH RECURSIVE pair AS (SELECT id, rid, x, y FROM ({source})), cell AS (SELECT id, rid, x, y, 0 AS k, []::DOUBLE[] AS d, []::BIGINT[] AS s FROM pair UNION ALL
  SELECT id, rid, x, y, k + 1, list_append(d[greatest(1, len(d) - {n}):], c + CASE WHEN k = 0 THEN 0 ELSE coalesce(least(u, l, g), 'inf'::DOUBLE) END),
   list_append(s[greatest(1, len(s) - {n}):], 1 + CASE WHEN k = 0 THEN 0 WHEN u <= coalesce(l, 'inf'::DOUBLE) AND u <= coalesce(g, 'inf'::DOUBLE) THEN s[len(s) - {n - 1}] WHEN l <= coalesce(g, 'inf'::DOUBLE) THEN s[len(s)] ELSE s[len(s) - {n}] END)
  FROM (SELECT *, CASE WHEN {ok} THEN {cost} ELSE 'inf'::DOUBLE END AS c, CASE WHEN i > 1 THEN d[len(d) - {n - 1}] END AS u, CASE WHEN j > 1 THEN d[len(d)] END AS l, CASE WHEN i > 1 AND j > 1 THEN d[len(d) - {n}] END AS g
   FROM (SELECT *, k // {n} + 1 AS i, k % {n} + 1 AS j FROM cell WHERE k < {n * n})))
  SELECT id, rid, d[len(d)] AS distance, s[len(s)] AS steps FROM cell WHERE k = {n * n}""", needs)


dtw_cte("dtw_ref", "SELECT * FROM toref", "toref", 64)
dtw_cte("dtw_band", "SELECT * FROM toref", "toref", 64, "abs(i - j) <= 6")
cte("label_means", "SELECT CAST(label AS BIGINT) AS rid, list(m ORDER BY k) AS y FROM (SELECT label, k, avg(v[k]) AS m FROM series, range(1, 65) t(k) GROUP BY ALL) GROUP BY label", "series")
dtw_cte("dtw_lib", "SELECT id, rid, v AS x, y FROM series, label_means", "series label_means", 64)


def items(spark, root):
    return series(spark, root).select("id", "v")


def labelled(spark, root, name="label"):
    """Items with the labels of their id."""
    s = series(spark, root)
    return s.select("id", "v").join(s.select("id", F.col("label").alias(name)), "id")


@query("j04_distance_pairs", nums="distance normalized similarity")
def j04(spark, root):
    return PR.similarity(PR.distance_pairs(items(spark, root)))


@query("a28_pair_summary", nums="mean std min max")
def a28(spark, root):
    return PR.pair_summary(PR.distance_pairs(items(spark, root)))


@query("a28_item_means", nums="mean_distance")
def a28b(spark, root):
    return PR.item_means(PR.distance_pairs(items(spark, root)))


@query("s15_matrix_table", nums="distance")
def s15(spark, root):
    return PR.distance_pairs(labelled(spark, root), limit=6.0, carry=["label"]).select("a", "b", "label_a", "label_b", "distance")


@query("j05_nearest_references", "dtw_lib", "SELECT * FROM (SELECT id AS a, rid AS b, distance / 128 AS normalized, row_number() OVER (PARTITION BY id ORDER BY distance, rid) AS rank FROM dtw_lib) WHERE rank <= 3", "normalized")
def j05(spark, root):
    return PR.nearest(items(spark, root), library(spark, root), 3).select("a", "b", "normalized", "rank")


@query("j06_cross_similarity", "dtw_lib", "SELECT id AS a, rid AS b, distance / 128 AS normalized, 1 - distance / max(distance) OVER () AS similarity FROM dtw_lib", "normalized similarity")
def j06(spark, root):
    return PR.similarity(PR.cross_distances(items(spark, root), library(spark, root))).select("a", "b", "normalized", "similarity")


@query("j15_correlated_edges", "series", "SELECT x.id AS a, y.id AS b, list_sum([x.v[k] * y.v[k] for k in range(1, 65)]) / 64 AS corr FROM z x JOIN z y ON x.id < y.id WHERE list_sum([x.v[k] * y.v[k] for k in range(1, 65)]) / 64 > 0.4".replace(
    "FROM z x JOIN z y", "FROM (SELECT id, [(i - list_avg(v)) / list_stddev_pop(v) for i in v] AS v FROM series) x JOIN (SELECT id, [(i - list_avg(v)) / list_stddev_pop(v) for i in v] AS v FROM series) y").replace("list_sum([x.v[k] * y.v[k] for k in range(1, 65)])", "list_dot_product(x.v, y.v)"), "corr")
def j15(spark, root):
    return PR.correlated_edges(items(spark, root), 0.4)


@query("f18_dtw", "dtw_ref", "SELECT * FROM dtw_ref", "distance")
def f18(spark, root):
    return PR.alignments(to_reference(spark, root)).select("id", "rid", "distance", "steps")


@query("f19_dtw_band", "dtw_band", "SELECT * FROM dtw_band", "distance")
def f19(spark, root):
    return PR.alignments(to_reference(spark, root), "band", width=6).select("id", "rid", "distance", "steps")


@query("f20_fast_dtw", nums="distance")
def f20(spark, root):
    return PR.alignments(to_reference(spark, root), "fast").select("id", "rid", "distance", "steps")


@query("f21_warping_path")
def f21(spark, root):
    return PR.alignments(to_reference(spark, root)).select("id", "rid", F.posexplode("path").alias("step", "p")).select("id", "rid", "step", "p.i", "p.j")


@query("f13_spectra", "series", """WITH c AS (SELECT id, k, list_sum([v[j + 1] * cos(2 * pi() * k * j / 64) for j in range(64)]) AS re, list_sum([v[j + 1] * sin(2 * pi() * k * j / 64) for j in range(64)]) AS im FROM series, range(64) t(k)),
  p AS (SELECT id, k, re * re + im * im AS p, k / 64 AS f FROM c), g AS (SELECT id, arg_max(f, p) FILTER (k BETWEEN 1 AND 31) AS dominant_frequency, max(p) FILTER (k BETWEEN 1 AND 31) AS dominant_power, sum(p) AS total_power, stddev_pop(p) AS power_std,
   sum(sqrt(p) * f) FILTER (k < 32) / sum(sqrt(p)) FILTER (k < 32) AS centroid, sum(p) FILTER (k BETWEEN 16 AND 31) / sum(p) FILTER (k < 32) AS high_ratio FROM p GROUP BY id)
  SELECT g.*, b.bandwidth FROM g JOIN (SELECT p.id, sqrt(sum((f - centroid) ** 2 * sqrt(p)) / sum(sqrt(p))) AS bandwidth FROM p JOIN g USING (id) WHERE k < 32 GROUP BY p.id) b USING (id)""", "dominant_power total_power power_std centroid bandwidth high_ratio")
def f13(spark, root):
    return PR.spectra(series(spark, root))


_TAPS = ", ".join(f"({i}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, (lo, hi) in enumerate(zip(*(f.tolist() for f in K.filters(4)))))
# one level: position p of the output is the sum over the eight taps at 2p + 1 - i, the ends mirrored
_STEP = lambda src, n: f"SELECT id, p, sum(lo * x) AS a, sum(hi * x) AS d FROM (SELECT id, p, lo, hi, v[CASE WHEN q < 0 THEN -q WHEN q >= {n} THEN 2 * {n} - q ELSE q + 1 END] AS x FROM (SELECT id, v, p, lo, hi, 2 * p + 1 - i AS q FROM {src}, range({(n + 7) // 2}) t(p), taps)) GROUP BY id, p"
_PACK = "SELECT id, list(a ORDER BY p) AS v FROM"
cte("dwt", f"""WITH taps(i, lo, hi) AS (VALUES {_TAPS}), l1 AS MATERIALIZED ({_STEP("series", 64)}), s1 AS ({_PACK} l1 GROUP BY id), l2 AS MATERIALIZED ({_STEP("s1", 35)}), s2 AS ({_PACK} l2 GROUP BY id), l3 AS MATERIALIZED ({_STEP("s2", 21)})
  SELECT id, 0 AS level, CAST(p AS INT) AS pos, a AS coef FROM l3 UNION ALL SELECT id, 1, CAST(p AS INT), d FROM l3 UNION ALL SELECT id, 2, CAST(p AS INT), d FROM l2 UNION ALL SELECT id, 3, CAST(p AS INT), d FROM l1""", "series")


@query("f10_wavelet_levels", "dwt", "SELECT * FROM dwt", "coef")
def f10(spark, root):
    return PR.wavelet_levels(series(spark, root))


@query("f11_denoised", nums="value")
def f11(spark, root):
    return PR.denoised(series(spark, root)).select("id", F.posexplode("v").alias("pos", "value"))


@query("d32_energy_distribution", "dwt", """WITH e AS (SELECT id, level, sum(coef * coef) AS energy FROM dwt GROUP BY ALL), s AS (SELECT *, energy / sum(energy) OVER (PARTITION BY id) AS share FROM e)
  SELECT s.*, g.entropy, g.dominant FROM s JOIN (SELECT id, -sum(share * log2(share + 1e-10)) AS entropy, arg_max(level, energy) AS dominant FROM s GROUP BY id) g USING (id)""", "energy share entropy")
def d32(spark, root):
    return PR.energy_distribution(PR.wavelet_levels(series(spark, root)))


# direct convolution in SQL, zero outside the series
_CW = "SELECT z.symbol, z.seq, s AS scale, sum(u.z * exp(-(((u.seq - z.seq) / s) ** 2) / 2) * cos(5 * (u.seq - z.seq) / s)) / sqrt(s) AS coef FROM z, (VALUES (2.0::DOUBLE), (4.0), (8.0), (16.0)) v(s), z u WHERE u.symbol = z.symbol AND abs(u.seq - z.seq) <= 8 * s GROUP BY z.symbol, z.seq, s"
cte("cwt", f"WITH z AS MATERIALIZED (SELECT symbol, seq, (close - avg(close) OVER (PARTITION BY symbol)) / stddev_pop(close) OVER (PARTITION BY symbol) AS z FROM bars_h) {_CW}", "bars_h")


def cwt(spark, root):
    return WV.transform(bars_h(spark, root), SCALES)


@query("f06_cwt", "cwt", "SELECT * FROM cwt", "coef")
def f06(spark, root):
    return cwt(spark, root)


@query("f07_scale_summary", "cwt", "SELECT symbol, scale, sum(coef * coef) AS energy, max(abs(coef)) AS max, avg(abs(coef)) AS mean, stddev_pop(coef) AS std FROM cwt GROUP BY ALL", "energy max mean std")
def f07(spark, root):
    return WV.scale_summary(cwt(spark, root))


@query("f09_time_summary", "cwt", """SELECT symbol, seq, sum(coef * coef) AS energy, max(abs(coef)) AS max_magnitude, avg(abs(coef)) AS mean_magnitude, arg_max(scale, abs(coef)) AS dominant_scale, -sum(abs(coef) * ln(abs(coef) + 1e-10)) AS entropy, count(*) FILTER (abs(coef) > m) AS active_scales
  FROM (SELECT *, avg(abs(coef)) OVER (PARTITION BY symbol, seq) AS m FROM cwt) GROUP BY symbol, seq""", "energy max_magnitude mean_magnitude entropy")
def f09(spark, root):
    return WV.time_summary(cwt(spark, root))


@query("f08_ridge_points", "cwt", """WITH m AS (SELECT symbol, seq, scale, CAST(log2(scale) AS INT) AS s, abs(coef) / max(abs(coef)) OVER (PARTITION BY symbol) AS m FROM cwt), n AS (SELECT *, lag(m) OVER (PARTITION BY symbol, s ORDER BY seq) AS l, lead(m) OVER (PARTITION BY symbol, s ORDER BY seq) AS r,
   lag(m) OVER (PARTITION BY symbol, seq ORDER BY s) AS d, lead(m) OVER (PARTITION BY symbol, seq ORDER BY s) AS u FROM m) SELECT symbol, seq, scale, m AS magnitude FROM n WHERE m > 0.1 AND m > l AND m > r AND m > d AND m > u""", "magnitude")
def f08(spark, root):
    return WV.ridge_points(cwt(spark, root), SCALES)


@query("d24_coefficient_patterns", "cwt", """WITH z AS (SELECT symbol, max(seq) AS z FROM cwt GROUP BY symbol), n AS (SELECT s, CAST(least(greatest(floor(2 * s), 5), 50) AS BIGINT) AS n FROM (VALUES (2.0), (4.0), (8.0), (16.0)) v(s)), st AS (SELECT symbol, s, n, unnest(range(0, z + 2 - n, n // 2)) AS start FROM z, n)
  SELECT st.symbol, scale, start, n AS length, stddev_pop(coef) AS std, sum(coef * coef) AS energy FROM st JOIN cwt ON cwt.symbol = st.symbol AND scale = s AND seq >= start AND seq < start + n GROUP BY ALL HAVING stddev_pop(coef) > 0.01""", "std energy")
def d24(spark, root):
    return WV.coefficient_patterns(cwt(spark, root))


_GAUSS = ", ".join(f"({k}, {w!r}::DOUBLE)" for k, w in zip(range(-4, 5), CX.gauss().tolist()))
cte("crossed", f"""WITH p AS (SELECT a.seq, CAST(log2(a.scale) AS INT) - 1 AS s, a.coef AS x, b.coef AS y FROM cwt a JOIN cwt b ON a.seq = b.seq AND a.scale = b.scale AND a.symbol = 'click' AND b.symbol = 'purchase'), n AS (SELECT max(seq) + 1 AS n FROM p), g(k, w) AS (VALUES {_GAUSS}),
  q AS (SELECT p.seq, p.s, sum(gs.w * gt.w * abs(o.x * o.y)) AS xy, sum(gs.w * gt.w * o.x * o.x) AS xx, sum(gs.w * gt.w * o.y * o.y) AS yy FROM p, n, g gs, g gt, p o WHERE o.s = CASE WHEN (p.s + gs.k + 8) % 8 < 4 THEN (p.s + gs.k + 8) % 8 ELSE 7 - (p.s + gs.k + 8) % 8 END
   AND o.seq = CASE WHEN p.seq + gt.k < 0 THEN -1 - (p.seq + gt.k) WHEN p.seq + gt.k >= n THEN 2 * n - 1 - (p.seq + gt.k) ELSE p.seq + gt.k END GROUP BY p.seq, p.s)
  SELECT seq, 2.0 ** (s + 1) AS scale, x * y AS cross_power, (x * y) ** 2 AS power, xy / sqrt(xx * yy) AS coherence, CASE WHEN x * y < 0 THEN pi() ELSE 0 END AS phase FROM p JOIN q USING (seq, s)""", "cwt")


@query("f12_cross_wavelet", "crossed", "SELECT * FROM crossed", "cross_power power coherence phase")
def f12(spark, root):
    c = store(cwt(spark, root))
    one = lambda name: c.filter(F.col("symbol") == name).select(F.lit("click-purchase").alias("pair"), "seq", "scale", "coef")
    return CX.coherence(one("click"), one("purchase"), SCALES).drop("pair").withColumnRenamed("cross", "cross_power")


@query("m02_cluster_statistics", nums="intra_mean intra_max intra_std inter_mean silhouette separation")
def m02(spark, root):
    p = PR.distance_pairs(labelled(spark, root, "cluster"), carry=["cluster"])
    return R.cluster_statistics(p.withColumn("distance", F.col("normalized")))


@query("m03_density_clusters")
def m03(spark, root):
    s = store(items(spark, root))
    near = store(PR.distance_pairs(s, within=0.035).select("a", "b", F.col("normalized").alias("distance")))

    def nearest(some, core):
        fresh = [F.col(c).alias(c) for c in s.columns]  # both sides come from one table
        return PR.nearest(s.join(some, "id", "left_semi"), s.join(core, "id", "left_semi").select(fresh), 1).select("a", "b", F.col("normalized").alias("distance"))

    return R.density(near, s.select("id"), 0.035, 5, nearest)

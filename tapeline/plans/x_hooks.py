"""Hook, random-kernel, medoid and indexed-search queries."""

import numpy as np
from pyspark.sql import functions as F

from tapeline.operators import hooks as HK
from tapeline.operators import shapes as SH
from tapeline.operators import detection as DT
from tapeline.plans.k_kernels import items, library
from tapeline.plans.registry import cte, query
from tapeline.plans.w_indicators import g
from tapeline.sources.tables import bars_b, bars_h, series


@query("x02_rolling_apply", "bars_h", "SELECT symbol, seq, CASE WHEN count(close) OVER f = 20 THEN quantile_cont(close, 0.5) OVER f END AS rolling_median FROM bars_h WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "rolling_median")
def x02(spark, root):
    return HK.rolling_apply(bars_h(spark, root), "close", 20, lambda m: np.median(m, axis=1), "rolling_median")


@query("x01_feature_hook", "series", "SELECT id, list_max(v) - list_min(v) AS spread FROM series", "spread")
def x01(spark, root):
    import pandas as pd

    def spread(pdf):
        return pd.DataFrame({"id": pdf.id, "spread": [float(np.ptp(v)) for v in pdf.v]})

    return HK.apply_features(items(spark, root), spread, "id long, spread double")


_TAPS = ", ".join(f"({i}, {w.tolist()})" for i, w in enumerate(HK.kernel_bank()))


@query("f30_random_kernels", "series", f"""WITH taps(kernel, w) AS (VALUES {_TAPS}), at_ AS (SELECT id, kernel, w, v, unnest(range(1, len(v) - len(w) + 2)) AS p FROM series, taps)
  SELECT id, CAST(kernel AS INT) AS kernel, max(list_dot_product(v[p:p + len(w) - 1], w)) AS value FROM at_ GROUP BY id, kernel""", "value")
def f30(spark, root):
    return HK.random_kernels(series(spark, root)).select("id", F.posexplode("features").alias("kernel", "value"))


@query("d20_label_medoids", "series", """WITH p AS (SELECT a.label, a.id, sum(list_distance(a.v, b.v)) AS s, count(*) AS n, max(list_distance(a.v, b.v)) AS mx FROM series a JOIN series b ON a.label = b.label AND a.id <> b.id GROUP BY a.label, a.id)
  SELECT label, count(*) AS members, arg_min(id, s) AS medoid, sum(s) / sum(n) AS mean_distance, max(mx) AS max_distance FROM p GROUP BY label""", "mean_distance max_distance")
def d20(spark, root):
    return HK.label_medoids(series(spark, root))


cte("lib", "SELECT label AS id, list(m ORDER BY k) AS v FROM (SELECT label, k, avg(v[k]) AS m FROM series, range(1, 65) t(k) GROUP BY ALL) GROUP BY label", "series")


@query("d13_indexed_search", "lib", """WITH f AS (SELECT id, v, list_avg(v) AS m, list_stddev_pop(v) AS s, list_sum([v[k] * (k - 32.5) for k in range(1, 65)]) / 21840 AS t FROM series), h AS (SELECT id, v, list_avg(v) AS m, list_stddev_pop(v) AS s, list_sum([v[k] * (k - 32.5) for k in range(1, 65)]) / 21840 AS t FROM lib)
  SELECT a, b, similarity, rank FROM (SELECT f.id AS a, h.id AS b, 1 / (1 + list_distance(f.v, h.v)) AS similarity, row_number() OVER (PARTITION BY f.id ORDER BY 1 / (1 + list_distance(f.v, h.v)) DESC, h.id) AS rank FROM f JOIN h ON abs(f.m - h.m) + abs(f.s - h.s) + abs(f.t - h.t) < 2.0) WHERE rank <= 3""", "similarity")
def d13(spark, root):
    return HK.indexed_search(items(spark, root), library(spark, root), 3, 2.0).select("a", "b", "similarity", F.col("rank").cast("long").alias("rank"))


@query("d23_motif_features", "shapes", """SELECT symbol, length, sax, list_avg(shape) AS mean, list_stddev_pop(shape) AS std, list_min(shape) AS min, list_max(shape) AS max, list_sum([shape[k] * (k - (length + 1) / 2) for k in range(1, length + 1)]) / ((length ** 3 - length) / 12) AS slope, list_sum([x * x for x in shape]) AS energy FROM shapes""", "mean std min max slope energy")
def d23(spark, root):
    from tapeline.functions import arrays as A
    from tapeline.plans.d_detection import found_shapelets

    s = found_shapelets(spark, root)[1].select("symbol", "length", "sax", F.col("shape").alias("v"))
    s = A.hold(s, energy=A.total("v", lambda x: x * x))
    return SH.statistics(s).select("symbol", "length", "sax", "mean", "std", "min", "max", "slope", "energy")

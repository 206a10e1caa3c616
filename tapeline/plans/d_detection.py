"""Pattern detection and search queries."""

from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.operators import detection as DT
from tapeline.operators import formations as FM
from tapeline.operators import joins as J
from tapeline.operators import patterns as PT
from tapeline.operators import profiles as PR
from tapeline.operators import vectors as V
from tapeline.plans.derived_sql import window_sql
from tapeline.plans.k_kernels import dtw_cte, library
from tapeline.plans.registry import CTES, cte, query
from tapeline.plans.w_indicators import W, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import bars_b, bars_d, bars_h, series, table


@query("d01_window_patterns", "bars_h", window_sql("bars_h", 50, 25, 0.001), "strength price_change price_start price_end volatility price_range trend_strength")
def d01(spark, root):
    return PT.window_patterns(bars_h(spark, root))


_N = "(PARTITION BY symbol, side ORDER BY at_ RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
cte("flat_runs", """SELECT symbol, run, min(seq) AS s, max(seq) AS e, min(close) AS p FROM (SELECT *, sum(chg) OVER (PARTITION BY symbol ORDER BY seq) AS run FROM (
  SELECT symbol, seq, close, CASE WHEN close = lag(close) OVER (PARTITION BY symbol ORDER BY seq) THEN 0 ELSE 1 END AS chg FROM bars_b)) GROUP BY symbol, run""", "bars_b")
cte("turns", """SELECT symbol, side, (s + e) // 2 AS at_, side * p AS h FROM (SELECT *, lag(p) OVER w AS l, lead(p) OVER w AS r FROM flat_runs WINDOW w AS (PARTITION BY symbol ORDER BY run)), (VALUES (1), (-1)) t(side)
  WHERE side * p > side * l AND side * p > side * r""", "flat_runs")
# rounds: whoever leads its neighbourhood stays and removes the rest of it, until nobody is undecided
cte("rounds", f"""SELECT symbol, side, at_, h, 0 AS kept FROM turns UNION ALL SELECT symbol, side, at_, h, best AS kept FROM (SELECT *, max(best) OVER {_N} AS near FROM (
  SELECT symbol, side, at_, h, CASE WHEN max((h, at_)) OVER {_N} = (h, at_) THEN 1 ELSE 0 END AS best FROM rounds WHERE kept = 0)) WHERE best = 1 OR near = 0""", "turns")
cte("ex", """SELECT *, last_value(CASE WHEN pk THEN seq END IGNORE NULLS) OVER a AS lps, last_value(CASE WHEN pk THEN close END IGNORE NULLS) OVER a AS lpp, last_value(CASE WHEN vl THEN seq END IGNORE NULLS) OVER a AS lvs, last_value(CASE WHEN vl THEN close END IGNORE NULLS) OVER a AS lvp,
  first_value(CASE WHEN pk THEN seq END IGNORE NULLS) OVER b AS nps, first_value(CASE WHEN pk THEN close END IGNORE NULLS) OVER b AS npp, first_value(CASE WHEN vl THEN seq END IGNORE NULLS) OVER b AS nvs, first_value(CASE WHEN vl THEN close END IGNORE NULLS) OVER b AS nvp
  FROM (SELECT symbol, seq, close, coalesce(p.kept = 1, FALSE) AS pk, coalesce(v.kept = 1, FALSE) AS vl FROM bars_b b LEFT JOIN (SELECT symbol, at_ AS seq, kept FROM rounds WHERE kept = 1 AND side = 1) p USING (symbol, seq) LEFT JOIN (SELECT symbol, at_ AS seq, kept FROM rounds WHERE kept = 1 AND side = -1) v USING (symbol, seq))
  WINDOW a AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "rounds")


@query("f17_extrema", "ex", "SELECT symbol, seq, pk AS peak, vl AS valley FROM ex WHERE pk OR vl")
def f17(spark, root):
    return keep(FM.extrema(bars_b(spark, root)).filter("peak OR valley"), "peak", "valley")


@query("d02_head_shoulders", "ex", """SELECT symbol, ls AS "left", seq AS head, rs AS "right", 0.8 - abs(lp - rp) / lp * 2 AS confidence FROM (SELECT *, lag(seq) OVER w AS ls, lead(seq) OVER w AS rs, lag(close) OVER w AS lp, lead(close) OVER w AS rp FROM ex WHERE pk """ + W + """)
  WHERE lvs > ls AND nvs < rs AND close > lp AND close > rp AND abs(lp - rp) / lp < 0.05""", "confidence")
def d02(spark, root):
    return DT.head_shoulders(store(FM.extrema(bars_b(spark, root))))


@query("d03_double_top", "ex", """SELECT 'top' AS kind, symbol, lps AS start, seq AS middle, nps AS "end", 0.85 - abs(lpp - npp) / lpp * 5 AS confidence FROM ex WHERE vl AND abs(lpp - npp) / lpp < 0.03 UNION ALL
  SELECT 'bottom', symbol, lvs, seq, nvs, 0.85 - abs(lvp - nvp) / lvp * 5 FROM ex WHERE pk AND abs(lvp - nvp) / lvp < 0.03""", "confidence")
def d03(spark, root):
    ex = store(FM.extrema(bars_b(spark, root)))
    t, b = DT.double_tops(ex), DT.double_tops(ex, bottom=True)
    return t.select(F.lit("top").alias("kind"), "*").unionByName(b.select(F.lit("bottom").alias("kind"), "*"))


# a calm series (20-bar means of the brand bars) so that flags occur
cte("calm", "SELECT symbol, ts, seq - 19 AS seq, m AS close FROM (SELECT *, avg(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM bars_b) WHERE seq >= 19", "bars_b")


def calm(spark, root, bars=bars_b):
    from tapeline.functions.frames import rmean, rolled

    b = rolled(bars(spark, root), lambda h, w: h.withColumn("_m", rmean(F.col("close"), 20, w)), 20).filter("seq >= 19")
    return b.select("symbol", "ts", (F.col("seq") - 19).alias("seq"), F.col("_m").alias("close"))


_FLAG = """SELECT symbol, seq - 20 AS start, seq + len - 1 AS "end", 0.7 + least(abs(pole), 0.2) AS confidence, pole, n FROM (SELECT symbol, seq, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS pole, stddev_pop(close) OVER f / avg(close) OVER f AS cv, regr_slope(close, seq) OVER f AS sl, count(*) OVER f AS len,
  count(*) OVER (PARTITION BY symbol) AS n FROM calm WINDOW w AS (PARTITION BY symbol ORDER BY seq), f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) WHERE seq < n - 20 AND len >= 10 AND cv < 0.03 AND pole > 0.1 AND sl < 0"""


@query("d04_triangles", nums="confidence")
def d04(spark, root):
    return FM.sliding_formations(bars_b(spark, root)).filter(F.col("kind").endswith("triangle"))


@query("d06_wedges", nums="confidence")
def d06(spark, root):
    return FM.sliding_formations(bars_b(spark, root)).filter(F.col("kind").endswith("wedge"))


@query("d05_flags", "calm", f'SELECT symbol, start, "end", confidence, pole FROM ({_FLAG})', "confidence pole")
def d05(spark, root):
    return DT.flags(calm(spark, root))


@query("d07_adjusted_strength", "calm", f"""SELECT symbol, start, "end", least(1.0, CASE WHEN r > 0.05 AND r < 0.3 THEN confidence * 1.1 WHEN r < 0.02 OR r > 0.5 THEN confidence * 0.8 ELSE confidence END) AS strength FROM (SELECT *, ("end" - start) / n AS r FROM ({_FLAG}))""", "strength")
def d07(spark, root):
    c = calm(spark, root)
    n = c.groupBy("symbol").agg(DT.one().alias("_n"))
    return DT.adjusted_strength(DT.flags(c), n, F.lit(1.0)).select("symbol", "start", "end", "strength")


@query("d09_library_statistics", "patterns", "SELECT symbol AS category, count(*) AS n, count(DISTINCT type) AS types, avg(strength) AS mean_threshold FROM patterns GROUP BY symbol", "mean_threshold")
def d09(spark, root):
    return D.patterns(spark, root).groupBy(F.col("symbol").alias("category")).agg(DT.one().alias("n"), F.countDistinct("type").alias("types"), F.avg("strength").alias("mean_threshold"))


_NEAR = lambda pos, spots: f"CASE WHEN len({spots}) > 0 THEN v[list_min([{{'d': abs(i - 1 - {pos}), 'i': i}} for i in {spots}]).i] ELSE v[{pos} + 1] END"
_AT = lambda p: f"CAST(floor({p} * 49) AS INT)"
_DIFF = lambda a, b, f, tol: f"1 - least(1.0, abs({a} - {b}) / {f}({a}, {b}) / {tol})"
_KINDS = f"""WITH w AS (SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS v FROM bars_h QUALIFY len(v) = 50),
  t AS (SELECT symbol, seq, v, [i for i in range(2, 50) if v[i] > v[i - 1] AND v[i] > v[i + 1]] AS pk, [i for i in range(2, 50) if v[i] < v[i - 1] AND v[i] < v[i + 1]] AS vl FROM w),
  k AS (SELECT *, {_NEAR(_AT(0.2), "pk")} AS ls, {_NEAR(_AT(0.5), "pk")} AS hd, {_NEAR(_AT(0.8), "pk")} AS rs, [v[{_AT(0.25)} + 1], v[{_AT(0.5)} + 1], v[{_AT(0.75)} + 1]] AS res, {_NEAR(_AT(0.25), "vl")} AS b1, {_NEAR(_AT(0.75), "vl")} AS b2 FROM t),
  s AS (SELECT *, ((CASE WHEN hd > ls AND hd > rs THEN least(1.0, least(hd / ls, hd / rs) - 1) ELSE 0 END) + ({_DIFF("ls", "rs", "greatest", 0.1)}) + 1.0) / 4 AS c1, (1 - least(1.0, list_stddev_pop(res) / list_avg(res) / 0.02) + 1.5) / 4 AS c2, (({_DIFF("b1", "b2", "least", 0.02)}) + 1.5) / 4 AS c4 FROM k),
  best AS (SELECT *, list_max([x for x in [{{'c': c1, 'n': 'Head and Shoulders'}}, {{'c': c2, 'n': 'Ascending Triangle'}}, {{'c': c4, 'n': 'Double Bottom'}}] if x.c >= 0.7 - 1e-12]) AS b FROM s),
  m AS (SELECT *, len(pk) AS np, len(vl) AS nv, list_avg(v) AS mu, list_stddev_pop(v) AS sd, v[1:25] AS h1, v[26:50] AS h2 FROM best),
  r AS (SELECT *, [h1[CAST(floor(k * 24 / 99) AS INT) + 1] + (coalesce(h1[CAST(floor(k * 24 / 99) AS INT) + 2], 0) - h1[CAST(floor(k * 24 / 99) AS INT) + 1]) * (k * 24 / 99 - floor(k * 24 / 99)) for k in range(100)] AS a,
    [h2[CAST(floor(k * 24 / 99) AS INT) + 1] + (coalesce(h2[CAST(floor(k * 24 / 99) AS INT) + 2], 0) - h2[CAST(floor(k * 24 / 99) AS INT) + 1]) * (k * 24 / 99 - floor(k * 24 / 99)) for k in range(100)] AS z FROM m),
  g AS (SELECT *, list_dot_product([x - list_avg(a) for x in a], [x - list_avg(z) for x in z]) / 100 / list_stddev_pop(a) / list_stddev_pop(z) AS corr, CAST(np >= 3 AND nv >= 3 AS INT) + CAST(abs(list_avg([((x - mu) / sd) ** 3 for x in v])) > 1.5 AS INT) + CAST(list_avg([((x - mu) / sd) ** 4 for x in v]) - 3 > 3 AS INT) + CAST(np / (nv + 1) < 0.5 OR np / (nv + 1) > 2 AS INT) AS odd FROM r)
  SELECT symbol, seq, coalesce(b.n, CASE WHEN abs(corr) > 0.7 THEN 'Fractal Pattern' WHEN odd >= 2 THEN 'Shapelet' END) AS name, CASE WHEN b.n IS NOT NULL THEN 'traditional' WHEN abs(corr) > 0.7 THEN 'fractal' WHEN odd >= 2 THEN 'shapelet' END AS category, coalesce(b.c, CASE WHEN abs(corr) > 0.7 THEN 0.8 WHEN odd >= 2 THEN 0.75 END) AS confidence FROM g WHERE name IS NOT NULL"""


def classified_windows(spark, root):
    return DT.windows(bars_h(spark, root), 50)


@query("d08_rule_classifier", "bars_h", _KINDS, "confidence")
def d08(spark, root):
    return FM.classify(classified_windows(spark, root), FM.definitions(spark))


#: a user's definition: two similar lows near the ends, nothing else asked
CUSTOM = {"Wide Bottom": ("custom", [(0.1, "first_bottom"), (0.9, "second_bottom")], [("bottoms_similar", 0.5)])}


@query("x05_custom_definition", "bars_h", f"""WITH w AS (SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS v FROM bars_h QUALIFY len(v) = 50),
  t AS (SELECT symbol, seq, v, [i for i in range(2, 50) if v[i] < v[i - 1] AND v[i] < v[i + 1]] AS vl FROM w), k AS (SELECT *, {_NEAR(_AT(0.1), "vl")} AS b1, {_NEAR(_AT(0.9), "vl")} AS b2 FROM t)
  SELECT symbol, seq, 'Wide Bottom' AS name, {_DIFF("b1", "b2", "least", 0.5)} AS confidence FROM k WHERE {_DIFF("b1", "b2", "least", 0.5)} >= 0.7""", "confidence")
def x05(spark, root):
    library = FM.definitions(spark, CUSTOM)
    return FM.classify(classified_windows(spark, root), library.filter("category = 'custom'")).filter("category = 'custom'").select("symbol", "seq", "name", "confidence")


# all 16-point parts of the label means, at every start
cte("parts", "SELECT rid * 4096 + st AS pid, y[st + 1:st + 16] AS v FROM label_means, range(49) t(st)", "label_means")
cte("parts_z", "SELECT pid, [(x - list_avg(v)) / list_stddev_pop(v) for x in v] AS z FROM parts", "parts")
cte("near_parts", """WITH w AS (SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM bars_h), wz AS (SELECT symbol, seq, [(x - list_avg(v)) / list_stddev_pop(v) for x in v] AS z FROM w WHERE len(v) = 16),
  s AS (SELECT symbol, seq, pid, wz.z AS x, p.z AS y, list_dot_product(wz.z, p.z) / 16 AS c FROM wz, parts_z p), r AS (SELECT *, 0.6 * c + 0.2 / (1 + sqrt(greatest(32 * (1 - c), 0))) AS part FROM s)
  SELECT *, symbol || '-' || seq AS id, pid AS rid FROM r WHERE part >= 0.3""", "bars_h parts_z")
dtw_cte("dtw_parts", "SELECT * FROM near_parts", "near_parts", 16)


@query("d10_subsequence_search", "dtw_parts", """SELECT symbol, seq, pid, part + 0.2 / (1 + distance) AS score FROM near_parts JOIN dtw_parts USING (id, rid) WHERE part + 0.2 / (1 + distance) >= 0.5 ORDER BY score DESC, symbol, seq, pid LIMIT 200""", "score")
def d10(spark, root):
    return DT.search(bars_h(spark, root), DT.z(shapes(spark, root).select(F.col("id").alias("pid"), "v")).select("pid", "z"), 16, 0.5, 200)


cte("outcomes", "SELECT p.type, p.symbol || '-' || p.seq AS id, (b.close - a.close) / a.close AS x, p.strength AS weight FROM patterns p JOIN bars_d a ON a.symbol = p.symbol AND a.seq = p.end_seq JOIN bars_d b ON b.symbol = p.symbol AND b.seq = p.end_seq + 5", "patterns")


@query("d12_weighted_forecast", "outcomes", """WITH c AS (SELECT type, x, sum(weight) OVER (PARTITION BY type ORDER BY x, id) / sum(weight) OVER (PARTITION BY type) AS q, weight FROM outcomes)
  SELECT type, sum(weight * x) / sum(weight) AS mean_forecast, min(x) FILTER (q >= (1 - 0.68) / 2) AS lower_68, min(x) FILTER (q >= (1 + 0.68) / 2) AS upper_68, min(x) FILTER (q >= (1 - 0.95) / 2) AS lower_95, min(x) FILTER (q >= (1 + 0.95) / 2) AS upper_95 FROM c GROUP BY type""",
       "mean_forecast lower_68 upper_68 lower_95 upper_95")
def d12(spark, root):
    p = D.patterns(spark, root).select("type", "symbol", "seq", "end_seq", "strength")
    o = J.forward_outcome(p, bars_d(spark, root), "end_seq", 5, clip=False)
    o = o.select("type", F.concat_ws("-", "symbol", F.col("seq").cast("string")).alias("id"), F.col("outcome").alias("x"), F.col("strength").alias("weight"))
    return DT.weighted_forecast(o, ["type"])


#: lengths of shapelets
SIZES = (16, 24, 32, 48)
cte("cand", " UNION ALL ".join(f"""SELECT symbol, seq, {n} AS length, v, ret, array_to_string([CASE WHEN p <= -0.67 THEN 'a' WHEN p <= 0 THEN 'b' WHEN p <= 0.67 THEN 'c' ELSE 'd' END for p in [list_avg(z[k * {n // 4} + 1:k * {n // 4} + {n // 4}]) for k in range(4)]], '') AS sax FROM (
  SELECT *, [(x - list_avg(v)) / list_stddev_pop(v) for x in v] AS z FROM (SELECT symbol, seq, [(x - mu) / sd for x in raw] AS v, (b - a) / a AS ret FROM (SELECT symbol, seq, list(close) OVER f AS raw, lead(close, {n}) OVER w AS a, lead(close, {n + 5}) OVER w AS b, avg(close) OVER (PARTITION BY symbol) AS mu,
   stddev_pop(close) OVER (PARTITION BY symbol) AS sd FROM bars_b WINDOW w AS (PARTITION BY symbol ORDER BY seq), f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE len(raw) = {n}))""" for n in SIZES), "bars_b")
cte("shapes", """WITH m AS (SELECT symbol, length, sax, list(m ORDER BY k) AS c FROM (SELECT symbol, length, sax, k, avg(x) AS m, count(*) AS n FROM (SELECT symbol, length, sax, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM cand) GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL)
  SELECT symbol, length, sax, count(*) AS frequency, arg_min(seq, (list_distance(v, c), seq)) AS start, arg_min(v, (list_distance(v, c), seq)) AS shape, coalesce(avg(ret), 0) AS avg_return, coalesce(stddev_pop(ret), 0) AS std_return, coalesce(avg(CAST(ret > 0 AS DOUBLE)), 0.5) AS win_rate FROM cand JOIN m USING (symbol, length, sax) GROUP BY symbol, length, sax""", "cand")


def found_shapelets(spark, root):
    return DT.shapelets(store(bars_b(spark, root)), SIZES)


@query("d14_sax_shapelets", "shapes", "SELECT symbol, length, sax, frequency, start, avg_return, std_return, win_rate FROM shapes", "avg_return std_return win_rate")
def d14(spark, root):
    return found_shapelets(spark, root)[1].drop("shape")


@query("d15_shapelet_matches", "shapes", """SELECT symbol, seq, length, sax, shapelet, similarity FROM (SELECT symbol, seq, length, sax, shapelet, (corr(x, y) + 1) / 2 AS similarity FROM (SELECT c.symbol, c.seq, length, sax, s.start AS shapelet, unnest(c.v) AS x, unnest(s.shape) AS y FROM cand c JOIN shapes s USING (symbol, length, sax)) GROUP BY ALL) WHERE similarity >= 0.9""", "similarity")
def d15(spark, root):
    return DT.match_shapelets(*found_shapelets(spark, root))


@query("a29_shapelet_summary", "shapes", "SELECT length, sax, count(*) AS shapelets, CAST(sum(frequency) AS BIGINT) AS occurrences FROM shapes GROUP BY length, sax ORDER BY occurrences DESC, length, sax LIMIT 10")
def a29(spark, root):
    s = found_shapelets(spark, root)[1]
    return s.groupBy("length", "sax").agg(DT.one().alias("shapelets"), F.sum("frequency").alias("occurrences")).orderBy(F.col("occurrences").desc(), "length", "sax").limit(10)


def shapes(spark, root):
    """All 16-point parts of the label means, at every start."""
    return V.strided(library(spark, root), 16, 1).select(F.col("sid").alias("id"), "v")


@query("d17_shapelet_transform", "series parts_z", """WITH w AS (SELECT id, p, v[p + 1:p + 16] AS w FROM series, range(49) t(p)), z AS (SELECT id, p, [(x - list_avg(w)) / list_stddev_pop(w) for x in w] AS z FROM w)
  SELECT id, pid AS shapelet, min(list_distance(z.z, s.z)) AS distance, CAST(arg_min(p, list_distance(z.z, s.z)) AS INT) AS pos FROM z, parts_z s GROUP BY id, pid""", "distance")
def d17(spark, root):
    return DT.closest_positions(series(spark, root), shapes(spark, root))


_H = lambda k, n: f"CASE WHEN {k} > 0 AND {k} < {n} THEN -({k} / {n} * log2({k} / {n}) + (1 - {k} / {n}) * log2(1 - {k} / {n})) ELSE 0 END"


@query("d16_information_gain", "series parts_z", f"""WITH w AS (SELECT id, p, v[p + 1:p + 16] AS w FROM series, range(49) t(p)), z AS (SELECT id, [(x - list_avg(w)) / list_stddev_pop(w) for x in w] AS z FROM w),
  d AS (SELECT id, pid, min(list_distance(z.z, s.z)) AS d FROM z, parts_z s GROUP BY id, pid), o AS (SELECT pid, id, d, CAST(label = pid // 4096 AS INT) AS own FROM d JOIN (SELECT id, label FROM series) USING (id)),
  c AS (SELECT pid, d, lead(d) OVER r AS nx, row_number() OVER r AS i, sum(own) OVER (PARTITION BY pid ORDER BY d, id ROWS UNBOUNDED PRECEDING) AS k, sum(own) OVER (PARTITION BY pid) AS t, count(*) OVER (PARTITION BY pid) AS n FROM o WINDOW r AS (PARTITION BY pid ORDER BY d, id)),
  g AS (SELECT *, {_H("t", "n")} - i / n * ({_H("k", "i")}) - (n - i) / n * ({_H("(t - k)", "(n - i)")}) AS gain FROM c WHERE nx > d)
  SELECT pid AS shapelet, max(gain) AS gain, arg_max((d + nx) / 2, (gain, -i)) AS threshold FROM g GROUP BY pid""", "gain threshold")
def d16(spark, root):
    s = series(spark, root)
    return DT.information_gain(store(DT.closest_positions(s, shapes(spark, root))), s.select("id", "label"), F.floor(F.col("shapelet") / 4096))


cte("profile", """WITH w AS (SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM bars_h), z AS MATERIALIZED (SELECT symbol, seq, [(x - list_avg(v)) / list_stddev_pop(v) for x in v] AS z FROM w WHERE len(v) = 16)
  SELECT a.symbol, a.seq, sqrt(greatest(32 - 2 * max(list_dot_product(a.z, b.z)), 0)) AS distance, arg_max(b.seq, list_dot_product(a.z, b.z)) AS nn FROM z a JOIN z b ON a.symbol = b.symbol AND abs(a.seq - b.seq) > 4 GROUP BY a.symbol, a.seq""", "bars_h")


@query("d18_matrix_profile", "profile", "SELECT * FROM profile", "distance")
def d18(spark, root):
    return DT.matrix_profile(bars_h(spark, root), 16)


@query("d19_discords", "profile", "SELECT symbol, seq, distance, score, rank FROM (SELECT symbol, seq, distance, distance / avg(distance) OVER (PARTITION BY symbol) AS score, row_number() OVER (PARTITION BY symbol ORDER BY distance DESC, seq) AS rank FROM profile) WHERE rank <= 3", "distance score")
def d19(spark, root):
    return DT.discords(DT.matrix_profile(bars_h(spark, root), 16)).withColumn("rank", F.col("rank").cast("long"))


@query("d21_arc_curve", "profile", """WITH e AS (SELECT symbol, s AS seq, sum(x) AS x FROM (SELECT symbol, least(seq, nn) AS s, 1 AS x FROM profile UNION ALL SELECT symbol, greatest(seq, nn), -1 FROM profile) GROUP BY ALL), c AS (SELECT p.symbol, p.seq, CAST(sum(coalesce(x, 0)) OVER (PARTITION BY p.symbol ORDER BY p.seq) AS BIGINT) AS arcs, max(p.seq) OVER (PARTITION BY p.symbol) + 1 AS n
   FROM profile p LEFT JOIN e USING (symbol, seq)) SELECT symbol, seq, arcs, CASE WHEN seq < 16 OR seq >= n - 16 THEN 1.0 ELSE least(1.0, arcs / nullif(2 * seq * (n - seq) / n, 0)) END AS curve FROM c""", "curve")
def d21(spark, root):
    return DT.arc_curve(DT.matrix_profile(bars_h(spark, root), 16), 16)


def sides_sql(bars):
    """Nearest earlier and later windows of each window of 16 closes."""
    return f"""WITH w AS (SELECT symbol, seq, list(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS v FROM {bars}), z AS MATERIALIZED (SELECT symbol, seq, v, [(x - list_avg(v)) / list_stddev_pop(v) for x in v] AS z FROM w WHERE len(v) = 16)
  SELECT a.symbol, a.seq, any_value(a.v) AS v, any_value(a.z) AS z, sqrt(greatest(32 - 2 * max(list_dot_product(a.z, b.z)), 0)) AS distance, arg_max(b.seq, list_dot_product(a.z, b.z)) FILTER (b.seq < a.seq) AS l, arg_max(b.seq, list_dot_product(a.z, b.z)) FILTER (b.seq > a.seq) AS r
  FROM z a JOIN z b ON a.symbol = b.symbol AND abs(a.seq - b.seq) > 4 GROUP BY a.symbol, a.seq"""


cte("sides", sides_sql("bars_h"), "bars_h")
# 20-hour means, whose windows come back within two deviations
cte("calm_h", CTES["calm"][len("calm AS ("):-1].replace("bars_b", "bars_h"), "bars_h")
cte("calm_sides", sides_sql("calm_h"), "calm_h")
cte("links", "SELECT a.symbol, a.seq AS before, b.seq, list_distance(a.v, b.v) AS d FROM sides a JOIN sides b ON a.symbol = b.symbol AND a.r = b.seq AND b.l = a.seq", "sides")
cte("chain_members", """SELECT symbol, before AS start, 0 AS pos, before AS seq, CAST(NULL AS DOUBLE) AS d FROM links a WHERE NOT EXISTS (SELECT 1 FROM links b WHERE b.symbol = a.symbol AND b.seq = a.before)
  UNION ALL SELECT c.symbol, c.start, c.pos + 1, l.seq, l.d FROM chain_members c JOIN links l ON l.symbol = c.symbol AND l.before = c.seq""", "links")


@query("d19_chains", "chain_members", """WITH c AS (SELECT symbol, start, max(seq) AS stop, count(*) AS length, avg(d) AS mean_transition, stddev_pop(d) AS std_transition FROM chain_members GROUP BY symbol, start)
  SELECT c.*, list_distance(a.v, b.v) AS total_evolution, row_number() OVER (PARTITION BY c.symbol ORDER BY length DESC, start) = 1 AS unanchored FROM c JOIN sides a ON a.symbol = c.symbol AND a.seq = start JOIN sides b ON b.symbol = c.symbol AND b.seq = stop""", "mean_transition std_transition total_evolution")
def d19_chains(spark, root):
    bars = store(bars_h(spark, root))
    return PR.chains(bars, store(PR.sided_profile(bars, 16)), 16)


@query("d19_chain_members", "chain_members", "SELECT symbol, start, CAST(pos AS BIGINT) AS pos, seq FROM chain_members")
def d19_chain_members(spark, root):
    return PR.chain_members(store(PR.sided_profile(store(bars_h(spark, root)), 16)))


# a round: the best free window, its nearest windows apart from each other, and the rows around them are taken
cte("motif_rounds", """SELECT symbol, -1 AS motif, CAST(NULL AS BIGINT) AS primary_, CAST([] AS STRUCT(d DOUBLE, s BIGINT)[]) AS hits, CAST([] AS BIGINT[]) AS taken, 2 * stddev_pop(distance) AS lim FROM calm_sides GROUP BY symbol
  UNION ALL SELECT symbol, motif, primary_, hits, list_concat(taken, [h.s for h in hits]), lim FROM (
    SELECT symbol, motif, primary_, taken, lim, list_reduce(list_prepend(CAST([] AS STRUCT(d DOUBLE, s BIGINT)[]), [[h] for h in list_sort(near)]), lambda a, b: CASE WHEN len(a) < 10 AND len([x for x in a if abs(x.s - b[1].s) <= 4]) = 0 THEN list_concat(a, b) ELSE a END) AS hits FROM (
     SELECT c.symbol, c.motif, c.primary_, c.taken, c.lim, list({'d': CASE WHEN w.seq = p.seq THEN 0 ELSE sqrt(greatest(32 - 2 * list_dot_product(p.z, w.z), 0)) END, 's': w.seq}) FILTER (w.seq = p.seq OR sqrt(greatest(32 - 2 * list_dot_product(p.z, w.z), 0)) <= c.lim) AS near FROM (
      SELECT r.symbol, r.motif + 1 AS motif, arg_min(s.seq, (s.distance, s.seq)) AS primary_, min(s.distance) AS best, any_value(r.taken) AS taken, any_value(r.lim) AS lim FROM motif_rounds r JOIN calm_sides s ON s.symbol = r.symbol WHERE r.motif < 9 AND len([x for x in r.taken if abs(x - s.seq) <= 4]) = 0 GROUP BY r.symbol, r.motif) c
      JOIN calm_sides p ON p.symbol = c.symbol AND p.seq = c.primary_ JOIN calm_sides w ON w.symbol = c.symbol WHERE c.best <= least(c.lim, 10) GROUP BY ALL))""", "calm_sides")


@query("d19_motif_occurrences", "motif_rounds", """SELECT m.symbol, motif, primary_ AS "primary", CAST(k - 1 AS INT) AS rank, hits[k].s AS seq, hits[k].d AS distance, list_distance(p.v, w.v) AS raw FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM motif_rounds WHERE motif >= 0) m
  JOIN calm_sides p ON p.symbol = m.symbol AND p.seq = primary_ JOIN calm_sides w ON w.symbol = m.symbol AND w.seq = hits[k].s""", "distance raw")
def d19_motif_occurrences(spark, root):
    bars = store(calm(spark, root, bars_h))
    return PR.motifs(bars, store(PR.sided_profile(bars, 16)), 16)


@query("d19_motifs", "motif_rounds", """SELECT m.symbol, motif, primary_ AS "primary", count(*) AS occurrences, coalesce(avg(list_distance(p.v, w.v)) FILTER (k > 1), 0) AS mean_distance, coalesce(stddev_pop(list_distance(p.v, w.v)) FILTER (k > 1), 0) AS std_distance FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM motif_rounds WHERE motif >= 0) m
  JOIN calm_sides p ON p.symbol = m.symbol AND p.seq = primary_ JOIN calm_sides w ON w.symbol = m.symbol AND w.seq = hits[k].s GROUP BY ALL""", "mean_distance std_distance")
def d19_motifs(spark, root):
    bars = store(calm(spark, root, bars_h))
    return PR.motif_summary(PR.motifs(bars, store(PR.sided_profile(bars, 16)), 16))


_Z = lambda c: f"[(x - list_avg({c})) / list_stddev_pop({c}) for x in {c}] AS {c}"
cte("multi", f"""WITH w AS (SELECT symbol, seq, list(close) OVER f AS close, list(high) OVER f AS high, list(low) OVER f AS low FROM bars_h WINDOW f AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)), z AS MATERIALIZED (SELECT symbol, seq, {_Z("close")}, {_Z("high")}, {_Z("low")} FROM w WHERE len(close) = 16),
  p AS (SELECT a.symbol, a.seq, b.seq AS nn, list_sort([{{'d': sqrt(greatest(32 - 2 * list_dot_product(a.close, b.close), 0)), 'i': 0, 'c': 'close'}}, {{'d': sqrt(greatest(32 - 2 * list_dot_product(a.high, b.high), 0)), 'i': 1, 'c': 'high'}}, {{'d': sqrt(greatest(32 - 2 * list_dot_product(a.low, b.low), 0)), 'i': 2, 'c': 'low'}}]) AS s
   FROM z a JOIN z b ON a.symbol = b.symbol AND abs(a.seq - b.seq) > 4),
  b AS (SELECT symbol, seq, k, min(list_avg([x.d for x in s[1:k]])) AS distance, arg_min(nn, list_avg([x.d for x in s[1:k]])) AS nn, arg_min([x for x in s[1:k]], list_avg([x.d for x in s[1:k]])) AS best FROM p, (VALUES (1), (2), (3)) t(k) GROUP BY ALL)
  SELECT symbol, seq, k, distance, nn, array_to_string([x[2] for x in list_sort([[CAST(y.i AS VARCHAR), y.c] for y in best])], ',') AS dims FROM b""", "bars_h")


@query("d22_multi_profile", "multi", "SELECT * FROM multi", "distance")
def d22_multi_profile(spark, root):
    return PR.multi_profile(store(bars_h(spark, root)), 16, ["close", "high", "low"])


@query("d22_multi_motifs", "multi", "SELECT symbol, k, seq, nn, distance, dims FROM multi QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY distance, seq) = 1", "distance")
def d22_multi_motifs(spark, root):
    p = PR.multi_profile(store(bars_h(spark, root)), 16, ["close", "high", "low"])
    best = p.groupBy("symbol", "k").agg(F.min(F.struct("distance", "seq", "nn", "dims")).alias("m"))
    return best.select("symbol", "k", "m.seq", "m.nn", "m.distance", "m.dims")


_ARC = """WITH e AS (SELECT symbol, s AS seq, sum(x) AS x FROM (SELECT symbol, least(seq, nn) AS s, 1 AS x FROM profile UNION ALL SELECT symbol, greatest(seq, nn), -1 FROM profile) GROUP BY ALL), c AS (SELECT p.symbol, p.seq, CAST(sum(coalesce(x, 0)) OVER (PARTITION BY p.symbol ORDER BY p.seq) AS BIGINT) AS arcs, max(p.seq) OVER (PARTITION BY p.symbol) + 1 AS n
   FROM profile p LEFT JOIN e USING (symbol, seq)) SELECT symbol, seq, CASE WHEN seq < 16 OR seq >= n - 16 THEN 1.0 ELSE least(1.0, arcs / nullif(2 * seq * (n - seq) / n, 0)) END AS curve FROM c"""
cte("borders", f"""SELECT symbol, list_reduce(list_prepend(CAST([] AS STRUCT(c DOUBLE, s BIGINT)[]), [[h] for h in list_sort(spots)]), lambda a, b: CASE WHEN len(a) < 4 AND len([x for x in a if abs(x.s - b[1].s) <= 40]) = 0 THEN list_concat(a, b) ELSE a END) AS hits
  FROM (SELECT symbol, list({{'c': curve, 's': seq}}) AS spots FROM ({_ARC}) WHERE curve < 1 GROUP BY symbol)""", "profile")


@query("d21_borders", "borders", "SELECT symbol, CAST(k - 1 AS INT) AS rank, hits[k].s AS seq, hits[k].c AS curve FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM borders)", "curve")
def d21_borders(spark, root):
    return PR.borders(DT.arc_curve(store(DT.matrix_profile(store(bars_h(spark, root)), 16)), 16), 16)


@query("d21_regimes", "borders", "SELECT p.symbol, p.seq, CAST(len([h for h in hits if h.s <= p.seq]) AS BIGINT) AS regime FROM profile p JOIN borders USING (symbol)")
def d21_regimes(spark, root):
    curve = store(DT.arc_curve(store(DT.matrix_profile(store(bars_h(spark, root)), 16)), 16))
    return PR.regimes(curve, store(PR.borders(curve, 16)))


@query("d30_alerts", "", """WITH f AS (SELECT * FROM events WHERE floor(epoch(ts)) > floor(epoch((SELECT max(ts) FROM events))) - 86400) SELECT event_id, event_type AS kind, value AS score FROM f JOIN (VALUES ('click', 20.0, TRUE), ('purchase', 50.0, TRUE), ('error', 0.0, FALSE)) r(kind, threshold, enabled) ON event_type = kind WHERE enabled AND value >= threshold""", "score")
def d30(spark, root):
    rules = spark.createDataFrame([("click", 20.0, True), ("purchase", 50.0, True), ("error", 0.0, False)], "kind string, threshold double, enabled boolean")
    m = table(spark, root, "events").select("event_id", "ts", F.col("event_type").alias("kind"), F.col("value").alias("score"))
    return DT.alerts(rules, m, 86400).select("event_id", "kind", "score")


@query("d31_upload_card", "series", "SELECT id, md5(array_to_string([CAST(CAST(round(x * 1e6) AS BIGINT) AS VARCHAR) for x in v], ',')) AS key, CAST(len(v) AS INT) AS length, list_avg(v) AS mean, list_min(v) AS min, list_max(v) AS max FROM series", "mean min max")
def d31(spark, root):
    return DT.upload_card(series(spark, root))

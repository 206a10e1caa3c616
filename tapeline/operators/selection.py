"""Top-k, selection and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import arrays as A
from tapeline.functions.lineage import cut


def top_k(df: DataFrame, by, order, k: int, salt: int | None = None, rank="rank") -> DataFrame:
    """Exact top-k per group.

    Each group is first cut to k rows inside ``salt`` sub-groups (as many as
    the session has shuffle partitions, if not given), so a hot group spreads
    over all tasks and sends at most salt*k rows to its final window.
    """
    by = list(by)
    salt = salt or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salt)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r", "_salt")
    return d.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def highest_variance(subs: DataFrame, n: int) -> DataFrame:
    """The n subsequences with the largest variance."""
    v = subs.withColumn("_m", A.mean("sub"))
    return v.withColumn("variance", A.moment("sub", F.col("_m"), 2)).drop("_m").orderBy(F.col("variance").desc(), "id", "start").limit(n)


def frontier(models: DataFrame) -> DataFrame:
    """Models more accurate than every faster model (one row per model, few rows)."""
    faster = Window.orderBy("latency", F.col("accuracy").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return models.withColumn("_best", F.max("accuracy").over(faster)).filter("_best IS NULL OR accuracy > _best").drop("_best")


def diverse(items: DataFrame, k: int) -> DataFrame:
    """Greedy farthest-point selection on equal-length arrays (id, quality, v).

    Round 0 takes the best quality; each later round takes the item farthest
    from everything chosen.  Only the chosen array travels back to the job.
    """
    far = F.lit(None).cast("double")
    d = cut(items.withColumn("gap", far))
    pick = d.agg(F.max_by(F.struct("id", "v"), F.struct("quality", -F.col("id"))).alias("p"))
    chosen = None
    for r in range(k):
        p = cut(pick)
        row = p.select(F.lit(r).alias("round"), "p.id")
        chosen = row if chosen is None else chosen.unionByName(row)
        if r == k - 1:
            break
        dist = F.sqrt(F.aggregate(F.zip_with("v", "p.v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        d = cut(d.crossJoin(F.broadcast(p)).filter(F.col("id") != F.col("p.id")).withColumn("gap", F.least("gap", dist)).drop("p"))
        pick = d.agg(F.max_by(F.struct("id", "v"), F.struct("gap", -F.col("id"))).alias("p"))
    return chosen


def tagged_union(parts: dict) -> DataFrame:
    """Union of frames with a source tag."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("source", F.lit(k)) for k, d in parts.items()])


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in the union, the intersection and each difference, tagged."""
    a, b = a.select(key).distinct(), b.select(key).distinct()
    return tagged_union({"union": a.union(b).distinct(), "intersection": a.intersect(b), "left_only": a.exceptAll(b), "right_only": b.exceptAll(a)})

"""Supervised models on MLlib: next-pattern classes, boosted regression, feature importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.frames import rolled
from tapeline.functions.lineage import cut, parts_for
from tapeline.operators.regimes import vectors


def next_pattern_features(patterns: DataFrame, types, window=5) -> DataFrame:
    """Counts per type over the last ``window``, last-type one-hot, distinct count, and the next type."""
    def build(h, w):
        f = w.rowsBetween(1 - window, 0)
        return h.select("symbol", "seq", "_c", *[F.sum((F.col("type") == t).cast("double")).over(f).alias(f"n_{t}") for t in types],
                        *[(F.col("type") == t).cast("double").alias(f"last_{t}") for t in types], F.size(F.array_distinct(F.collect_list("type").over(f))).cast("double").alias("unique"), F.lead("type").over(w).alias("next"))

    d = rolled(patterns, build, window, 1).filter("next IS NOT NULL")
    return cut(vectors(d, [c for c in d.columns if c not in ("symbol", "seq", "next")]).select("symbol", "seq", "next", "features"))


def next_pattern(train: DataFrame, test: DataFrame, trees=100, depth=10, rounds=100, boosted_depth=5, seed=42) -> DataFrame:
    """Forest and one-vs-rest boosted trees; the forest probability is averaged with the boosted vote."""
    ix = StringIndexer(inputCol="next", outputCol="label", handleInvalid="skip").fit(train)
    a, b = ix.transform(train), ix.transform(test)
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="_rf").fit(a)
    # boosting runs thousands of short jobs one after the other: the classes side by side, in few tasks while there are few rows
    few = cut(a, parts_for(a.count(), 50_000))
    gb = OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=boosted_depth, seed=seed), predictionCol="_gb", parallelism=len(ix.labels)).fit(few)
    d = gb.transform(rf.transform(b).drop("prediction", "rawPrediction"))
    p = F.transform(vector_to_array("_rf"), lambda x, i: (x + (F.col("_gb") == i).cast("double")) / 2)
    best = F.array_position(p, F.array_max(p)) - 1
    return d.withColumn("_p", p).select("symbol", "seq", "next", F.element_at(F.array(*[F.lit(x) for x in ix.labels]), best.cast("int") + 1).alias("predicted"), F.array_max("_p").alias("confidence"))


def boosted_folds(df: DataFrame, target: str, folds: int, gap: int, depths=(2, 3), rounds=100, seed=42) -> DataFrame:
    """Expanding-window folds on ``seq`` with a gap; RMSE for every fold and depth."""
    df = cut(df)
    top = df.agg(F.max("seq")).first()[0] + 1
    size, out = top // (folds + 1), None
    for k in range(1, folds + 1):
        train, test = df.filter(F.col("seq") < size * k - gap), df.filter((F.col("seq") >= size * k) & (F.col("seq") < size * (k + 1)))
        for depth in depths:
            m = GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed).fit(train)
            r = m.transform(test).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(target), 2))).alias("rmse")).select(F.lit(k).alias("fold"), F.lit(depth).alias("depth"), "rmse")
            out = r if out is None else out.unionByName(r)
    return out


def forest_importance(df: DataFrame, names, label="label", trees=100, depth=10, seed=42) -> DataFrame:
    m = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(df)
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, m.featureImportances.toArray())], "feature string, importance double")


def recursive_elimination(df: DataFrame, names, keep: int, label="label", seed=42) -> list:
    """Drop the weakest half of the surplus features until ``keep`` remain."""
    names = list(names)
    while len(names) > keep:
        imp = {r.feature: r.importance for r in forest_importance(vectors(df, names), names, label, seed=seed).collect()}
        names = sorted(names, key=imp.get, reverse=True)[: max(keep, len(names) - max(1, (len(names) - keep) // 2))]
    return names


def l1_importance(df: DataFrame, names, label="label", strength=0.01) -> DataFrame:
    """Absolute L1 logistic coefficients summed over classes, normalised by the maximum."""
    m = LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=strength, maxIter=50).fit(df)
    w = abs(m.coefficientMatrix.toArray()).sum(axis=0)
    top = w.max() or 1.0
    return df.sparkSession.createDataFrame([(n, float(v / top)) for n, v in zip(names, w)], "feature string, importance double")


def stacked(df: DataFrame, columns, target: str, key: str = "id", folds: int = 5) -> DataFrame:
    """Linear stacking of base predictions, out of fold: a row is scored by the fit on the other folds (``key`` decides the fold)."""
    d = cut(vectors(df, columns).withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(folds)).cast("int")))
    parts = []
    for k in range(folds):
        fit = LinearRegression(labelCol=target, regParam=0.0).fit(d.filter(F.col("_fold") != k))
        parts.append(fit.transform(d.filter(F.col("_fold") == k)).withColumnRenamed("prediction", "stacked").drop("features", "_fold"))
    return reduce(DataFrame.unionByName, parts)

"""Symbolic (SAX) representation, its features and motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import arrays as A


def sax(series: DataFrame, segments=8, alphabet=4, column="v", eps=1e-8) -> DataFrame:
    """Add the symbol string of array ``column``."""
    d = A.hold(series, _m=A.mean(column))
    d = A.hold(d, _s=A.std(column, F.col("_m")))
    d = A.hold(d, _z=A.znorm(column, F.col("_m"), F.col("_s"), eps))
    d = A.hold(d, _p=A.segment_means("_z", segments))
    return A.hold(d, sax=A.symbols("_p", alphabet)).drop("_m", "_s", "_z", "_p")


def inverse(words: DataFrame, length: int, alphabet=4) -> DataFrame:
    """Step series at the symbol midpoints; edge symbols sit 0.5 outside."""
    bp = A.breakpoints(alphabet)
    levels = [bp[0] - 0.5] + [(a + b) / 2 for a, b in zip(bp, bp[1:])] + [bp[-1] + 0.5]
    table = F.array(*[F.lit(float(x)) for x in levels])
    n = F.length("sax")
    code = lambda i: F.ascii(F.substr("sax", i + 1, F.lit(1))) - ord("a")
    # position t lies in segment i when floor(i*L/n) <= t < floor((i+1)*L/n)
    seg = lambda t: F.ceil((t + 1) * n / F.lit(length)).cast("int") - 1
    return words.withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.get(table, code(seg(t)))))


def similarity(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 for unequal lengths."""
    eq = F.zip_with(A.letters(a), A.letters(b), lambda x, y: (x == y).cast("int"))
    return F.when(F.length(a) != F.length(b), 0.0).otherwise(F.aggregate(eq, F.lit(0), lambda s, x: s + x) / F.length(a))


def padded_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions after repeating the last symbol of the shorter word."""
    n = F.greatest(F.length(a), F.length(b))
    pad = lambda s: F.concat(s, F.repeat(F.right(s, F.lit(1)), n - F.length(s)))
    return similarity(pad(a), pad(b))


def features(words: DataFrame) -> DataFrame:
    """Unique symbols, base-2 entropy and transition rate of ``sax``."""
    d = A.hold(words, _l=A.letters(F.col("sax")))
    n = F.size("_l")
    moves = F.zip_with(F.slice("_l", 2, n - 1), F.slice("_l", 1, n - 1), lambda x, y: (x != y).cast("int"))
    return d.select(*words.columns, F.size(F.array_distinct("_l")).alias("unique_symbols"), A.entropy(F.col("_l")).alias("symbol_entropy"),
                    F.try_divide(F.aggregate(moves, F.lit(0), lambda a, x: a + x), n - 1).alias("transition_rate"))


def motifs(words: DataFrame, kind: str, shortest=5, least=3, top=5) -> DataFrame:
    """Most frequent substrings per type; ties by the word itself."""
    n = F.length("sax")
    spans = F.flatten(F.transform(F.sequence(F.lit(shortest), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr("sax", i, k))))
    d = words.filter(n >= shortest).select(kind, F.explode(spans).alias("sub"))
    g = d.groupBy(kind, "sub").agg(F.count(F.lit(1)).alias("frequency")).filter(F.col("frequency") >= least)
    w = Window.partitionBy(kind).orderBy(F.col("frequency").desc(), "sub")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)

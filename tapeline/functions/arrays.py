"""Array expressions over one series per row; they need no shuffle."""

from __future__ import annotations

import statistics
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.functions.frames import div


def hold(df, **columns):
    """Add columns behind a generator so that later lambdas read a value.

    The optimiser otherwise inlines the defining expression into the lambda and
    evaluates it once per array element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def total(v, f=lambda x: x) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))


def mean(v) -> Column:
    return total(v) / F.size(v)


def moment(v, m: Column, k: int) -> Column:
    """Population central moment about ``m``."""
    return total(v, lambda x: reduce(lambda a, b: a * b, [x - m] * k)) / F.size(v)


def std(v, m: Column | None = None) -> Column:
    return F.sqrt(moment(v, mean(v) if m is None else m, 2))


def znorm(v, m: Column, s: Column, eps=1e-8) -> Column:
    return F.transform(v, lambda x: F.when(s < eps, F.lit(0.0)).otherwise((x - m) / s))


def diffs(v) -> Column:
    return F.zip_with(F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1), lambda b, a: b - a)


def slope(v) -> Column:
    """Least-squares slope against positions 0..n-1."""
    n = F.size(v)
    centre = (n - 1) / 2
    num = F.aggregate(F.transform(v, lambda x, i: x * (i - centre)), F.lit(0.0), lambda a, x: a + x)
    return num / (n * (n * n - 1) / 12)


def quantile(v, p: float) -> Column:
    """Linearly interpolated quantile."""
    s = F.array_sort(v)
    pos = (F.size(v) - 1) * F.lit(p)
    lo = F.floor(pos).cast("int")
    a, b = F.get(s, lo), F.get(s, F.ceil(pos).cast("int"))
    return a + (b - a) * (pos - lo)


def count_where(v, cond) -> Column:
    return F.size(F.filter(v, cond))


def triples(v) -> Column:
    """(left, mid, right, pos) of every interior position."""
    n = F.size(v)
    mid = F.slice(v, 2, n - 2)
    return F.transform(mid, lambda x, i: F.struct(F.get(v, i).alias("left"), x.alias("mid"), F.get(v, i + 2).alias("right"), (i + 1).alias("pos")))


def peaks(v, prominence=None) -> Column:
    """Interior strict maxima, optionally higher than the lower neighbour by ``prominence``."""
    ok = lambda t: (t.mid > t.left) & (t.mid > t.right)
    if prominence is not None:
        return F.filter(triples(v), lambda t: ok(t) & (t.mid - F.least(t.left, t.right) > prominence))
    return F.filter(triples(v), ok)


def valleys(v, prominence=None) -> Column:
    ok = lambda t: (t.mid < t.left) & (t.mid < t.right)
    if prominence is not None:
        return F.filter(triples(v), lambda t: ok(t) & (F.greatest(t.left, t.right) - t.mid > prominence))
    return F.filter(triples(v), ok)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def correlation(a, b) -> Column:
    n, sa, sb = F.size(a), total(a), total(b)
    cov = dot(a, b) - sa * sb / n
    va, vb = dot(a, a) - sa * sa / n, dot(b, b) - sb * sb / n
    return div(cov, F.sqrt(F.greatest(va * vb, F.lit(0.0))))


def resample(v, length: int) -> Column:
    """Linear resampling to ``length`` points over the same span."""
    n = F.size(v)

    def at(k):
        pos = k * (n - 1) / F.lit(max(length - 1, 1))
        lo = F.floor(pos).cast("int")
        a = F.get(v, lo)
        b = F.coalesce(F.get(v, lo + 1), a)
        return a + (b - a) * (pos - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


# Symbol breakpoints by alphabet size.
BREAKPOINTS = {
    3: [-0.43, 0.43],
    4: [-0.67, 0, 0.67],
    5: [-0.84, -0.25, 0.25, 0.84],
    6: [-0.97, -0.43, 0, 0.43, 0.97],
    7: [-1.07, -0.57, -0.18, 0.18, 0.57, 1.07],
    8: [-1.15, -0.67, -0.32, 0, 0.32, 0.67, 1.15],
    9: [-1.22, -0.76, -0.43, -0.14, 0.14, 0.43, 0.76, 1.22],
    10: [-1.28, -0.84, -0.52, -0.25, 0, 0.25, 0.52, 0.84, 1.28],
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def breakpoints(alphabet: int) -> list:
    normal = statistics.NormalDist()
    return BREAKPOINTS.get(alphabet) or [normal.inv_cdf((i + 1) / (alphabet + 1)) for i in range(alphabet - 1)]


def segment_means(z, segments: int) -> Column:
    """Piecewise means; cut points are truncated, so short series give empty (NULL) segments."""
    n = F.size(z)
    out = []
    for i in range(segments):
        lo, hi = F.floor(n * i / F.lit(segments)).cast("int"), F.floor(n * (i + 1) / F.lit(segments)).cast("int")
        out.append(div(total(F.slice(z, lo + 1, hi - lo)), hi - lo))
    return F.array(*out)


def symbols(paa, alphabet: int) -> Column:
    """Symbol string: letter = number of breakpoints strictly below; NULL maps to 'a'."""
    letter = lambda x: F.coalesce(reduce(lambda w, i: w.when(x <= i[1], F.lit(LETTERS[i[0]])), enumerate(breakpoints(alphabet)), F.when(x.isNull(), F.lit("a"))).otherwise(F.lit(LETTERS[alphabet - 1])), F.lit("a"))
    return F.array_join(F.transform(paa, letter), "")


def letters(text) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(items: Column) -> Column:
    """Base-2 entropy of the items of an array."""
    n = F.size(items)
    share = lambda u: F.size(F.filter(items, lambda x: x == u)) / n
    return -F.aggregate(F.transform(F.array_distinct(items), lambda u: share(u) * F.log2(share(u) + 1e-10)), F.lit(0.0), lambda a, x: a + x)


def key_below(keys, share: float) -> Column:
    """True for the given share of keys: the first 32 bits of the MD5 of the keys, joined by a bar, as hexadecimal text."""
    return F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])), 1, 8) < f"{int(share * 2**32):08x}"

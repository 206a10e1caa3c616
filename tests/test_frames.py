"""Chunked helpers against pandas on a series longer than several chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.functions import frames
from tapeline.functions.frames import ewm, number_rows, quantiles, rmean, rolled, run_ids, running, span
from tapeline.operators import risk, sequences


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    rows = [("hot", i) for i in range(700)] + [("small", i) for i in range(9)] + [("one", 0)]
    pdf = pd.DataFrame(rows, columns=["symbol", "seq"])
    pdf["close"] = np.round(100 + rng.normal(0, 1, len(pdf)).cumsum(), 4)
    pdf["high"], pdf["low"] = pdf.close + 0.5, pdf.close - 0.5
    return pdf, spark.createDataFrame(pdf)


@pytest.fixture(autouse=True)
def small_chunks(monkeypatch):
    monkeypatch.setattr(frames, "CHUNK", 64)


def back(df):
    return df.toPandas().sort_values(["symbol", "seq"]).reset_index(drop=True)


def test_number_rows(spark, data):
    pdf, df = data
    out = back(number_rows(df.withColumnRenamed("seq", "t"), ["t"], F.floor(F.col("t") / 10)))
    assert (out.seq == out.t).all()


def test_rolling_crosses_chunks(spark, data):
    pdf, df = data
    out = back(rolled(df, lambda h, w: h.withColumn("m", rmean(F.col("close"), 100, w)), 100))
    want = pdf.sort_values(["symbol", "seq"]).groupby("symbol").close.rolling(100).mean().reset_index(drop=True)
    np.testing.assert_allclose(out.m.to_numpy(float), want.to_numpy(), rtol=1e-9)


def test_running_and_reverse(spark, data):
    pdf, df = data
    x = F.when(F.col("seq") % 7 == 3, F.col("close"))
    out = back(running(running(df, {"s": (F.col("close"), "sum"), "top": (F.col("close"), "max"), "l": (x, "last")}), {"n": (x, "last")}, reverse=True))
    p = pdf.sort_values(["symbol", "seq"]).reset_index(drop=True)
    g = p.groupby("symbol").close
    np.testing.assert_allclose(out.s, g.cumsum())
    np.testing.assert_allclose(out.top, g.cummax())
    known = p.close.where(p.seq % 7 == 3)
    np.testing.assert_allclose(out.l.to_numpy(float), known.groupby(p.symbol).ffill())
    np.testing.assert_allclose(out.n.to_numpy(float), known.groupby(p.symbol).bfill())


@pytest.mark.parametrize("alpha", [span(12), span(50), 0.01, 0.8])
def test_ewm(spark, data, alpha):
    pdf, df = data
    out = back(ewm(df, {"e": (F.col("close"), alpha)}))
    want = pdf.sort_values(["symbol", "seq"]).groupby("symbol").close.transform(lambda s: s.ewm(alpha=alpha, adjust=False).mean())
    np.testing.assert_allclose(out.e, want.to_numpy(), rtol=1e-10)


def test_runs_and_quantiles(spark, data):
    pdf, df = data
    out = back(run_ids(df, F.floor(F.col("seq") / 90)))
    assert (out.run == out.seq // 90).all()
    q = quantiles(df, ["symbol"], "close", {"a": 0.05, "b": 0.5, "c": 1.0}).toPandas().set_index("symbol")
    for s, g in pdf.groupby("symbol"):
        np.testing.assert_allclose(q.loc[s].to_numpy(float), np.percentile(g.close, [5, 50, 100]))


def test_scan_matches_serial_loop(spark, data):
    pdf, df = data
    out = back(sequences.parabolic_sar(df))
    for s, g in pdf.groupby("symbol"):
        h, l, c = g.high.to_numpy(), g.low.to_numpy(), g.close.to_numpy()
        line, bull, af, ep = c.copy(), True, 0.02, h[0]
        for i in range(1, len(c)):
            line[i] = line[i - 1] + af * (ep - line[i - 1])
            if bull and l[i] < line[i]:
                bull, line[i], ep, af = False, ep, l[i], 0.02
            elif not bull and h[i] > line[i]:
                bull, line[i], ep, af = True, ep, h[i], 0.02
            elif bull and h[i] > ep:
                ep, af = h[i], min(af + 0.02, 0.2)
            elif not bull and l[i] < ep:
                ep, af = l[i], min(af + 0.02, 0.2)
        np.testing.assert_allclose(out[out.symbol == s].psar, line)


@pytest.mark.parametrize("every", [0, 50, 300])
def test_scan_keeps_states_only(spark, monkeypatch, every):
    """A sum that starts anew at multiples of ``every`` (0: never) equals the serial one, however many partitions hold its pieces; between its runs only one narrow row a piece is kept."""
    from tapeline.functions import scan as S

    kept, many = [], "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(S, "cut", lambda df, real=S.cut: kept.append(df.schema.simpleString()) or real(df))

    def kernel(a, state):
        total, out = (state or {"t": 0.0})["t"], []
        for x in a["x"].tolist():
            total = (0.0 if every and x % every == 0 else total) + x / 3
            out.append(total)
        return {"s": out}, {"t": total}

    rows = [(k, i, float(i + 7 * j)) for j, k in enumerate(["a", "b"]) for i in range(900 if k == "a" else 40)]
    spark.conf.set(many, "false")
    try:
        got = {(r.symbol, r.seq): r.s for r in S.scan(spark.createDataFrame(rows, "symbol string, seq long, x double"), ["x"], kernel, {"s": "double"}, "struct<t:double>", chunk=4).collect()}
    finally:
        spark.conf.unset(many)
    want, total = {}, {}
    for k, i, x in rows:
        total[k] = (0.0 if i == 0 or every and x % every == 0 else total[k]) + x / 3
        want[k, i] = total[k]
    assert got == want
    assert kept and not any("array" in x for x in kept)


def test_store_releases_shuffles(spark):
    """The shuffle files of a released write are gone when it returns, and the session's setting is as it was."""
    from tapeline.functions import lineage

    managers = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (str(x) for x in managers.getAllFiles().mkString("|").split("|")) if "shuffle_" in f}
    old, was = files(), spark.conf.get(lineage._CLEANUP, None)
    got = lineage.store(spark.range(1000).repartition(7, "id"), release=True)
    assert not files() - old and spark.conf.get(lineage._CLEANUP, None) == was and got.count() == 1000


def test_nulls_stay(spark):
    """Rows with a NULL key or order value are numbered, cumulated and ranked like others."""
    df = spark.createDataFrame([("a", 3), ("a", None), (None, 1), (None, 2), ("a", 1), (None, None)], "symbol string, t long")
    out = number_rows(df, ["t"], F.floor(F.col("t") / 2))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted([("a", None, 0), ("a", 1, 1), ("a", 3, 2), (None, None, 0), (None, 1, 1), (None, 2, 2)], key=repr)
    total = running(out, {"s": (F.col("t"), "sum")})
    assert {(r.symbol, r.seq): r.s for r in total.collect()} == {("a", 0): 0, ("a", 1): 1, ("a", 2): 4, (None, 0): 0, (None, 1): 1, (None, 2): 3}
    assert {r.symbol: r.m for r in quantiles(out, ["symbol"], "t", {"m": 0.5}).collect()} == {"a": 2.0, None: 1.5}


@pytest.mark.parametrize("alpha", [0.01, span(12), 0.5, 0.97, 1.0])
@pytest.mark.parametrize("every", [1, 3, 90, 333])
def test_ewm_gaps(spark, data, monkeypatch, alpha, every):
    """NULL runs of all lengths, leading ones and whole chunks included, against the pandas recurrence."""
    monkeypatch.setattr(frames, "EMA_CHUNK", 64)
    pdf, _ = data
    pdf = pdf.copy()
    pdf["x"] = pdf.close.where((pdf.seq + 2) % every == 0) if every > 1 else pdf.close.where(~pdf.seq.between(0, 3) & ~pdf.seq.between(200, 420))
    rows = [(s, int(q), None if np.isnan(x) else float(x)) for s, q, x in zip(pdf.symbol, pdf.seq, pdf.x)]
    got = back(ewm(spark.createDataFrame(rows, "symbol string, seq long, x double"), {"e": (F.col("x"), alpha)}))
    want = pdf.sort_values(["symbol", "seq"]).groupby("symbol").x.transform(lambda x: x.ewm(alpha=alpha, adjust=False).mean())
    np.testing.assert_allclose(got.e.to_numpy(float), want.to_numpy(), rtol=1e-9)

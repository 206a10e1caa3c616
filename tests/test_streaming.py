"""The streams give the answers of a plain replay, for files in any order; replayed batches add nothing; late rows are dropped."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeline.plans import load_all
from tapeline.plans import t_streams as TS
from tapeline.streaming import bars as SB
from tapeline.streaming import monitor as MO


@pytest.fixture(scope="module")
def bars(spark, root):
    return sorted((r.symbol, r.t, r.close, r.volume) for r in TS.monitor_bars(spark, root).collect())


def replayed(bars):
    """Events of each series, bar after bar, and the expiries behind the last one."""
    out, by = [], defaultdict(list)
    for s, *bar in bars:
        by[s].append(bar)
    for s, series in by.items():
        state = {"p": [], "v": [], "active": []}
        events = [e for bar in series for e in MO.advance(state, *bar)] + MO.expire(state, 1e18)
        assert len(state["p"]) == min(len(series), MO.BUFFER) and not state["active"]
        out += [(s, *[e[c] for c in COLUMNS]) for e in events]
    return sorted(out, key=repr)


COLUMNS = ["kind", "event", "t", "started", "confidence", "progress", "stage", "price", "expected_move", "risk"]


def rows(df):
    return sorted((tuple(r) for r in df.select("symbol", *COLUMNS).collect()), key=repr)


def test_alerts(spark, root, bars):
    q = load_all().QUERIES
    want = replayed(bars)
    assert {"detected", "completed"} <= {r[2] for r in want}
    for name in ("t05_monitor_alerts", "t03_stream_alerts", "t08_alert_sink"):
        assert rows(q[name](spark, root)) == want, name


def test_backfill(spark, root, bars):
    middle = (min(b[1] for b in bars) + max(b[1] for b in bars)) / 2
    got = rows(load_all().QUERIES["t02_backfill"](spark, root))
    want = [r for r in replayed(bars) if r[3] > middle]
    assert [r for r in got if r[3] > middle] == want and all(r[2] == "expired" for r in got if r[3] <= middle)


def test_rules():
    """A formation is raised once, has progress and a stage, completes or expires at twice its duration."""
    state, events = {"p": [], "v": [], "active": []}, []
    for i in range(60):
        price = 100 + 0.002 * i
        events += MO.advance(state, 60.0 * i, price, 10.0 if i < 59 else 1.0)
    kinds = [(e["kind"], e["event"]) for e in events]
    assert ("continuation", "completed") in kinds
    e = next(e for e in events if e["event"] == "completed")
    assert e["progress"] == 100.0 and e["stage"] == "forming" and e["expected_move"] == e["price"] * 0.02
    state = {"p": [], "v": [], "active": [["breakout", 0.0, 0.75], ["reversal", 0.0, 0.75]]}
    assert MO.expire(state, 1200.0) == [] and [x["kind"] for x in MO.expire(state, 1200.5)] == ["breakout"]
    assert [a[0] for a in state["active"]] == ["reversal"]
    gone = MO.advance(state, 1e6, 5.0, 1.0)
    assert [(x["event"], x["t"]) for x in gone] == [("expired", 1800.0)]


def test_sink_takes_a_batch_once(spark, tmp_path):
    write, path = SB.keep_batch(str(tmp_path / "alerts")), str(tmp_path / "alerts")
    for batch, n in ((0, 3), (1, 5), (1, 5), (0, 3)):
        write(spark.range(n), batch)
    assert {r["batch"]: r["count"] for r in spark.read.parquet(path).groupBy("batch").count().collect()} == {0: 3, 1: 5}


def test_event_time_bars(spark, root):
    import __spark_entry__ as entry
    from check import compare, connect

    got = entry.queries()["t17_event_time_bars"](spark, root).toPandas()
    assert compare(got, connect(root).execute(entry.oracle_sql()["t17_event_time_bars"]).df()) == "ok"


def test_late_ticks_are_dropped(spark, tmp_path):
    """A tick behind the watermark changes no bar."""
    path = str(tmp_path / "in")
    tick = lambda at, price: spark.range(1).select(F.lit("a").alias("symbol"), F.lit(at).cast("timestamp").alias("ts"), F.struct(F.lit(price).alias("event_id")).alias("tie"), F.lit(price).cast("double").alias("price"), F.lit(1).alias("size"))
    for at, price in (("2024-01-01 00:10:00", 1), ("2024-01-01 03:00:00", 2), ("2024-01-01 03:10:00", 2), ("2024-01-01 00:20:00", 9), ("2024-01-01 09:00:00", 3)):
        tick(at, price).coalesce(1).write.mode("append").parquet(path)
    stream = SB.tick_stream(spark, path, tick("2024-01-01", 0).schema)
    SB.run_once(SB.event_time_bars(stream), str(tmp_path / "bars"), str(tmp_path / "ck"))
    assert sorted((r.ts.hour, r.high) for r in spark.read.parquet(str(tmp_path / "bars")).collect()) == [(0, 1.0), (3, 2.0)]

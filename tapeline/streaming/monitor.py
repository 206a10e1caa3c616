"""Keyed pattern monitor: one rule engine for the stream and for its batch twin.

Per symbol the state is the list of the last ``BUFFER`` bars and a map of active formations (kind, start). The stream keeps them with
``transformWithStateInPandas``: bars that arrive wait in a second list until the watermark has passed them and are then taken in the order of their event
time, so any cut into files and any order within the watermark's delay gives the same answers. One event-time timer per symbol stands at the next waiting bar or
the next expiry. The batch form runs the same step with ``scan``.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tapeline.functions import kernels as K
from tapeline.functions.scan import scan

BUFFER = 100
# Expected minutes, expected move and risk level of each formation.
FORMATIONS = {
    "breakout": (10, 0.03, "medium"),
    "reversal": (15, -0.05, "high"),
    "continuation": (8, 0.02, "low"),
    "triangle": (20, 0.04, "medium"),
    "head_shoulders": (25, -0.06, "high"),
}
MIN_CONFIDENCE, ALERT_CONFIDENCE, COMPLETE = 0.7, 0.8, 90.0
#: shares of the expected duration within which a formation is not raised again, and after which it expires
AGAIN, EXPIRED = 1.5, 2.0


@cache
def _macd_weights(n: int) -> np.ndarray:
    """Weights of a buffer of ``n`` prices in the gap of MACD (12, 26) and its signal (9)."""

    def ema(period):
        a = 2 / (period + 1)
        age = np.subtract.outer(np.arange(n), np.arange(n)).astype(float)
        w = np.where(age >= 0, a * (1 - a) ** np.maximum(age, 0), 0.0)
        w[:, 0] /= a
        return w

    macd = ema(12) - ema(26)
    return macd[-1] - ema(9)[-1] @ macd


def features(p: np.ndarray, v: np.ndarray) -> dict:
    """Numbers the rules read, from the current buffer."""
    x = np.arange(len(p))
    slope = np.polyfit(x, p, 1)[0]
    fit = np.polyval(np.polyfit(x, p, 1), x)
    total = ((p - p.mean()) ** 2).sum()
    d = np.diff(p)[:14]
    up, down = d[d >= 0].sum() / 14, -d[d < 0].sum() / 14
    hi, lo = K.peaks(p, 5), K.peaks(-p, 5)
    near = lambda k: bool(len(k)) and abs(p[-1] - p[k[-1]]) / abs(p[k[-1]]) < 0.01
    return {
        "change": (p[-1] - p[0]) / p[0], "volatility": p.std() / p.mean(), "strength": 1 - ((p - fit) ** 2).sum() / total if total > 0 else 0.0, "slope": slope,
        "volume_ratio": v[-1] / v.mean() if v.mean() else 0.0, "volume_trend": np.polyfit(x, v, 1)[0], "rsi": 100.0 if down == 0 else 100 - 100 / (1 + up / down),
        "macd": float(_macd_weights(len(p)) @ p / p[-1]) if len(p) >= 26 else 0.0, "resistance": near(hi), "support": near(lo), "highs": hi, "lows": lo}


def _line(p, k):
    return np.polyfit(k, p[k], 1)[0]


def confidences(p: np.ndarray, f: dict) -> dict:
    """Additive score of each formation, at most 1."""
    hi, lo = f["highs"], f["lows"]
    squeeze = len(hi) >= 2 and len(lo) >= 2 and _line(p, hi) < 0 < _line(p, lo)
    shoulders = [len(hi) >= 3 and p[hi[1]] > max(p[hi[0]], p[hi[2]]), False, False]
    if len(hi) >= 3:
        shoulders[1] = shoulders[0] and abs(p[hi[0]] - p[hi[2]]) / p[hi[1]] < 0.05
        shoulders[2] = len(lo) >= 2 and abs(_line(p, lo[:2])) < 0.001
    stretched = (f["slope"] > 0 and f["rsi"] > 70) or (f["slope"] < 0 and f["rsi"] < 30)
    rules = {
        "breakout": [(0.3, f["resistance"] and f["change"] > 0.02), (0.3, f["volume_ratio"] > 1.5), (0.2, f["strength"] > 0.7), (0.2, 60 < f["rsi"] < 80)],
        "reversal": [(0.25, abs(f["change"]) > 0.05 and f["volatility"] > 0.02), (0.35, stretched), (0.2, f["volume_trend"] * f["slope"] < 0), (0.2, f["support"] or f["resistance"])],
        "continuation": [(0.4, f["volatility"] < 0.015 and abs(f["change"]) < 0.02), (0.3, f["volume_ratio"] < 0.8), (0.3, f["strength"] > 0.6)],
        "triangle": [(0.5, squeeze), (0.3, f["volatility"] < 0.02), (0.2, f["volume_trend"] < 0)],
        "head_shoulders": [(0.4, shoulders[0]), (0.3, shoulders[1]), (0.3, shoulders[2])],
    }
    return {k: min(sum(w for w, hit in r if hit), 1.0) for k, r in rules.items()}


def progress(kind: str, p: np.ndarray, f: dict) -> float:
    """Per cent of the formation's two key features that are there."""
    hi, lo = f["highs"], f["lows"]
    key = {
        "breakout": (f["resistance"] and f["change"] > 0.01, f["volume_ratio"] > 1.5),
        "reversal": (f["rsi"] > 70 or f["rsi"] < 30, abs(f["macd"]) > 0.001),
        "continuation": (f["volatility"] < 0.015, f["volume_ratio"] < 0.8),
        "triangle": (f["volatility"] < 0.02, f["volatility"] < 0.015),
        "head_shoulders": (len(hi) >= 3, len(lo) >= 2 and abs(_line(p, lo[:2])) < 0.001),
    }[kind]
    share = 100.0 * sum(map(bool, key)) / len(key)
    return min(share, 60.0) if kind == "head_shoulders" and len(hi) < 3 else share


def stage(kind: str, f: dict) -> str:
    """Where the formation stands."""
    if kind == "breakout":
        return "approaching_resistance" if f["resistance"] else "breaking_out" if f["change"] > 0.01 else "consolidating"
    if kind == "reversal":
        return "extreme_reached" if f["rsi"] > 70 or f["rsi"] < 30 else "divergence_forming" if abs(f["macd"]) > 0.001 else "momentum_slowing"
    if kind == "triangle":
        return "apex_approaching" if f["volatility"] < 0.01 else "converging"
    return "forming"


def key_levels(p: np.ndarray, f: dict, n=5) -> list:
    """Lowest ``n`` distinct levels of extremes, peaks and valleys."""
    return sorted({float(x) for x in (p.max(), p.min(), *p[f["highs"]], *p[f["lows"]])})[:n]


def deadline(kind: str, start: float) -> float:
    return start + EXPIRED * 60 * FORMATIONS[kind][0]


def expire(state: dict, now: float) -> list:
    """Takes formations out whose deadline is before ``now``; they end at the deadline."""
    gone = sorted((deadline(k, s), k, s) for k, s, _ in state["active"] if deadline(k, s) < now)
    state["active"] = [a for a in state["active"] if deadline(a[0], a[1]) >= now]
    return [_event(k, "expired", t, s, None, None, None, None, None) for t, k, s in gone]


def _event(kind, event, t, started, confidence, share, where, price, levels):
    return {"kind": kind, "event": event, "t": float(t), "started": float(started), "confidence": None if confidence is None else float(round(confidence, 6)), "progress": share, "stage": where,
            "price": price, "expected_move": None if price is None else price * FORMATIONS[kind][1], "risk": FORMATIONS[kind][2], "levels": levels}


def advance(state: dict, t: float, price: float, volume: float) -> list:
    """Take one bar; returns the events up to it.  ``t`` is in seconds.

    ``state`` holds prices ``p``, volumes ``v`` and the active formations (kind, start, confidence). A formation is raised once within 1.5 times its expected
    duration, completes when its key features are there, and expires after twice the duration.
    """
    out = expire(state, t)
    state["p"], state["v"] = (state["p"] + [price])[-BUFFER:], (state["v"] + [volume])[-BUFFER:]
    if len(state["p"]) < 20:
        return out
    p, v = np.array(state["p"]), np.array(state["v"])
    f = features(p, v)
    for kind, c in confidences(p, f).items():
        if c >= MIN_CONFIDENCE and not any(k == kind and t - s < AGAIN * 60 * FORMATIONS[k][0] for k, s, _ in state["active"]):
            state["active"].append([kind, t, c])
            if c >= ALERT_CONFIDENCE:
                out.append(_event(kind, "detected", t, t, c, progress(kind, p, f), stage(kind, f), price, key_levels(p, f)))
    still = []
    for kind, start, c in state["active"]:
        share = progress(kind, p, f)
        if share >= COMPLETE:
            out.append(_event(kind, "completed", t, start, c, share, stage(kind, f), price, key_levels(p, f)))
        else:
            still.append([kind, start, c])
    state["active"] = still
    return out


ALERT = "kind string, event string, t double, started double, confidence double, progress double, stage string, price double, expected_move double, risk string, levels array<double>"
_FIELDS = [x.split(" ")[0] for x in ALERT.split(", ")]


def batch_alerts(bars: DataFrame, horizon: float | None = None) -> DataFrame:
    """(symbol, events) of finished series (symbol, seq, t, close, volume); equals the stream on the same bars.

    With ``horizon``, formations that are open at the end of a series and whose deadline is before it expire as well.
    """

    def kernel(a, state):
        s = json.loads(state["s"]) if state else {"p": [], "v": [], "active": []}
        rows, open_ = [], []
        for t, p, v in zip(a["t"], a["close"], a["volume"]):
            rows.append(json.dumps(advance(s, float(t), float(p), float(v))))
            open_.append(json.dumps(s["active"]))
        return {"alerts": rows, "open": open_}, {"s": json.dumps(s, sort_keys=True)}

    kind = "array<struct<" + ALERT.replace(" string", ":string").replace(" double", ":double").replace(" array", ":array") + ">>"
    d = scan(bars, ["t", "close", "volume"], kernel, {"alerts": "string", "open": "string"}, "struct<s:string>")
    found = d.filter("alerts <> '[]'").select("symbol", F.inline(F.from_json("alerts", kind)))
    if horizon is None:
        return found
    shape = found.schema

    def rest(batches):
        for pdf in batches:
            out = [{"symbol": s, **e} for s, o in zip(pdf.symbol, pdf.open) for e in expire({"active": json.loads(o)}, horizon)]
            yield pd.DataFrame(out, columns=["symbol", *_FIELDS])

    last = d.groupBy("symbol").agg(F.max_by("open", "seq").alias("open"))
    return found.unionByName(last.mapInPandas(rest, shape))


_BAR = "t double, close double, volume double"


def _put(state, rows):
    """The store takes no empty lists."""
    state.put(rows) if rows else state.clear()


class Monitor(StatefulProcessor):
    """The step of the stream. Rows without a price only move the watermark."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _BAR)
        self.history = handle.getListState("history", _BAR)
        self.active = handle.getMapState("active", "kind string, started double", "confidence double")

    def handleInputRows(self, key, rows, timerValues):
        new = [r for pdf in rows for r in zip(pdf.t.tolist(), pdf.close.tolist(), pdf.volume.tolist()) if r[1] == r[1]]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs() / 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Backfill: earlier bars go through the same step, their events are not given again."""
        state, bars = {"p": [], "v": [], "active": []}, sorted(zip(initialState.t.tolist(), initialState.close.tolist(), initialState.volume.tolist()))
        for bar in bars:
            advance(state, *bar)
        self._keep(state, bars[-BUFFER:])

    def close(self) -> None:
        pass

    def _keep(self, state, bars):
        _put(self.history, bars)
        self.active.clear()
        for kind, start, confidence in state["active"]:
            self.active.updateValue((kind, start), (confidence,))

    def _advance(self, key, new, now):
        bars = list(self.history.get())
        state = {"p": [b[1] for b in bars], "v": [b[2] for b in bars], "active": sorted(([k[0], k[1], c[0]] for k, c in self.active.iterator()), key=lambda a: a[1])}
        waiting = sorted([*map(tuple, self.waiting.get()), *new])
        out = []
        for bar in (b for b in waiting if b[0] <= now):
            out += advance(state, *bar)
            bars.append(bar)
        out += expire(state, now)
        self._keep(state, [tuple(b) for b in bars[-BUFFER:]])
        waiting = [b for b in waiting if b[0] > now]
        _put(self.waiting, waiting)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        nexts = [waiting[0][0]] if waiting else []
        nexts += [deadline(k, s) for k, s, _ in state["active"]]
        if nexts:
            self.handle.registerTimer(max(int(min(nexts) * 1000), int(now * 1000)) + 1)
        if out:
            yield pd.DataFrame([{"symbol": key[0], **e} for e in out], columns=["symbol", *_FIELDS])


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_alerts(bars: DataFrame, late: str, history: DataFrame | None = None) -> DataFrame:
    """(symbol, events) of a bar stream (symbol, ts timestamp, close, volume), append mode.

    Bars more than ``late`` behind the newest are dropped. ``history`` (same columns, a batch table of earlier bars) is the state to start from. Needs the RocksDB state
    store: start the query inside ``rocks_store``.
    """
    spark = bars.sparkSession
    timed = lambda d: d.select("symbol", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "close", "volume")
    live = timed(bars.withWatermark("ts", late))
    start = None if history is None else timed(history.withColumn("ts", F.col("ts").cast("timestamp"))).groupBy("symbol")
    return live.groupBy("symbol").transformWithStateInPandas(Monitor(), f"symbol {dict(bars.dtypes)['symbol']}, {ALERT}", "Append", "EventTime", initialState=start)


class rocks_store:
    """The session's state store setting while a query is started."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(STORE, None)
        self.conf.set(STORE, ROCKS)

    def __exit__(self, *_):
        self.conf.set(STORE, self.before) if self.before else self.conf.unset(STORE)

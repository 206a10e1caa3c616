"""Exact sequential scans over chunks of an ordered series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import frames
from tapeline.functions.lineage import cut, store

#: Chunks of a stored piece: states are kept, compared and sent once for each piece.
PIECE = 16


def _field(name):
    return lambda row: row[name]


def scan(df: DataFrame, columns, kernel, out: dict, state: str, by="symbol", chunk=None, rounds=4) -> DataFrame:
    """Run ``kernel(arrays, state) -> (outputs, state)`` along every series.

    A recurrence that Spark windows cannot express is cut into pieces of ``PIECE`` chunks.  Every
    piece is first run from an unknown state (``None``); then the state at the
    end of a piece is compared with the state its successor was started from,
    and only the successors that differ are run again.  The loop ends when
    nothing differs, so the result equals a serial scan for any input.  A rule
    that forgets its past settles in a few rounds; if a round leaves more than half of
    its pieces, or after ``rounds``, the series left run through one task each, piece by piece.

    These runs keep only states, one row a piece, which are broadcast; the rows are stored once, compressed, and the
    outputs come from one last run of every piece from its known start.  A NULL key starts anew with each chunk.

    ``out`` maps output names to SQL types, ``state`` is the state's SQL struct.
    """
    size = chunk or frames.CHUNK
    key = F.floor(F.col("seq") / F.lit(size * PIECE)).alias("c")
    rows = F.array_sort(F.collect_list(F.struct("seq", *columns)))
    g = df.groupBy(by, key).agg(rows.alias("rows"))
    chunks = store(g.select(by, "c", *[F.transform("rows", _field(k)).alias("a_" + k) for k in ("seq", *columns)]), release=True)

    def piece(r, start):
        """Outputs and end state of one piece."""
        arrays = {k: np.asarray(r["a_" + k]) for k in columns}
        if not pd.isna(r[by]):
            return kernel(arrays, start)
        at = np.asarray(r["a_seq"]) // size
        parts = [kernel({k: v[at == c] for k, v in arrays.items()}, None) for c in np.unique(at)]
        return {k: [x for o, _ in parts for x in o[k]] for k in out}, parts[-1][1]

    def states(batches, serial=False):
        last, end = None, None
        for pdf in batches:
            res = {by: [], "c": [], "start": [], "state": []}
            for r in pdf.to_dict("records"):
                if serial:
                    start = end if r[by] == last else None
                else:
                    start = r["start"] if isinstance(r["start"], dict) else None
                end, last = piece(r, start)[1], r[by]
                for k, v in {by: last, "c": r["c"], "start": start, "state": end}.items():
                    res[k].append(v)
            yield pd.DataFrame(res)

    def outputs(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                o = piece(r, r["start"] if isinstance(r["start"], dict) else None)[0]
                yield pd.DataFrame({by: [r[by]], "seq": [r["a_seq"]], **{k: [o[k]] for k in out}})

    kind = df.schema[by].dataType.simpleString()
    known = f"{by} {kind}, c long, start {state}, state {state}"
    flat = f"{by} {kind}, seq array<long>, " + ", ".join(f"{k} array<{t}>" for k, t in out.items())
    done = cut(chunks.select("*", F.lit(None).cast(state).alias("start")).mapInPandas(states, known))
    left = None
    for turn in range(rounds + 1):
        prev = done.select(by, (F.col("c") + 1).alias("c"), F.col("state").alias("now"))
        stale = cut(done.join(prev, [by, "c"]).filter(~F.col("start").eqNullSafe(F.col("now"))).select(by, "c", F.col("now").alias("start")))
        before, left = left, stale.count()
        if not left:
            break
        if turn == rounds or before is not None and 2 * left > before:
            names = F.broadcast(stale.select(by).distinct())
            ordered = chunks.join(names, by, "left_semi").repartition(by).sortWithinPartitions(by, "c")
            whole = store(ordered.mapInPandas(lambda batches: states(batches, True), known), release=True)
            done = done.join(names, by, "left_anti").unionByName(whole)
            break
        redone = chunks.join(F.broadcast(stale), [by, "c"]).mapInPandas(states, known)
        done = cut(done.join(stale, [by, "c"], "left_anti").unionByName(redone))
    starts = done.filter("start IS NOT NULL").select(by, "c", "start")
    res = chunks.join(F.broadcast(starts), [by, "c"], "left").mapInPandas(outputs, flat)
    res = res.select(by, F.explode(F.arrays_zip("seq", *out)).alias("x"))
    return res.select(by, "x.seq", *[F.col("x." + k) for k in out])

"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target ``t`` and size ``s`` is wanted ``t / s`` times. The whole part is taken; the fractions are rounded dependently:
two documents meet, a random one of the two passes mass (fraction times words) to the other until one fraction is 0 or 1, and the one that is
still open meets the next. Mass is conserved, so a source ends within one word of its target. Documents are paired inside hash buckets of about
``leaf`` documents, each leaves at most one open fraction, and the open ones meet again in groups of ``fan`` buckets up a tree until one per source
is left; that one gives its fraction of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.lineage import parts_for, store
from tapeline.llm.common import WORD, join_same, key_of, keyed, text_of, unpack, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
LEAF, FAN = 1024, 1024
SEED = 20_26
_SNAP = 1e-9


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at ``most`` times its source's size, the
    excess goes to the others by weight. The level at which nobody is above is found from prefix sums over the sources in the order in which
    they reach their cap. One row per source: the only global order here.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = sources.withColumn("weight", weight).withColumn("cap", cap).withColumn("reach", F.col("cap") / F.col("weight"))
    before = Window.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = ranked.withColumn("level", share)
    lowest = level.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "level"))).over(everything).level)
    return lowest.select("source", "source_size", "n_docs", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _pivot(size: list[float], frac: list[float], draw: list[float]) -> list[float]:
    """Rounded fractions; at most one stays open."""
    carry = -1
    for j in range(len(size)):
        if size[j] == 0:
            frac[j] = 0.0
        if not 0.0 < frac[j] < 1.0:
            continue
        if carry < 0:
            carry = j
            continue
        i = carry
        up = min((1 - frac[i]) * size[i], frac[j] * size[j])
        down = min(frac[i] * size[i], (1 - frac[j]) * size[j])
        move = up if draw[j] * (up + down) < down else -down
        for k, x in ((i, frac[i] + move / size[i]), (j, frac[j] - move / size[j])):
            frac[k] = 0.0 if x < _SNAP else 1.0 if x > 1 - _SNAP else x
        open_ = [k for k in (i, j) if 0.0 < frac[k] < 1.0]
        carry = open_[0] if open_ else -1
    return frac


def _draws(h: np.ndarray, level: int) -> np.ndarray:
    """Numbers in [0, 1) from hashes, new ones on each level of the tree."""
    x = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _round_group(table: pa.Table, level: int) -> pa.Table:
    h = table["h"].to_numpy().astype(np.uint64)
    order = np.lexsort((table["size"].to_numpy(), h))
    draw = _draws(h[order], level)
    done = np.empty(len(order))
    done[order] = _pivot(table["size"].to_numpy()[order].astype(float).tolist(), table["frac"].to_numpy()[order].tolist(), draw.tolist())
    return table.set_column(table.schema.get_field_index("frac"), "frac", pa.array(done))


def _rounding(level: int):
    return lambda table: _round_group(table, level)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: float = MOST, leaf: int = LEAF, fan: int = FAN, seed: int = SEED) -> DataFrame:
    """(doc_id, body, nth, source, size, source_size, target, copies, part, taken).

    ``copies`` whole copies and ``part`` further words make ``taken`` words. Null and empty texts have size 0 and take nothing; a null source is a source;
    repeated rows (equal id and text) are told apart by ``nth`` and rounded on their own; draws are hashes, so reruns agree.
    """
    packed = keyed(docs, id_col, text_col).select("doc_id", "body", F.col("row").getField(source_col).alias("source"), word_count(text_of(text_col)).alias("size"))
    numbered = packed.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "body").orderBy("source")).cast("long"))
    sized = store(numbered.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "body", "nth")))
    wanted = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    x = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))
    whole = F.floor(x + _SNAP).cast("long")
    rows = join_same(sized, wanted, ["source"]).withColumn("copies", whole).withColumn("frac", F.greatest(x - whole, F.lit(0.0)))
    buckets = F.greatest(F.ceil(F.col("n_docs") / leaf), F.lit(1)).cast("long")
    rows = rows.withColumn("frac", F.when(F.col("frac") < _SNAP, 0.0).otherwise(F.col("frac"))).withColumn("bucket", F.pmod("h", buckets)).withColumn("n_docs", buckets)
    parts = parts_for(sized.count(), 100_000)
    settled, depth, level = [], 0, store(rows.groupBy("source", "bucket").applyInArrow(_rounding(0), rows.schema), parts)
    n = level.agg(F.max("n_docs")).first()[0] or 1
    is_open = (F.col("frac") > 0) & (F.col("frac") < 1)
    while n > 1:
        settled.append(level.filter(~is_open))
        again = level.filter(is_open).withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long"))
        depth += 1
        level, n = store(again.groupBy("source", "bucket").applyInArrow(_rounding(depth), again.schema), parts), -(-n // fan)
    every = level
    for part in settled:
        every = every.unionByName(part)
    part = F.when(F.col("frac") < 1, F.round(F.col("frac") * F.col("size"))).otherwise(0).cast("long")
    copies = F.col("copies") + (F.col("frac") >= 1).cast("long")
    return every.select("doc_id", "body", "nth", "source", "size", "source_size", "target", copies.alias("copies"), part.alias("part")).withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mix itself: ``docs`` with a row for each copy, ``copy`` counting from 1, plus ``mix_words``, the words of the copy.

    The one open document of a source gives a last copy of its first ``part`` words, joined by one space.
    """
    key = key_of("doc_id", "body").alias("key")
    packed = keyed(docs, id_col, text_col).select(key, "row").withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.col("row").getField(source_col))))
    plan = mix(docs, id_col, text_col, source_col, **params).filter("taken > 0").select(key, F.col("nth").alias("wanted"), "size", "copies", "part")
    n = F.col("copies") + (F.col("part") > 0).cast("long")
    # the number is a condition beside the key, so that the rows stay where the window has put them
    pairs = packed.join(plan, "key").filter(F.col("nth") - F.col("wanted") == 0)
    rows = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).withColumn("text", text_of(text_col))
    short = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " ")
    whole = F.col("copy") <= F.col("copies")
    text = F.when(whole, F.col("text")).otherwise(short)
    return rows.select(*unpack(rows, docs.columns, **{text_col: text}), F.col("copy").alias("mix_copy"), F.when(whole, F.col("size")).otherwise(F.col("part")).alias("mix_words"))

"""Benchmark decontamination with a broadcast set of test n-grams.

The windows of the benchmark texts are collected in blocks of at most ``block`` (item, window) rows, so one broadcast has a fixed bound whatever the
size of the benchmark; each block scans every document in place, without a shuffle. A document word is mapped to the number it has in the
block's vocabulary, windows of these numbers are looked up by a rolling hash, and each hit is verified number by number.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tapeline.functions.lineage import parts_for, store
from tapeline.llm.common import unpack

WIDTH = 10
#: (item, window) rows of one broadcast; about 100 bytes each
BLOCK = 200_000

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
_LOWER = bytes(range(256)).lower()
_TABLE = bytes(b if b in _KEEP else 0x20 for b in _LOWER)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOKEN = re.compile(rb"[^ ]+")

HITS = StructType([
    StructField("n_words", LongType()), StructField("n_hit", LongType()),
    StructField("starts", ArrayType(IntegerType())), StructField("stops", ArrayType(IntegerType())), StructField("items", ArrayType(StringType())),
])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words(text: bytes | None) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of letters, digits and non-ASCII bytes."""
    return (text or b"").translate(_TABLE).split()


@arrow_udf(ArrayType(ArrayType(BinaryType())))
def _item_windows(text: pa.Array) -> pa.Array:
    found = []
    for t in text.to_pylist():
        w = words(t)
        found.append([w[i : i + WIDTH] for i in range(max(1, len(w) - WIDTH + 1))] if w else [])
    return pa.array(found, pa.list_(pa.list_(pa.binary())))


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, window): each distinct window of each item; an item shorter than a window is one window; null and empty items have none."""
    each = benchmark.select(F.col(id_col).cast("string").alias("item"), F.explode(_item_windows(F.col(text_col).cast("binary"))).alias("window"))
    return each.distinct()


class WindowSet:
    """Look-up tables of one block of windows."""

    def __init__(self, rows):
        self.items = sorted({item for item, _ in rows if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        self.known: dict[int, dict[bytes, set[int]]] = {}
        for item, window in rows:
            ids = np.array([self.vocabulary.setdefault(bytes(w), len(self.vocabulary) + 1) for w in window], np.int64)
            self.known.setdefault(len(ids), {}).setdefault(ids.tobytes(), set()).update([number[item]] if item is not None else [])
        self.keys = {n: np.unique(rolling(np.frombuffer(b"".join(k), np.int64).reshape(-1, n).ravel(), n)[::n]) for n, k in self.known.items()}

    def find(self, ids: np.ndarray):
        """(covered mask, item numbers) of a document given as vocabulary numbers, 0 for other words."""
        covered, items = np.zeros(len(ids), bool), set()
        for n, keys in self.keys.items():
            if len(ids) < n:
                continue
            key = rolling(ids, n)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            for i in np.flatnonzero(keys[at] == key).tolist():
                named = self.known[n].get(ids[i : i + n].tobytes())
                if named is not None:
                    covered[i : i + n] = True
                    items |= named
        return covered, items


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` numbers."""
    x = ids.astype(np.uint64)
    key = np.zeros(len(x) - n + 1, np.uint64)
    for j in range(n):
        key = (key ^ (key >> np.uint64(29))) * _MIX + x[j : len(x) - n + 1 + j]
    return key


def _scanner(shared):
    """Arrow UDF (text, earlier hits) -> hits with those of one block added."""

    @arrow_udf(HITS)
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        block, out = shared.value, []
        number = block.vocabulary.get
        for t, old in zip(text.to_pylist(), before.to_pylist(), strict=True):
            w = words(t)
            covered, items = block.find(np.fromiter((number(x, 0) for x in w), np.int64, len(w)))
            names = {block.items[i] for i in items}
            if old:
                names |= set(old["items"])
                for a, b in zip(old["starts"], old["stops"], strict=True):
                    covered[a:b] = True
            edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
            out.append({"n_words": len(w), "n_hit": int(covered.sum()), "starts": edges[::2].tolist(), "stops": edges[1::2].tolist(), "items": sorted(names)})
        return pa.array(out, _ARROW)

    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, hits): each input row with its word count, hit words, merged hit ranges (in words, stop exclusive) and items found.

    Null and empty texts have no words and no hits; items without an id hit but are not named; rows are independent, so repeated rows and null ids
    need no care. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    rows = store(item_windows(benchmark), parts_for(benchmark.count(), 5_000))
    blocks = max(1, -(-rows.count() // block))
    part = F.pmod(F.xxhash64("window"), F.lit(blocks))
    done = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("binary").alias("text"), F.lit(None).cast(HITS).alias("hits"))
    for i in range(blocks):
        if i:
            done = store(done)  # one block at a time in a worker's memory
        shared = spark.sparkContext.broadcast(WindowSet([(r["item"], r["window"]) for r in rows.filter(part == i).collect()]))
        done = done.withColumn("hits", _scanner(shared)("text", "hits"))
    return done.select("row", "hits")


def items_digest(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.array_sort(items)), 256)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = 0.0) -> DataFrame:
    """``docs`` without the documents of which more than ``share`` of the words are hit; the others are unchanged."""
    found = find_hits(docs, benchmark, text_col)
    return found.filter(F.col("hits.n_hit") <= F.lit(share) * F.col("hits.n_words")).select(*unpack(found, docs.columns))


@arrow_udf(StringType())
def _without(text: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    out = []
    for t, lo, hi in zip(text.to_pylist(), starts.to_pylist(), stops.to_pylist(), strict=True):
        if t is not None and lo:
            at, parts, spans = 0, [], [m.span() for m in _TOKEN.finditer(t.translate(_TABLE))]
            for a, b in zip(lo, hi, strict=True):
                parts.append(t[at : spans[a][0]])
                at = spans[b - 1][1]
            t = b"".join([*parts, t[at:]])
        out.append(None if t is None else t.decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the hit spans, from the first to the last hit word of each range, cut out of the texts."""
    found = find_hits(docs, benchmark, text_col)
    text = _without(F.col("row").getField(text_col).cast("binary"), F.col("hits.starts"), F.col("hits.stops"))
    return found.select(*unpack(found, docs.columns, **{text_col: text}))

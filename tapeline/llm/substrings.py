"""Substring dedup on a compacted De Bruijn graph of token k-mers.

The edges of the graph are the windows of ``length`` words; a window that starts at two places of the corpus is a repeated edge, and the words it covers
go everywhere. Edges are never listed one by one for the whole corpus:

1. Every window names an anchor, the least-hashed run of ``ANCHOR`` words in it. Consecutive windows with the same anchor form a segment, a short path
   of edges. Equal windows have equal anchors, so a repeated edge can only lie on segments whose anchor occurs twice.
2. An anchor seen with one segment content only is a nonbranching path: it compacts to one record, and all its edges are repeated. An anchor with
   several contents is a branching node. Joins on the anchor sort the segments into these classes and drop the rest.
3. On branching anchors, segments with equal content are repeated as they stand. One copy of each content is read again at its source
   coordinates and expanded into its edges, whose 128-bit content digests are counted: this finds the repeated parts of segments that occur once.
4. What is repeated goes back to source coordinates, overlapping pieces merge to long spans, and the spans are cut.

Contents are compared by a 64-bit anchor hash and an independent 64-bit content hash together. Hot anchors are counted with partial aggregates and met in
joins that adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tapeline.functions.lineage import store
from tapeline.llm.common import pieces, raw

LENGTH, ANCHOR = 35, 8
_LOW = np.uint64((1 << 20) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEED = 20_26
_PIECE = 1 << 19  # windows handled at once


@arrow_udf(BinaryType())
def _packed(text: pa.Array) -> pa.Array:
    """Texts as they travel through shuffles: each compressed on its own."""
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.array([pack(t) for t in raw(text)], pa.binary())


def _unpacked(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(t) for t in column.to_pylist()]


def _rolling(x: np.ndarray, n: int) -> np.ndarray:
    key = np.zeros(len(x) - n + 1, np.uint64)
    for j in range(n):
        key = (key ^ (key >> np.uint64(29))) * _MIX + x[j : len(x) - n + 1 + j]
    return key ^ (key >> np.uint64(32))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x, width = np.minimum(x[:-width], x[width:]), 2 * width
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if width < n else x


def _offsets(words: list[bytes]) -> np.ndarray:
    """Start of each word, and one past the end plus one, in the words joined by one space."""
    return np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))


def segments_of(text: bytes | None, length: int = LENGTH):
    """Per segment (anchor hash, content hash, first window, number of windows) of one text, as arrays."""
    words = (text or b"").split()
    if len(words) < length:
        return None
    x = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    line, at = b" ".join(words), _offsets(words)
    parts = []
    for base in range(0, len(words) - length + 1, _PIECE):
        k = _rolling(x[base : base + _PIECE + length - 1], ANCHOR)
        best = _sliding_min((k & ~_LOW) | np.arange(len(k), dtype=np.uint64), length - ANCHOR + 1)
        pos = (best & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
        n = np.diff(np.concatenate((first, [len(pos)])))
        lo = at[base + first].tolist()
        hi = (at[base + first + n + length - 1] - 1).tolist()
        content = np.array([xxhash.xxh3_64_intdigest(line[a:b], o) for a, b, o in zip(lo, hi, (pos[first] - first).tolist(), strict=True)], np.uint64)
        parts.append((k[pos[first]], content, base + first, n))
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _segment_rows(batches, length):
    for batch in pieces(batches):
        found, owner = [], []
        for i, text in enumerate(raw(batch.column("text"))):
            got = segments_of(text, length)
            if got is not None:
                found.append(got)
                owner.append(np.full(len(got[0]), i))
        if found:
            a, s, first, n = (np.concatenate(c) for c in zip(*found, strict=True))
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), batch.column("doc").take(take), batch.column("body").take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "content", "doc", "body", "first", "n"])


def _edge_rows(batches, length):
    """Digests of the windows of the listed segments of each text; ``weight`` 2 for a segment that is repeated as it stands."""
    for batch in pieces(batches):
        digests, owner, place, weight = [], [], [], []
        for i, (text, paths) in enumerate(zip(_unpacked(batch.column("text")), batch.column("paths").to_pylist(), strict=True)):
            words = text.split()
            line, at = b" ".join(words), _offsets(words)
            for p in paths:
                first, n = p["first"], p["n"]
                for lo, hi in zip(at[first : first + n].tolist(), (at[first + length : first + n + length] - 1).tolist(), strict=True):
                    digests.append(xxhash.xxh3_128_digest(line[lo:hi]))
                owner.append(np.full(n, i))
                place.append(np.arange(first, first + n, dtype=np.int32))
                weight.append(np.full(n, p["weight"], np.int32))
        if digests:
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            take = pa.array(np.concatenate(owner))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), batch.column("doc").take(take), batch.column("body").take(take), pa.array(np.concatenate(place)), pa.array(np.concatenate(weight))], ["w1", "w2", "doc", "body", "first", "weight"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, body, rest, text): two independent 64-bit hashes of id and text, which together name a document; the other columns; the text."""
    doc, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = F.struct(*[F.col(f"`{x}`") for x in docs.columns if x != text_col])
    known = F.coalesce(doc.cast("string"), F.lit("")), doc.isNull(), text, F.octet_length(text)
    return docs.select(F.xxhash64(*known).alias("doc"), F.xxhash64(F.lit(_SEED), *known).alias("body"), rest.alias("rest"), text.cast("binary").alias("text"))


def _covers(keyed: DataFrame, length: int) -> DataFrame:
    """(doc, body, first, stop): repeated word ranges at their source coordinates, not merged."""
    seg = keyed.select("doc", "body", "text").mapInArrow(lambda b: _segment_rows(b, length), "anchor long, content long, doc long, body long, first int, n int")
    # stored, so that both sides of the join are plain shuffles and a hot anchor can be split
    nodes = seg.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("low"), F.max("content").alias("high")).filter("c > 1").select("anchor", (F.col("low") != F.col("high")).alias("branching"))
    met = store(seg.join(store(nodes), "anchor"))
    branching = met.filter("branching")
    contents = branching.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct("doc", "body", "first", "n")).alias("at"))
    contents = store(contents)
    whole = branching.join(contents.filter("c > 1").select("anchor", "content"), ["anchor", "content"])
    paths = contents.select("at.doc", "at.body", F.struct("at.first", "at.n", F.least("c", F.lit(2)).cast("int").alias("weight")).alias("p")).groupBy("doc", "body").agg(F.collect_list("p").alias("paths"))
    expanded = keyed.select("doc", "body", _packed("text").alias("text")).join(paths, ["doc", "body"]).mapInArrow(lambda b: _edge_rows(b, length), "w1 long, w2 long, doc long, body long, first int, weight int")
    edges = store(expanded)
    repeated = edges.groupBy("w1", "w2").agg(F.sum("weight").alias("c")).filter("c > 1").select("w1", "w2")
    lone = edges.filter("weight = 1").join(store(repeated), ["w1", "w2"]).select("doc", "body", "first", (F.col("first") + length).alias("stop"))
    span = lambda df: df.select("doc", "body", "first", (F.col("first") + F.col("n") + (length - 1)).alias("stop"))
    return span(met.filter("not branching")).unionByName(span(whole)).unionByName(lone)


def _cut_rows(batches):
    for batch in pieces(batches):
        n_words, n_removed, starts, stops, text = [], [], [], [], []
        for t, ranges in zip(_unpacked(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
            words = t.split()
            gone = np.zeros(len(words) + 1, np.int8)
            edge = np.zeros(len(words) + 1, np.int64)
            if ranges:
                np.add.at(edge, [r["first"] for r in ranges], 1)
                np.add.at(edge, [r["stop"] for r in ranges], -1)
                gone = (np.cumsum(edge) > 0).astype(np.int8)
            turn = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            starts.append(turn[::2].tolist())
            stops.append(turn[1::2].tolist())
            text.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=False) if not g]) if ranges else b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array(text, pa.binary())], ["rest", "n_words", "n_removed", "starts", "stops", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(rest, n_words, n_removed, starts, stops, kept): one row for each input row.

    ``rest`` holds the columns other than the text, ``starts`` and ``stops`` the merged spans that go (in words, stop exclusive), ``kept`` the remaining words
    joined by one space. All occurrences go, the first included. Null, empty and short texts (fewer than ``length`` words) lose nothing. Repeated rows
    are documents of their own, so each repeats the other and both lose all windows. An empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    ranges = _covers(keyed, length).groupBy("doc", "body").agg(F.collect_set(F.struct("first", "stop")).alias("ranges"))
    joined = keyed.withColumn("text", _packed("text")).join(ranges, ["doc", "body"], "left").select("rest", "text", "ranges")
    spans = ArrayType(IntegerType())
    out = [keyed.schema["rest"], *[StructField(n, LongType()) for n in ("n_words", "n_removed")], *[StructField(n, spans) for n in ("starts", "stops")], StructField("kept", BinaryType())]
    cut = joined.mapInArrow(_cut_rows, StructType(out))
    return cut.withColumn("kept", F.col("kept").cast("string"))

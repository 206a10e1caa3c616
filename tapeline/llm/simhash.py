"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight positional bytes. Two fingerprints that differ in at most three bits agree in at least five of the eight, hence
in at least three of the four bytes of one half. A posting list therefore holds the fingerprints that share three positional bytes of one half
(eight lists per fingerprint; a list of one byte would hold 1/256 of any corpus). Inside a list the shared positional bytes of a pair are
tallied, pairs below the guaranteed five fall out, and the rest are verified bit by bit.

Only different fingerprints are indexed, so exact copies never meet. A list reports a spanning forest of its verified links: that keeps every
connection and never writes out all pairs of a group. A list longer than ``block`` is split by two more shared bytes (again a guaranteed match);
what then still exceeds ``block`` shares five bytes, has at most 2**24 members, and is linked by looking up each member's neighbours.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from tapeline.functions.lineage import cut, parts_for, store
from tapeline.llm.common import key_of, keyed, text_of, unpack
from tapeline.llm.graph import components

SHINGLE = 3
MAX_BITS = 3
LEAST_BYTES = 8 - MAX_BITS
BLOCK = 4096
_SLICE = 1 << 15  # shingles whose bits are counted at once

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None) -> int:
    """Unsigned fingerprint of a text; 0 if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = np.array([_hash(b" ".join(words))], np.uint64)
    else:
        line = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], stops[: len(words) - SHINGLE])).tolist()
        hashes = np.array([_hash(line[s:e]) for s, e in zip(starts, (stops[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        ones += np.unpackbits(hashes[at : at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


@pandas_udf(LongType())
def _fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in text], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col).cast("binary")).alias("fp"))


def _byte_mask(positions) -> int:
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


#: The bytes of each posting list: three of the four of a half.
LISTS = [tuple(p for p in range(4 * half, 4 * half + 4) if p != left_out) for half in (0, 1) for left_out in range(4 * half, 4 * half + 4)]


def postings(fps: DataFrame) -> DataFrame:
    """(list_no, shared, fp): one row for each fingerprint and posting list."""
    keys = [F.struct(F.lit(i).alias("list_no"), F.col("fp").bitwiseAND(F.lit(_byte_mask(p))).alias("shared")) for i, p in enumerate(LISTS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.list_no", "k.shared", "fp")


def _finer(posting: DataFrame) -> DataFrame:
    """Long lists cut by two more shared bytes; ``list_no`` above 255 tells which."""
    cuts = []
    for i, own in enumerate(LISTS):
        rest = [p for p in range(8) if p not in own]
        pairs = [F.struct(F.lit(256 * (1 + j) + i).alias("list_no"), F.col("fp").bitwiseAND(F.lit(_byte_mask((*own, *two)))).alias("shared")) for j, two in enumerate(combinations(rest, 2))]
        cuts.append(F.when(F.col("list_no") == i, F.array(*pairs)))
    return posting.select("fp", F.explode(F.coalesce(*cuts)).alias("k")).select("k.list_no", "k.shared", "fp")


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that share the guaranteed number of positional bytes and then pass the bit count."""
    x = a ^ b
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    ok = tally >= LEAST_BYTES
    ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
    return ok


def _merge(label: np.ndarray, lo: int, hi: int, i: int, j: int) -> bool:
    a, b = label[i], label[j]
    if a == b:
        return False
    part = label[lo:hi]
    part[part == max(a, b)] = min(a, b)
    return True


def forest(fp: np.ndarray, start: np.ndarray, stop: np.ndarray, block: int = BLOCK) -> list[tuple[int, int]]:
    """Index pairs that link the runs ``start[i]:stop[i]`` (per element i) of equal lists; runs longer than ``block`` share five bytes."""
    label, links = np.arange(len(fp)), []
    left = np.flatnonzero((stop - start > 1) & (stop - start <= block))
    shift = 1
    while len(left := left[left + shift < stop[left]]):
        for at in range(0, len(left), 1 << 18):
            i = left[at : at + (1 << 18)]
            i = i[_verified(fp[i], fp[i + shift])]
            links += [(a, a + shift) for a in i[label[i] != label[i + shift]].tolist() if _merge(label, start[a], stop[a], a, a + shift)]
        shift += 1
    for lo in np.unique(start[stop - start > block]).tolist():
        links += _neighbours(fp, lo, int(stop[lo]))
    return links


def _neighbours(fp: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Links of one long run: its members differ in three bytes only, so a table over these finds each neighbour directly."""
    own = fp[lo:hi].view(np.uint8).reshape(-1, 8)
    free = [p for p in range(8) if (own[:, p] != own[0, p]).any()]
    code = np.zeros(len(own), np.int64)
    for p in free:
        code = code << 8 | own[:, p]
    table = np.full(1 << 8 * len(free), -1, np.int32)
    table[code] = np.arange(len(code))
    label, links = np.arange(len(code)), []
    for n in range(1, MAX_BITS + 1):
        for flipped in combinations(range(8 * len(free)), n):
            near = table[code ^ sum(1 << f for f in flipped)]
            here = np.flatnonzero((near >= 0) & (label != label[near]))
            while len(here):  # hook the larger label to the smaller one, then look again
                a, b = label[here], label[near[here]]
                high, low = np.maximum(a, b), np.minimum(a, b)
                top, first = np.unique(high, return_index=True)
                links += list(zip((lo + here[first]).tolist(), (lo + near[here[first]]).tolist(), strict=True))
                to = np.arange(len(code))
                to[top] = low[first]
                while (to[to] != to).any():
                    to = to[to]
                label = to[label]
                here = here[label[here] != label[near[here]]]
    return links


def _link_lists(batches, block: int):
    """Link runs of equal (list_no, shared) in sorted batches; an unfinished run is carried to the next batch."""
    rest = None

    def linked(n, key, fp):
        cut_at = np.flatnonzero((n[1:] != n[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate(([0], cut_at, [len(n)]))
        lengths = np.diff(bounds)
        pairs = forest(fp, np.repeat(bounds[:-1], lengths), np.repeat(bounds[1:], lengths), block)
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[ends[:, 0]]), pa.array(fp[ends[:, 1]])], ["a", "b"])

    for batch in batches:
        now = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        if not len(now[0]):
            continue
        if rest is not None:
            now = [np.concatenate(p) for p in zip(rest, now, strict=True)]
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        done = int(len(last) - last.sum())
        if done:
            yield linked(*[c[:done] for c in now])
        rest = [c[done:] for c in now]
    if rest is not None:
        yield linked(*rest)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links between different fingerprints, enough to connect all that are linked."""
    posting = postings(fps)
    lists = posting.groupBy("list_no", "shared").agg(F.count("*").alias("n")).filter("n > 1")
    sized = posting.join(lists, ["list_no", "shared"])
    short = sized.filter(F.col("n") <= block).drop("n")
    both = short.unionByName(_finer(sized.filter(F.col("n") > block)))
    runs = both.repartition("list_no", "shared").sortWithinPartitions("list_no", "shared", "fp").select("list_no", "shared", "fp")
    return runs.mapInArrow(lambda batches: _link_lists(batches, block), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint and the smallest doc_id that links of at most three bits reach.

    One row for each input row, repeated rows included. Null and empty texts have fingerprint 0 and are linked like any other. A null id is ignored
    by the minimum; a component of null ids only has a null component_id.
    """
    marked = store(fingerprints(docs, id_col, text_col))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    classes = _rooted(fps, marked.count(), block)
    named = classes.join(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def _rooted(fps: DataFrame, rows: int, block: int) -> DataFrame:
    """``fps`` (one row for each fingerprint) with the ``root`` of its component."""
    roots = components(links(fps.select("fp"), block)).withColumnRenamed("node", "fp")
    return cut(fps.join(roots, "fp", "left").select(*fps.columns, F.coalesce("root", "fp").alias("root")), parts_for(rows))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), and of repeated ids the smallest text hash.

    Components of null ids only keep one row each. Components that share their smallest doc_id keep one row together, so ids stay unique.
    """
    packed = keyed(docs, id_col, text_col)
    marked = store(packed.select("doc_id", "body", _fingerprints(text_of(text_col).cast("binary")).alias("fp")))
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("body").isNull().alias("no_text"), "body")
    fps = marked.groupBy("fp").agg(F.min(least).alias("least"))
    roots = _rooted(fps, marked.count(), block).groupBy("root").agg(F.min("least").alias("least"))
    first = roots.groupBy("least.doc_id", F.when(F.col("least.no_id"), F.col("root")).alias("root")).agg(F.min("least").alias("least")).select(key_of("least.doc_id", "least.body").alias("key"))
    chosen = packed.select(key_of("doc_id", "body").alias("key"), "row").join(first, "key", "left_semi")
    numbered = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0))))
    return numbered.filter("nth = 1").select(*unpack(numbered, docs.columns))

"""Ranked lexical search over a document FP-tree.

Every document becomes the vector of its terms that occur in items (term numbers and counts). Ordered by falling document frequency, these vectors
are paths of a prefix tree: documents that agree on their most frequent terms share the path, equal vectors share all of it. A task grows one
tree for each ``postings`` term counts that it reads and walks it depth first, with all items of a group at once. A node knows, for its subtree,
the largest count of each term and the least length measure ``m``; with them the score formula gives a bound that no document below can exceed. An
item leaves a subtree as soon as the bound falls below its ``top``-th best score so far, which it carries from tree to tree. What is left of
each task, ``top`` rows an item, is ranked by Spark.

Items come in blocks of about ``block`` (item, term) rows, so that a broadcast has a fixed bound whatever the number of items.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tapeline.functions.lineage import parts_for, store
from tapeline.llm.common import pieces, raw
from tapeline.llm.decontaminate import words

TOP = 20
#: (item, term) rows of one broadcast; about 50 bytes each
BLOCK = 200_000
#: term counts of one tree
POSTINGS = 600_000
#: documents that are scored one by one
LEAF = 32
#: cells of the weight table of one group of items
CELLS = 2_000_000
_SCALE = 1_000_000_000


@arrow_udf(ArrayType(BinaryType()))
def _terms(text: pa.Array) -> pa.Array:
    return pa.array([words(t) for t in raw(text)], pa.list_(pa.binary()))


def part_of_score(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """What one unit of a term's weight gives: rises with ``tf``, falls with ``m``, below 1,000,000."""
    return (_SCALE * tf) // (1000 * tf + 12 * m)


class Items:
    """The items of one block: term numbers and counts; with the corpus figures also weights and the order of terms."""

    def __init__(self, rows):
        self.number: dict[bytes, int] = {}
        self.terms = defaultdict(list)
        for item, term, c in rows:
            self.terms[item].append((self.number.setdefault(bytes(term), len(self.number)), c))

    def weigh(self, df: dict[int, int], n_docs: int, length: int):
        """``df`` by term number; ``n_docs`` documents hold a term, ``length`` is the number of their terms."""
        self.n_docs, self.length = n_docs, max(length, 1)
        counts = np.array([df.get(t, 0) for t in range(len(self.number))], np.int64)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for c in counts.tolist()], np.int64)
        by_frequency = np.lexsort((np.arange(len(counts)), -counts))
        self.place = np.empty(len(counts), np.int64)  # of a term in the order of paths
        self.place[by_frequency] = np.arange(len(counts))
        return self

    def groups(self):
        """Groups of items with a weight table each: (items, column of each place, table); columns of no item are the last, all zero."""
        group, seen = [], set()
        for item, terms in self.terms.items():
            more = seen.union(t for t, _ in terms)
            if group and (len(group) + 1) * (len(more) + 1) > CELLS:
                yield self._table(group, seen)
                group, more = [], {t for t, _ in terms}
            group.append(item)
            seen = more
        if group:
            yield self._table(group, seen)

    def _table(self, group, seen):
        own = np.array(sorted(seen), np.int64)
        column = np.full(len(self.number), len(own), np.int64)
        column[self.place[own]] = np.arange(len(own))
        table = np.zeros((len(group), len(own) + 1), np.int64)
        for i, item in enumerate(group):
            t, c = np.array(self.terms[item], np.int64).T
            table[i, column[self.place[t]]] = c * self.weight[t]
        table = table.T.copy()
        # sums of doubles are exact below 2^53, and faster
        return group, column, table.astype(np.float64) if table.sum(0).max() * 1_000_000 < 1 << 53 else table


class Tree:
    """FP-tree of a run of documents, in nested ranges of their sorted vectors.

    ``start`` cuts ``place`` and ``tf`` into the vectors, each with rising places. Documents equal in vector and ``m`` are one entry with their
    ``top`` least ids: they tie in every score. A node is a range of entries with a common prefix; single paths are compacted, and neighbours that
    leave a path with less than ``LEAF`` entries each share a leaf.
    """

    def __init__(self, ids: list, start: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray, top: int):
        paths, tfs = place.astype(">u4").tobytes(), tf.astype(">i8").tobytes()
        found = defaultdict(list)
        for i, (a, b, measure) in enumerate(zip(start[:-1].tolist(), start[1:].tolist(), m.tolist(), strict=True)):
            found[paths[4 * a : 4 * b], tfs[8 * a : 8 * b], measure].append(i)
        keys = sorted(found)
        self.ids = [sorted((ids[i] for i in found[k]), key=by_id)[:top] for k in keys]
        first = np.array([found[k][0] for k in keys], np.int64)
        size = (start[1:] - start[:-1])[first]
        self.start = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(start[first] - self.start[:-1], size) + np.arange(self.start[-1])
        self.place, self.tf, self.m = place[take], tf[take], m[first]
        self.gain = part_of_score(self.tf, np.repeat(self.m, size))
        self.nodes = self._grow([k[0] for k in keys])
        self._summarise()

    def _grow(self, path: list[bytes]):
        """(lo, hi, children) of every node, parents before children."""
        nodes, open_ = [(0, len(path), [])], [(0, 0)]
        while open_:
            node, depth = open_.pop()
            lo, hi, children = nodes[node]
            if hi - lo <= LEAF:
                continue
            low, high = path[lo], path[hi - 1]
            while depth < len(low) and low[depth : depth + 4] == high[depth : depth + 4]:
                depth += 4
            if depth >= len(low) and low == high:
                continue  # one vector with several lengths of documents
            cuts, at = [lo], lo
            while at < hi:
                here = path[at][depth : depth + 4]
                stop = _end_of_run(path, at, hi, depth, here)
                if stop - at > LEAF or stop - cuts[-1] > LEAF:
                    if at > cuts[-1]:
                        cuts.append(at)
                    if stop - at > LEAF:
                        cuts.append(stop)
                at = stop
            if cuts[-1] < hi:
                cuts.append(hi)
            for a, b in zip(cuts, cuts[1:]):
                children.append(len(nodes))
                open_.append((len(nodes), depth))
                nodes.append((a, b, []))
        return nodes

    def _summarise(self):
        """Per node: its terms, the largest count of each, the least ``m``; leaves also get the dense scores of their entries."""
        n = len(self.nodes)
        self.terms, self.most, self.least = [None] * n, [None] * n, [0] * n
        for k in range(n - 1, -1, -1):
            lo, hi, children = self.nodes[k]
            if children:
                terms, most = np.concatenate([self.terms[c] for c in children]), np.concatenate([self.most[c] for c in children])
            else:
                terms, most = self.place[self.start[lo] : self.start[hi]], self.tf[self.start[lo] : self.start[hi]]
            order = np.argsort(terms, kind="stable")
            sorted_ = terms[order]
            head = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
            self.terms[k], self.most[k] = sorted_[head], np.maximum.reduceat(most[order], head)
            self.least[k] = min(self.least[c] for c in children) if children else int(self.m[lo:hi].min())
        self.bound = [part_of_score(most, least) for most, least in zip(self.most, self.least, strict=True)]

    def search(self, table: np.ndarray, column: np.ndarray, best: list[list], top: int) -> None:
        """Adds to ``best``, a list for each item with its ``top`` best (-score, id order, id); ``table`` has a row for each column number."""
        worst = np.array([-b[-1][0] if len(b) == top else 1 for b in best], table.dtype)
        blank, n_items = len(table) - 1, table.shape[1]

        def weights(c, items):
            return table[c] if 2 * len(items) > n_items else table[np.ix_(c, items)]

        def bounds(k, items):
            c = column[self.terms[k]]
            own = c < blank
            ub = self.bound[k][own].astype(table.dtype) @ weights(c[own], items)
            return ub if len(ub) == len(items) else ub[items]

        every = np.arange(n_items)
        stack = [(0, every, bounds(0, every))]
        while stack:
            k, items, ub = stack.pop()
            items = items[ub >= worst[items]]
            if not len(items):
                continue
            lo, hi, children = self.nodes[k]
            if children:
                below = [(c, items, bounds(c, items)) for c in children]
                stack += sorted(below, key=lambda x: x[2].sum())  # the most promising is popped first
                continue
            a, b = self.start[lo], self.start[hi]
            c = column[self.terms[k]]
            own = np.flatnonzero(c < blank)
            dense = np.zeros((len(self.terms[k]), hi - lo), table.dtype)
            dense[np.searchsorted(self.terms[k], self.place[a:b]), np.repeat(np.arange(hi - lo), np.diff(self.start[lo : hi + 1]))] = self.gain[a:b]
            w = weights(c[own], items)
            scores = (w if w.shape[1] == len(items) else w[:, items]).T @ dense[own]
            for i in np.flatnonzero(scores.max(1) >= worst[items]).tolist():
                item = int(items[i])
                hits = np.flatnonzero(scores[i] >= worst[item])
                new = [(-int(scores[i, e]), by_id(x), x) for e in hits.tolist() for x in self.ids[lo + e]]
                best[item] = sorted(best[item] + new, key=lambda x: x[:2])[:top]
                if len(best[item]) == top:
                    worst[item] = -best[item][-1][0]


def _end_of_run(path, lo, hi, depth, here):
    """End of the run of paths from ``lo`` on that go on with ``here``: doubling steps, then bisection."""
    step = 1
    while lo + step < hi and path[lo + step][depth : depth + 4] == here:
        step *= 2
    a, b = lo + step // 2, min(lo + step, hi)
    while a + 1 < b:
        mid = (a + b) // 2
        a, b = (mid, b) if path[mid][depth : depth + 4] == here else (a, mid)
    return b


def by_id(x):
    """Order of document ids: ascending, null last."""
    return (x is None, 0 if x is None else x)


def _restricted(batches, shared):
    """(doc, n, terms, tf): the number of terms of each document, and the numbers and counts of those that occur in items."""
    number = shared.value.number.get
    for batch in pieces(batches):
        take, n, terms, tf, start = [], [], [], [], [0]
        for i, text in enumerate(raw(batch.column("text"))):
            w = words(text)
            if w:
                found = Counter(map(number, w))
                found.pop(None, None)
                take.append(i)
                n.append(len(w))
                terms += found.keys()
                tf += found.values()
                start.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(take, pa.int32())), pa.array(n, pa.int64()), *lists], ["doc", "n", "terms", "tf"])


def _searched(batches, shared, top, postings):
    """(item, doc, score): the ``top`` best of each item among the rows of a task."""
    items = shared.value
    groups = [(*g, [[] for _ in g[0]]) for g in items.groups()]
    waiting, held, doc_type = [], 0, pa.null()

    def flush():
        ids = [x for batch in waiting for x in batch.column("doc").to_pylist()]
        n = np.concatenate([batch.column("n").to_numpy() for batch in waiting])
        flat = lambda c: np.concatenate([batch.column(c).flatten().to_numpy(zero_copy_only=False) for batch in waiting]).astype(np.int64)
        size = np.concatenate([batch.column("terms").value_lengths().to_numpy(zero_copy_only=False) for batch in waiting])
        place, owner = items.place[flat("terms")], np.repeat(np.arange(len(size)), size)
        order = np.lexsort((place, owner))
        m = 75 + (25 * n * items.n_docs) // items.length
        tree = Tree(ids, np.concatenate(([0], np.cumsum(size))), place[order], flat("tf")[order], m, top)
        for _, column, table, best in groups:
            tree.search(table, column, best, top)

    for batch in batches:
        doc_type = batch.schema.field("doc").type
        # pieces of a batch, so that a tree stays near its bound
        ends = np.cumsum(batch.column("terms").value_lengths().to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + postings - held, "right")))
            waiting.append(batch.slice(at, stop - at))
            held += int(ends[stop - 1]) - done
            at = stop
            if held >= postings or at < batch.num_rows:
                flush()
                waiting, held = [], 0
    if waiting:
        flush()
    for group, _, _, best in groups:
        rows = [(item, x, -score) for item, found in zip(group, best, strict=True) for score, _, x in found]
        if rows:
            item, doc, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, doc_type), pa.array(score, pa.int64())], ["item", "doc", "score"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", top: int = TOP, block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and non-ASCII characters. Null and empty texts have no terms: such documents count nowhere and such items
    get no rows; documents with a score of 0 are left out. Equal scores go by ascending document id, null last. Repeated rows of ``docs`` are documents
    of their own; items equal in id and text are one item, equal ids with different texts are ranked each on their own. An empty table
    on either side gives no rows. Other columns are not read. A very long text is held once, as words, in its task.
    The corpus figures are counted when the frame is built.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item_id_col).alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    own = store(own.withColumn("item", F.xxhash64("item_id", "text")), parts_for(items.count(), 50_000))
    rows = store(own.select("item", F.explode(_terms("text")).alias("term")).groupBy("item", "term").agg(F.count("*").alias("c")), parts_for(items.count(), 5_000))
    blocks = max(1, -(-rows.count() // block))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    key = texts.schema["doc"]
    found = None
    for i in range(blocks):
        known = Items((r["item"], r["term"], r["c"]) for r in rows.filter(F.pmod("item", F.lit(blocks)) == i).collect())
        shared = spark.sparkContext.broadcast(known)
        numbers = ArrayType(IntegerType())
        vectors = store(texts.mapInArrow(lambda b, s=shared: _restricted(b, s), StructType([key, StructField("n", LongType()), StructField("terms", numbers), StructField("tf", numbers)])))
        n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
        df = {r["t"]: r["count"] for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # one row for each term of the block
        weighed = spark.sparkContext.broadcast(known.weigh(df, n_docs, length or 0))
        best = vectors.filter(F.size("terms") > 0).mapInArrow(lambda b, s=weighed: _searched(b, s, top, postings), StructType([StructField("item", LongType()), key, StructField("score", LongType())]))
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(own.select("item", "item_id"), "item").select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


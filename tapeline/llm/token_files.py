"""Token ids in binary shards with a minimal perfect hash index.

A folder holds raw id payloads and an index for keyed access:

``ids/*``  one file for each shard, documents in ascending order of their keys: 8 bytes ``MAGIC``, the ids of all documents one after the other as little-endian
    unsigned integers of 2 or 4 bytes, the ends of the documents (64-bit, in ids), then width, number of documents and number of ids (64-bit each).
``index/*``  one file for each bucket of keys: a minimal perfect hash (levels of bits, each key sits on the first level where it meets no other key;
    its slot is the number of bits before its own), and by slot a 64-bit fingerprint, shard, ordinal of the document in the shard, and how many
    documents with this key follow one another there.
``shards``, ``buckets``  Parquet manifests of the files that count. A task that is run again writes a file of its own name; only that of the attempt that Spark
    kept is listed.

A key that has documents in several shards has one entry for each, numbered from 0; entry 0 knows how many there are.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tapeline.functions.lineage import store
from tapeline.llm.common import pieces, raw

MAGIC = b"TAPEIDS1"
#: text bytes of a shard, and keys of an index file
SHARD, BUCKET = 32 << 20, 1 << 16
#: bits of a level for each key that is still without a place
GAMMA = 2
_CACHED = 400_000  # words of a generation whose ids a worker remembers
_LINE = 200  # words encoded at once
_TAIL = b".,;:!?)\"]}"
_LETTERS = set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FLUSH = 8 << 20
_TRAILER = 24


def _open(path: str):
    """(file system, path) of a folder in any store that pyarrow reads."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)


# ---------------------------------------------------------------- token ids


class WordIds:
    """Ids of words as little-endian integers, for tokenizers that drop white space and split there first.

    A word that a worker meets again is not encoded again: the ids of the last words are kept in two generations of at most ``_CACHED`` words, and what is
    used moves to the younger one. ASCII punctuation behind an ASCII letter, which such tokenizers split off, is encoded on its own. If the model marks
    ends of words, words of Latin letters are encoded many to a line and parted at the marks.
    """

    def __init__(self, tokenizer, kind: np.dtype):
        self.tokenizer, self.kind = tokenizer, kind
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        mark = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if mark:
            self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith(mark)]] = True

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The table of ids, with all of ``words`` in it."""
        if len(self.young) > _CACHED:
            self.old, self.young = self.young, {}
        known = self.young
        new = self._kept(words)
        cut = []
        for w in [w for w in new if not w.isalpha()]:
            core = w.rstrip(_TAIL)
            if core and core[-1] in _LETTERS and len(core) < len(w):
                cut.append((w, core, w[len(core) :]))
        new.difference_update([w for w, *_ in cut])
        self._encode(list(new | self._kept({p for _, *both in cut for p in both})))
        for w, core, tail in cut:
            known[w] = known[core] + known[tail]
        return known

    def _kept(self, words: set[bytes]) -> set[bytes]:
        """Those of ``words`` that neither generation has; what the older has goes to the younger."""
        new = words.difference(self.young)
        again = new.intersection(self.old)
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        return new - again

    def _encode(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode().split("\n") if words else []  # words hold no white space of ASCII
        latin = [self.ends is not None and t.isalpha() and (t.isascii() or max(t) <= "\xff") for t in text]
        known, size = self.young, self.kind.itemsize
        keys, plain = list(compress(words, latin)), list(compress(text, latin))
        lines = [" ".join(plain[i : i + _LINE]) for i in range(0, len(plain), _LINE)]
        for i in range(0, len(lines), 50):
            for j, e in enumerate(self.tokenizer.encode_batch_fast(lines[i : i + 50], add_special_tokens=False), i):
                line, ids = keys[j * _LINE : (j + 1) * _LINE], np.array(e.ids)
                stops = ((np.flatnonzero(self.ends[ids]) + 1) * size).tolist()
                if len(stops) != len(line):
                    raise ValueError("the tokenizer does not end every word with its mark")
                data = ids.astype(self.kind).tobytes()
                known.update(zip(line, map(data.__getitem__, map(slice, [0, *stops], stops))))
        other = [not x for x in latin]
        for w, e in zip(compress(words, other), self.tokenizer.encode_batch_fast(list(compress(text, other)), add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, self.kind).tobytes()


@cache
def _tokenizer(path: str, width: int) -> WordIds:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    return WordIds(Tokenizer.from_file(path), np.dtype(f"<u{width}"))


def token_ids(texts: pa.Array, path: str, end: int, width: int, by_word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, the end id after each, one after the other, and how many each text has; ``by_word`` as for ``WordIds``, else texts are encoded whole."""
    words = _tokenizer(path, width)
    if not by_word:
        whole = [np.array([*e.ids, end], words.kind) for e in words.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, words.kind), *whole]), np.array([len(x) for x in whole], np.int64)
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    each = split.flatten().dictionary_encode()
    distinct = raw(each.dictionary)
    known = words.learn(set(distinct))
    own = [known[w] for w in distinct] + [np.array([end], words.kind).tobytes()]
    size = np.fromiter(map(len, own), np.int64, len(own)) // width
    first, ids = np.cumsum(size) - size, np.frombuffer(b"".join(own), words.kind)
    stop = np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))
    codes = np.insert(each.indices.to_numpy(zero_copy_only=False).astype(np.int64), stop, len(distinct))
    n = size[codes]
    at = np.repeat(first[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())
    total = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], stop + np.arange(1, len(stop) + 1)))]
    return ids[at], np.diff(total)


def _write_shard(batches, folder, path, end, width, by_word):
    """Writes the ids of a task's documents; (doc, shard, file, ordinal, docs, ids) for each run of equal keys."""
    shard, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.ids"
    system, root = _open(folder)
    out, ends, n, run = None, [], 0, None
    for batch in pieces(batches):
        keys, rows = batch.column("doc").to_pylist(), []
        ids, sizes = token_ids(batch.column("text"), path, end, width, by_word)
        if out is None:
            out = system.open_output_stream(f"{root}/ids/{name}")
            out.write(MAGIC)
        out.write(ids.tobytes())
        for key, size in zip(keys, sizes.tolist(), strict=True):
            if run is None or run[0] != key:
                rows += [run] if run else []
                run = [key, len(ends), 0, 0]
            n += size
            ends.append(n)
            run[2] += 1
            run[3] += size
        yield _run_rows(batch, shard, name, rows)
    if out is not None:
        yield _run_rows(batch, shard, name, [run])
        out.write(np.array(ends, "<u8").tobytes())
        out.write(np.array([width, len(ends), n], "<u8").tobytes())
        out.close()


def _run_rows(batch, shard, name, rows):
    key, ordinal, docs, ids = zip(*rows, strict=True) if rows else ((),) * 4
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(key, batch.schema.field("doc").type), pa.array([shard] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(ordinal, pa.int64()), pa.array(docs, pa.int64()), pa.array(ids, pa.int64())], ["doc", "shard", "file", "ordinal", "docs", "ids"])


# ---------------------------------------------------------------- minimal perfect hash


def _mixed(h: np.ndarray, fp: np.ndarray, level: int) -> np.ndarray:
    x = h + fp * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0 to n - 1 for n keys, each given by two 64-bit hashes; keys outside the set get any slot or -1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))
        self.first = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def build(cls, h: np.ndarray, fp: np.ndarray) -> PerfectHash:
        sizes, bits = [], []
        while len(h):
            if len(sizes) == 200:
                raise ValueError("two different keys share a 128-bit hash")
            size = -(-GAMMA * len(h) // 64) * 64
            at = (_mixed(h, fp, len(sizes)) % np.uint64(size)).astype(np.int64)
            level = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(level, bitorder="little").view("<u8"))
            h, fp = h[~level[at]], fp[~level[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits).astype(np.uint64) if bits else np.zeros(0, np.uint64))

    def slots(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        found, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            at = (_mixed(h[open_], fp[open_], level) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = ((word >> bit) & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            found[open_[here]] = (self.before[at >> 6] + below)[here]
            open_ = open_[~here]
        return found


_FIELDS = ("fp", "shard", "ordinal", "docs", "runs")


def _index_bytes(table: pa.Table) -> bytes:
    h, fp = (table[c].to_numpy().view(np.uint64) for c in ("h", "fp"))
    hashed = PerfectHash.build(h, fp)
    order = np.argsort(hashed.slots(h, fp))
    columns = [table[c].to_numpy().astype("<i8")[order].tobytes() for c in _FIELDS]
    return b"".join([np.array([len(h), len(hashed.sizes)], "<u8").tobytes(), hashed.sizes.astype("<i8").tobytes(), hashed.words.astype("<u8").tobytes(), *columns])


class Index:
    """One index file in memory."""

    def __init__(self, content: bytes):
        n, levels = np.frombuffer(content, "<u8", 2).astype(int).tolist()
        sizes = np.frombuffer(content, "<i8", levels, 16)
        at = 16 + 8 * levels
        words = np.frombuffer(content, "<u8", int(sizes.sum()) // 64, at)
        at += 8 * len(words)
        self.hash = PerfectHash(sizes, words)
        self.columns = {c: np.frombuffer(content, "<i8", n, at + 8 * n * i) for i, c in enumerate(_FIELDS)}

    def find(self, h: np.ndarray, fp: np.ndarray):
        """(places of the keys that are known, their slots)."""
        slots = self.hash.slots(h, fp)
        known = np.flatnonzero(slots >= 0)
        known = known[self.columns["fp"][slots[known]] == fp[known].view(np.int64)]
        return known, slots[known]


def _hashes(key, run: int) -> tuple[int, int]:
    text = b"\x00" if key is None else str(key).encode()
    return xxhash.xxh64_intdigest(text, run), xxhash.xxh3_64_intdigest(text, run)


def _hashed(batches, buckets):
    """Rows with the two hashes of (doc, run) and their bucket."""
    for batch in batches:
        both = np.array([_hashes(*x) for x in zip(batch.column("doc").to_pylist(), batch.column("run").to_pylist(), strict=True)], np.uint64).reshape(-1, 2)
        bucket = (both[:, 0] % np.uint64(buckets)).astype(np.int32)
        more = [np.ascontiguousarray(both[:, i]).view(np.int64) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, more), pa.array(bucket)], [*batch.schema.names, "h", "fp", "bucket"])


def _with_hashes(rows: DataFrame, buckets: int) -> DataFrame:
    more = [StructField("h", LongType()), StructField("fp", LongType()), StructField("bucket", IntegerType())]
    return rows.mapInArrow(lambda b: _hashed(b, buckets), StructType([*rows.schema, *more]))


# ---------------------------------------------------------------- folders


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, id_col: str = "doc_id", text_col: str = "text", by_word: bool = False, shard: int = SHARD, bucket: int = BUCKET) -> None:
    """Writes the ids of all texts to ``folder``, in ascending order of ``id_col`` (null first), and their index.

    ``tokenizer`` is a file of the tokenizers library, ``end`` the id after each document, ``shard`` the text bytes of a file and ``bucket`` the keys of an index file.
    Null and empty texts have the end id only. Repeated ids are documents of their own, by text hash and then by place in the input; one id with very
    many documents is cut into shards like any others. Other columns are not read. An empty table makes a folder without files. A very long text is
    encoded in one piece by one task and makes its shard larger.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    system, root = _open(folder)
    for part in ("ids", "index"):
        system.create_dir(f"{root}/{part}", recursive=True)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = max(1, -(-(texts.agg(F.sum(F.octet_length("text")).cast("long")).first()[0] or 0) // shard))
    order = [F.col("doc").asc_nulls_first(), F.col("h"), F.col("place")]
    placed = texts.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc", "text")
    numbers = [StructField(n, LongType()) for n in ("ordinal", "docs", "ids")]
    shape = StructType([texts.schema["doc"], StructField("shard", IntegerType()), StructField("file", StringType()), *numbers])
    runs = store(ranged.mapInArrow(lambda b: _write_shard(b, folder, tokenizer, end, width, by_word), shape))
    totals = runs.groupBy("shard", "file").agg(F.sum("ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    totals.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids").write.parquet(f"{folder}/shards")
    of_key = Window.partitionBy("doc")
    entries = runs.select("doc", "shard", "ordinal", "docs", F.count("*").over(of_key).alias("runs"), (F.row_number().over(of_key.orderBy("shard")) - 1).alias("run"))
    buckets = max(1, -(-runs.count() // bucket))
    keyed = _with_hashes(entries, buckets).select("bucket", "h", *_FIELDS)
    written = keyed.groupBy("bucket").applyInArrow(lambda t: _write_index(t, folder), "bucket int, file string, buckets int")
    written.select("bucket", "file", F.lit(buckets).alias("buckets")).write.parquet(f"{folder}/buckets")


def _write_index(table: pa.Table, folder: str) -> pa.Table:
    system, root = _open(folder)
    name = f"{uuid.uuid4().hex}.mph"
    with system.open_output_stream(f"{root}/index/{name}") as out:
        out.write(_index_bytes(table))
    return pa.table({"bucket": table["bucket"][:1], "file": pa.array([name], pa.string()), "buckets": pa.array([0], pa.int32())})


def _looked_up(batches, folder):
    """(doc, run, shard, ordinal, docs, runs) of the keys that the index files know."""
    system, root = _open(folder)
    held = (None, None)
    for batch in batches:
        names = np.array(batch.column("file").to_pylist(), object)
        cuts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True]))).tolist() if len(names) else []
        for a, b in zip(cuts, cuts[1:]):
            if held[0] != names[a]:
                with system.open_input_file(f"{root}/index/{names[a]}") as source:
                    held = (names[a], Index(source.read()))
            part = batch.slice(a, b - a)
            h, fp = (part.column(c).to_numpy().view(np.uint64) for c in ("h", "fp"))
            known, slots = held[1].find(h, fp)
            own = part.take(pa.array(known))
            yield pa.RecordBatch.from_arrays([own.column("doc"), own.column("run"), *[pa.array(held[1].columns[c][slots]) for c in _FIELDS[1:]]], ["doc", "run", *_FIELDS[1:]])


def locate(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc, run, shard, ordinal, docs, runs): where the documents of each key of ``keys(doc)`` lie; unknown keys have no rows."""
    files = spark.read.parquet(f"{folder}/buckets")
    found = files.agg(F.max("buckets")).first()[0]
    numbers = [StructField("run", IntegerType())] + [StructField(c, LongType()) for c in _FIELDS[1:]]
    shape = StructType([keys.schema["doc"], *numbers])

    def look(rows):
        hashed = _with_hashes(rows, found or 1).join(files.select("bucket", "file"), "bucket")
        return hashed.repartition("bucket").sortWithinPartitions("bucket").select("doc", "run", "h", "fp", "file").mapInArrow(lambda b: _looked_up(b, folder), shape)

    first = store(look(keys.select("doc").distinct().withColumn("run", F.lit(0))))
    more = first.filter("runs > 1").select("doc", F.explode(F.sequence(F.lit(1), F.col("runs").cast("int") - 1)).alias("run"))
    return first.unionByName(look(more))


def _payloads(batches, folder):
    """(doc_id, start, n_tokens, ids as 32-bit integers) of each document at the given places."""
    system, root = _open(folder)
    name, source, ends, width = None, None, None, 0
    rows, held = [], 0

    def part():
        key, start, n, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, kind), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    for batch in batches:
        kind = batch.schema.field("doc").type
        for row in batch.to_pylist():
            if row["file"] != name:
                if source:
                    source.close()
                name, source = row["file"], system.open_input_file(f"{root}/ids/{row['file']}")
                size = source.size()
                width, n_docs, _ = np.frombuffer(source.read_at(_TRAILER, size - _TRAILER), "<u8").astype(int).tolist()
                ends = size - _TRAILER - 8 * n_docs
            first = max(row["ordinal"] - 1, 0)
            cuts = np.frombuffer(source.read_at(8 * (row["ordinal"] + row["docs"] - first), ends + 8 * first), "<u8").astype(np.int64)
            cuts = cuts if row["ordinal"] else np.concatenate(([0], cuts))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                ids = np.frombuffer(source.read_at((b - a) * width, len(MAGIC) + a * width), f"<u{width}").astype("<u4").tobytes()
                rows.append((row["doc"], row["start"] + a, b - a, ids))
                held += len(ids)
                if held > _FLUSH:
                    yield part()
                    rows, held = [], 0
    if source:
        source.close()
    if rows:
        yield part()


def read(spark: SparkSession, folder: str, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids): the documents of the keys in ``keys``, read by way of the index.

    ``start`` is the number of ids of all documents before it, ``ids`` holds them as little-endian unsigned 32-bit integers, the end id included. Each
    key is looked up once; a key with several documents gives a row for each.
    """
    places = locate(spark, folder, keys.select(F.col(id_col).alias("doc")))
    files = spark.read.parquet(f"{folder}/shards").select(F.col("shard").cast("long").alias("shard"), "file", "start")
    rows = places.join(files, "shard").repartition("shard").sortWithinPartitions("shard", "ordinal").select("doc", "file", "start", "ordinal", "docs")
    shape = StructType([StructField("doc_id", keys.schema[id_col].dataType), StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    return rows.mapInArrow(lambda b: _payloads(b, folder), shape)

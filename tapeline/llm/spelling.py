"""Spelling variants by Bloom-guided neighbourhoods.

The vocabulary is written into blocked Bloom filters, one for each word length, a block being 64 bits wide. Each word generates its edits: all
deletions, and all replacements by letters of the vocabulary (an insertion is a deletion seen from the longer word). The hash of an edit
follows from that of the word by one multiplication, so an edit becomes a string only if the filter of its length knows it. These positives
alone are shuffled, to an exact join with the vocabulary that takes out the false ones.

Filters have ``BITS`` bits a word and come in rounds of at most ``ROUND`` bytes, which bounds every broadcast whatever the size of the vocabulary: the
filter of a length is cut into ranges of blocks, and an edit is probed in the round that holds its block.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.llm.common import pieces

#: shortest word, least occurrences, and how much more frequent a form has to be
SHORTEST, LEAST, TIMES = 7, 2, 10
#: one run in so many loses a letter (the planted misspellings of the contract); 0 for none
MISSPELL = 31
BITS, ROUND = 32, 16 << 20
#: words from this length on share one filter
LONGEST = 64
_EACH = 40_000  # words of a task that generates edits
_FLUSH = 200_000  # distinct words counted in a task before they go to the shuffle
_CELLS = 1 << 20  # edits handled at once
_BASE = np.uint64(0xD1342543DE82EF95)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(20_26).integers(1, 1 << 63, 256).astype(np.uint64)
#: Latin-1: letters stay, A-Z lower-cased, everything else is a space
_TABLE = bytes(b if chr(b).islower() and b < 0x80 or b >= 0xC0 else 0x20 for b in bytes(range(256)).lower())


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of the letters a-z, A-Z and U+00C0 to U+00FF, with A-Z lower-cased, as Latin-1 bytes."""
    return (text or "").encode("latin-1", "replace").translate(_TABLE).split()


def _counted(batches, shortest, misspell):
    """(word, n): counts of a task, in parts of at most ``_FLUSH`` words."""
    counts = Counter()

    def part():
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in pieces(batches):
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for run, n in Counter(runs(text)).items():
                if len(run) < shortest:
                    continue
                if misspell:
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                    if h % misspell == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                counts[run] += n
            if len(counts) >= _FLUSH:
                yield part()
                counts.clear()
    if counts:
        yield part()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, misspell: int = MISSPELL) -> DataFrame:
    """(word, n): the distinct words of at least ``shortest`` letters with at least ``least`` occurrences in all texts."""
    texts = docs.select(F.col(id_col).cast("string").alias("doc"), F.col(text_col).cast("string").alias("text"))
    counted = texts.mapInArrow(lambda b: _counted(b, shortest, misspell), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _bit(h: np.ndarray, i: int) -> np.ndarray:
    return (h >> np.uint64(6 * i)) & np.uint64(63)


def _by_length(words: list[bytes]):
    """(length, rows, letters as a matrix) for each length among the words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        step = max(1, _CELLS // max(length, 1))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield length, part, np.frombuffer(b"".join([words[r] for r in part.tolist()]), np.uint8).reshape(-1, length)


def _powers(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(length - 1, _BASE, np.uint64))))


def _hashes(letters: np.ndarray) -> np.ndarray:
    return (_LETTER[letters] * _powers(letters.shape[1])).sum(1, dtype=np.uint64)


def _blocks(batches, sizes):
    """(length, block, bits) of each word in the filters of ``sizes`` (length: log2 of its blocks)."""
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        for length, _, letters in _by_length(words):
            h, shard = _mixed(_hashes(letters)), min(length, LONGEST)
            bits = np.zeros(len(h), np.uint64)
            for i in range(4):
                bits |= np.uint64(1) << _bit(h, i)
            block = (h >> np.uint64(64 - sizes[shard])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), shard, np.int32)), pa.array(block), pa.array(bits.view(np.int64))], ["length", "block", "bits"])


class Filters:
    """Ranges of blocks of the filters of one round: {length: (log2 of all its blocks, first block held, blocks)}."""

    def __init__(self, held: dict[int, tuple[int, int, np.ndarray]]):
        self.held = held

    def __contains__(self, length: int) -> bool:
        return min(length, LONGEST) in self.held

    def known(self, length: int, h: np.ndarray) -> np.ndarray:
        """Places of the flat ``h`` whose words may be in the vocabulary."""
        log, first, blocks = self.held[min(length, LONGEST)]
        h = _mixed(h)
        at = (h >> np.uint64(64 - log)).astype(np.int64) - first
        if len(blocks) < 1 << log:
            here = np.flatnonzero((at >= 0) & (at < len(blocks)))
            at, h = at[here], h[here]
        else:
            here = None
        block = blocks[at]
        hit = np.flatnonzero((block >> _bit(h, 0)) & np.uint64(1))
        for i in range(1, 4):
            hit = hit[((block[hit] >> _bit(h[hit], i)) & np.uint64(1)).astype(bool)]
        return hit if here is None else here[hit]


def edits(letters: np.ndarray, alphabet: np.ndarray, filters: Filters):
    """(row, edited word) of the edits that the filters know: deletions (once for a run of equal letters), and replacements by a later letter."""
    n, length = letters.shape
    power = _powers(length)
    part = _LETTER[letters] * power
    whole = part.sum(1, dtype=np.uint64)
    if length > 1 and length - 1 in filters:
        upto = np.cumsum(part, axis=1, dtype=np.uint64)
        h = upto - part + (whole[:, None] - upto) * _UNBASE
        hit = filters.known(length - 1, h.ravel())
        row, at = np.divmod(hit, length)
        once = (at == 0) | (letters[row, at] != letters[row, np.maximum(at, 1) - 1])
        for r, j in zip(row[once].tolist(), at[once].tolist(), strict=True):
            word = letters[r].tobytes()
            yield r, word[:j] + word[j + 1 :]
    if length in filters:
        new = _LETTER[alphabet]
        for first in range(0, length, step := max(1, _CELLS // (n * len(alphabet)))):
            own = letters[:, first : first + step]
            h = (whole[:, None] - part[:, first : first + step])[:, :, None] + new[None, None, :] * power[first : first + step][None, :, None]
            hit = filters.known(length, h.ravel())
            cell, a = np.divmod(hit, len(alphabet))
            row, at = np.divmod(cell, own.shape[1])
            later = alphabet[a] > own[row, at]
            for r, j, letter in zip(row[later].tolist(), at[later].tolist(), alphabet[a[later]].tolist(), strict=True):
                word = bytearray(letters[r].tobytes())
                word[first + j] = letter
                yield r, bytes(word)


def _candidates(batches, shared, alphabet):
    """(word, n, other): words with the edits that the filters of a round know."""
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        for length, rows, letters in _by_length(words):
            if length not in shared.value and length - 1 not in shared.value:
                continue
            step = max(1, _CELLS // (length * len(alphabet)))
            for i in range(0, len(rows), step):
                found = list(edits(letters[i : i + step], alphabet, shared.value))
                if found:
                    row, other = zip(*found, strict=True)
                    own = batch.take(pa.array(rows[i : i + step][list(row)]))
                    yield pa.RecordBatch.from_arrays([own.column("word"), own.column("n"), pa.array([w.decode("latin-1") for w in other], pa.string())], ["word", "n", "other"])


def _rounds(sizes: dict[int, int], limit: int):
    """Ranges of blocks (length, first, stop), packed into rounds of at most ``limit`` bytes."""
    most = max(1, limit // 8)
    room, current = most, []
    for length, log in sorted(sizes.items()):
        first = 0
        while first < 1 << log:
            if not room:
                yield current
                room, current = most, []
            stop = min(1 << log, first + room)
            current.append((length, first, stop))
            room -= stop - first
            first = stop
    if current:
        yield current


def near_pairs(words: DataFrame, bits: int = BITS, limit: int = ROUND) -> DataFrame:
    """(word, n, other, other_n): every two words that differ by one letter put in, taken out or replaced, once.

    ``words`` is a stored table (word, n) of distinct words. Runs a count and a job for the filters when the frame is built.
    """
    spark = words.sparkSession
    sizes = {r["length"]: max(0, (r["count"] * bits // 64 - 1).bit_length()) for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("length")).count().collect()}  # at most LONGEST rows
    total = words.count()
    spread = store(words.repartition(max(1, -(-total // _EACH))))
    letters = spread.select(F.explode(F.array_distinct(F.split("word", ""))).alias("x")).distinct().collect()  # at most 90 letters
    alphabet = np.array(sorted(ord(r["x"]) for r in letters if r["x"]), np.uint8)
    blocks = store(spread.mapInArrow(lambda b: _blocks(b, sizes), "length int, block long, bits long").groupBy("length", "block").agg(F.bit_or("bits").alias("bits")))
    found = None
    for ranges in _rounds(sizes, limit):
        held = {}
        for length, first, stop in ranges:
            rows = blocks.filter((F.col("length") == length) & (F.col("block") >= first) & (F.col("block") < stop)).select("block", "bits").toArrow()
            held[length] = (sizes[length], first, np.zeros(stop - first, np.uint64))
            held[length][2][rows["block"].to_numpy() - first] = rows["bits"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(Filters(held))
        part = spread.mapInArrow(lambda b, s=shared: _candidates(b, s, alphabet), "word string, n long, other string")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return words.limit(0).select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n"))
    return store(found).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms. Forms rise in frequency by a factor, so chains are short; each step doubles the way."""
    ends = store(forms.select("word", F.col("form").alias("root")))
    while True:
        step = store(ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left").select("word", "root", "beyond"))
        if step.filter("beyond IS NOT NULL").isEmpty():
            return ends
        ends = step.select("word", F.coalesce("beyond", "root").alias("root"))


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES, misspell: int = MISSPELL, bits: int = BITS, limit: int = ROUND) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of the vocabulary.

    ``form`` is the near word of largest ``n`` (ties: the first in code-point order) if that is at least ``times`` the word's own, else null; ``root`` the end of
    the chain of forms, the word itself without one. Null and empty texts have no words; a null id counts as an empty string in the draw of misspellings;
    repeated rows of a document count again, with the same misspellings; other columns are not read; an empty table has no words. A text is held once as
    bytes in its task, however long, and a word of any length is edited in pieces. Several jobs run when the frame is built.
    """
    words = store(vocabulary(docs, id_col, text_col, shortest, least, misspell))
    pairs = near_pairs(words, bits, limit)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("order"), F.col("other").alias("form"))).alias("best"))
    near = store(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.order")).alias("form_n")))
    fits = F.col("form_n") >= times * F.col("n")
    decided = near.withColumn("form", F.when(fits, F.col("form"))).withColumn("form_n", F.when(fits, F.col("form_n")))
    ends = roots(decided.filter("form IS NOT NULL"))
    return decided.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))

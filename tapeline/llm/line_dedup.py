"""Line dedup by overlapping three-line windows, in DataFrame functions only.

The lines that hold a word are hashed; three consecutive ones make a window. A window whose lines are found more than once in the corpus keeps
its first occurrence (smallest doc_id, then text hash, then position); the lines of all other occurrences go, blank lines between them included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.llm.common import BLANK, join_same, keyed, text_of, unpack

SIZE = 3


def _held(column: Column) -> Column:
    """One-element explode: what follows reads the value and does not evaluate its expression again for each element."""
    return F.explode(F.array(column))


def windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Of (doc_id, body, text): (doc_id, body, at, first_line, last_line, h1, h2) of each window; two 64-bit hashes stand for its lines."""
    line = lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANK)).alias("t"))
    full = F.filter(F.transform(F.split("text", "\n", -1), line), lambda x: x.t != "")
    hashed = F.transform(full, lambda x: F.struct(x.line.alias("line"), F.xxhash64(x.t).alias("h1"), F.xxhash64(F.lit("second"), x.t).alias("h2")))
    held = docs.select("doc_id", "body", _held(hashed).alias("f")).filter(F.size("f") >= size)

    def window(i: Column) -> Column:
        part = [F.get(F.col("f"), i + k) for k in range(size)]
        return F.struct(part[0].line.alias("first_line"), part[-1].line.alias("last_line"), F.xxhash64(*[p.h1 for p in part]).alias("h1"), F.xxhash64(*[p.h2 for p in part]).alias("h2"))

    every = F.transform(F.sequence(F.lit(0), F.size("f") - size), window)
    return held.select("doc_id", "body", F.explode(every).alias("w")).select("doc_id", "body", "w.*")


def removed_ranges(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, body, ranges array<struct<start, stop>>): merged line ranges that go, stop exclusive, in order."""
    found = windows(docs, size)
    place = F.struct("doc_id", "body", "first_line")
    # stored, so that both sides of the join are plain shuffles and a very common window can be split
    first = store(found.groupBy("h1", "h2").agg(F.min(place).alias("kept_at"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = found.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("kept_at")))
    of_doc = Window.partitionBy("doc_id", "body").orderBy("first_line")
    cover = later.select("doc_id", "body", "first_line", (F.col("last_line") + 1).alias("stop")).distinct()
    opens = F.coalesce(F.col("first_line") > F.lag("stop").over(of_doc), F.lit(True))
    runs = cover.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(of_doc))
    merged = runs.groupBy("doc_id", "body", "run").agg(F.min("first_line").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("doc_id", "body").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, row, text, n_lines, n_removed): each input row with its remaining text and line counts.

    Null text stays null with 0 lines; an empty text has one (blank) line; a document with fewer than ``size`` lines that hold a word is never
    changed; repeated rows (equal id and text) are one document; a document all of whose lines go has the empty text.
    """
    packed = keyed(docs, id_col, text_col)
    ranges = removed_ranges(packed.select("doc_id", "body", text_of(text_col).alias("text")), size)
    joined = join_same(packed, ranges, ["doc_id", "body"], "left").withColumn("text", text_of(text_col)).select("doc_id", "row", "text", "ranges", F.explode_outer(F.array(F.split("text", "\n", -1))).alias("lines"))
    last = F.size("ranges")
    edge = lambda i: F.when(i == 0, 0).otherwise(F.get(F.col("ranges"), i - 1).stop)
    piece = lambda i: F.slice("lines", edge(i) + 1, F.coalesce(F.get(F.col("ranges"), i).start, F.size("lines")) - edge(i))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), last), piece))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    gone = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r.stop - r.start)
    return joined.select(
        "doc_id", "row",
        F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text"),
        n_lines.alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
    )


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with shortened texts; documents that lost every line go. ``n_chars``, if present, follows the text."""
    done = dedup_lines(docs, id_col, text_col, size).filter("n_removed < n_lines or n_removed = 0")
    new = {text_col: F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*unpack(done, docs.columns, **new))

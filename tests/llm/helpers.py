"""Odd inputs that every operator has to take."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: columns whose names the operators use inside
CLASHES = ["body", "row", "rest", "doc", "h", "h1", "fp", "found", "failed", "hits", "n", "nth", "size", "target", "copies", "first", "ranges", "kept_at", "m", "at"]
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


def odd_rows(seed=1):
    rng = random.Random(seed)
    passage, other = words(rng, 60), words(rng, 45)
    lines = "\n".join(words(rng, 8) for _ in range(12))
    texts = [None, "", " \t\r\n\x0b\x0c", "one", "one two", passage, f"{words(rng, 10)} {passage} {words(rng, 20)}", f"{other} {words(rng, 3)} {other}", lines, lines + "\nlast line", "x\n" + lines, lines,
             "a b " * 200, words(rng, 30_000), "same line here\n" * 50, "ſecret K     wide\U0001f600 words", "%%% ### $$$ &&&" * 20, lines.replace("\n", "\n\n"), words(rng, 80), words(rng, 34), words(rng, 35)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s2", "é", None]), len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], rows[0], (None, passage, None, None, None), (None, None, None, None, None), (None, passage, None, None, None), (18, "another text under an id that exists", "en", "s1", 3), (-5, lines, "en", "s2", 0)]
    return rows


def frame(spark, rows, extra=()):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)

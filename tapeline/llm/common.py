"""Shared pieces: row packing, word patterns, bytes of Arrow columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, which separates words: space and 0x09-0x0D
BLANK = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, row): ``body`` is a hash of the text, ``row`` the whole input row as a struct.

    The hash is declared nullable, as it is after a table was stored: keys of both sides then have one type, and a join needs no cast that would
    hide how its input is partitioned.
    """
    body = F.nullif(F.xxhash64(F.col(text_col).cast("string")), F.lit(None).cast("long"))
    return docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def text_of(text_col: str) -> Column:
    """Text of a packed row; it travels inside ``row`` only."""
    return F.col("row").getField(text_col).cast("string")


def key_of(*names: str) -> Column:
    """Join key of the named columns: a struct is never null, and structs with null fields are equal."""
    return F.struct(*names)


def join_same(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on the named columns with null equal to null; they appear once in the result."""
    other = right.withColumn("_key", key_of(*names)).drop(*names)
    return left.withColumn("_key", key_of(*names)).join(other, "_key", how).drop("_key")


def unpack(df: DataFrame, columns: list[str], **replaced: Column) -> list[Column]:
    """The columns of a packed ``row``, some of them replaced."""
    return [replaced[c].alias(c) if c in replaced else F.col("row").getField(c).alias(c) for c in columns]


def raw(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches, rows: int = 1000):
    """Arrow batches cut to at most so many rows, so that a worker holds the Python values of few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)

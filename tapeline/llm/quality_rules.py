"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores the measurements and one bit for each failed rule; policies are sets of bits with a
version number, so a new policy or an ablation reads the ledger and never the texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StructField, StructType

from tapeline.llm.common import unpack

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: rule -> condition on the measurements under which a document fails; the bit is the position in this table
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
}
#: version -> rules that reject; later versions never change
POLICIES: dict[int, tuple[str, ...]] = {1: ("few_words", "repeated_words"), 2: tuple(RULES)}
LATEST = max(POLICIES)

_SYMBOLS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
_TAIL_BYTES = bytes(range(0x80, 0xC0))  # second and later bytes of a code point


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base = len(number)
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs[:-1] * base + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : len(words) - 2 + shift] |= twice
    return int(covered.sum())


def measure_text(text: bytes | None) -> tuple:
    text = text or b""
    words = text.split()
    solid = text.translate(None, _BLANK)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(solid.translate(None, _TAIL_BYTES)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words))


@pandas_udf(StructType([StructField(name, LongType()) for name in MEASURES]))
def measure(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in text], columns=list(MEASURES))


def bits(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, measurements, failed): the input row, its measurements and the mask of failed rules.

    Null and empty texts have all measurements 0 and fail ``few_words``; repeated rows get equal entries; an empty table gives an empty ledger.
    """
    measured = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), measure(F.col(text_col).cast("binary")).alias("m"))
    flat = measured.select("row", "m.*")
    masks = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(0) for i, cond in enumerate(RULES.values())]
    return flat.withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), masks).cast("long"))


def kept(failed: Column, version: int = LATEST) -> Column:
    """Verdict of a policy on a mask."""
    return failed.bitwiseAND(F.lit(bits(POLICIES[version]))) == 0


def filter_documents(docs: DataFrame, version: int = LATEST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, unchanged."""
    return ledger(docs, text_col).filter(kept(F.col("failed"), version)).select(*unpack(docs, docs.columns))


def ablations(entries: DataFrame, version: int = LATEST) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): documents that fail a rule, that fail only it, and that the policy without it would keep.

    The ledger is first reduced to one count per mask, so the size of the second step depends on the number of rules alone.
    """
    policy = bits(POLICIES[version])
    per_mask = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy)).alias("mask")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits([r])).cast("long").alias("bit")) for r in POLICIES[version]])
    cell = per_mask.select("mask", "n", F.explode(rules).alias("r")).select("mask", "n", "r.rule", "r.bit")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    rest = F.col("mask").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return cell.groupBy("rule").agg(total(hit).alias("n_failed"), total(hit & rest).alias("n_only"), total(rest).alias("n_kept_without"))

"""Secret scan with corpus-wide ownership frequency.

Every text is searched for candidates: three base kinds and, as a fourth kind, bare tokens that look like credentials. The hash of each candidate value
is counted over the corpus by distinct repositories and owners. A value of ``example_owners`` or more owners is a widely copied example; a
live-looking value below that belongs to its owner. Base spans are always reported, bare tokens only if they are live-looking and owner-specific.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from tapeline.functions.lineage import store

#: in the order of the output; the first three are the base kinds
KINDS = ("assign", "access", "hex", "token")
EXAMPLE_OWNERS = 3
LEAST_ENTROPY = 3.0  # bits per character of a live-looking value

#: Patterns of the kinds.
_KEY_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Every match of the last three kinds lies in such a run.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_TOKEN_CHARS, _ASSIGN_CHARS = 20, 12

CANDIDATES = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("value", BinaryType()), StructField("live", BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())]))


def live_looking(value: str) -> bool:
    """Digits and letters, at least 12 characters, and varied enough."""
    if len(value) < _ASSIGN_CHARS or not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= LEAST_ENTROPY


def candidates(text: str | None) -> list[tuple]:
    """(kind, start, stop, value hash, live-looking) in code points, stop exclusive."""
    if not text:
        return []
    found = []

    def add(kind, start, stop, value):
        found.append((kind, start, stop, xxhash.xxh3_128_digest(value.encode()), live_looking(value)))

    low = text.lower()
    if any(k in low for k in _KEY_NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _ASSIGN_CHARS:
                add(0, m.start(), m.end(), m[2])
    for run in _RUN.finditer(text):
        for kind, pattern in ((1, _ACCESS), (2, _HEX)):
            for m in pattern.finditer(text, run.start(), run.end()):
                add(kind, m.start(), m.end(), m[0])
        if run.end() - run.start() >= _TOKEN_CHARS and live_looking(run[0]) and not any(s < run.end() and run.start() < e for _, s, e, *_ in found):
            add(3, run.start(), run.end(), run[0])
    return found


@arrow_udf(CANDIDATES)
def _candidates(text: pa.Array) -> pa.Array:
    return pa.array([candidates(t) for t in text.to_pylist()], _ARROW)


def ownership(found: DataFrame) -> DataFrame:
    """(value, owners, repositories): in how many owners and repositories a value occurs."""
    per_repo = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, spans array<struct<start, kind, stop, verdict, owners, repositories>>), one row for each input row.

    ``kind`` indexes ``KINDS``; ``verdict`` is ``example``, ``live`` or ``plain`` (owner-specific, not live-looking). ``owner`` defaults to the column ``source`` and
    ``repository`` to source and language; null is an owner like any other. Null and empty texts have no spans. Repeated rows are rows of the
    same repository, so they do not raise its counts.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    marked = store(docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), owner.alias("owner"), repository.alias("repository"), _candidates(F.col(text_col).cast("string")).alias("found")))
    each = marked.select("row_no", "owner", "repository", F.explode("found").alias("c")).select("row_no", "owner", "repository", "c.*")
    verdict = F.when(F.col("owners") >= example_owners, "example").when(F.col("live"), "live").otherwise("plain")
    judged = each.join(store(ownership(each)), "value").withColumn("verdict", verdict).filter((F.col("kind") < 3) | (F.col("verdict") == "live"))
    spans = judged.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "verdict", "owners", "repositories"))).alias("spans"))
    return marked.select("row_no", "doc_id").join(spans, "row_no", "left").select("doc_id", "spans")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.stop.cast("string"))), ","), F.lit(""))

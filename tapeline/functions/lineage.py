"""Reliable checkpoints and stored intermediate tables for iterative jobs."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local master has one machine, so a temporary folder does there; anywhere else a missing setting is an error, because
    executors cannot read each other's disks.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tapeline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def parts_for(rows: int, each: int = 500_000) -> int:
    """Files for a table of at most so many narrow rows."""
    return max(1, -(-rows // each))


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Checkpoint to the shared folder, in at most ``parts`` files if the caller knows how little there is."""
    shared_folder(df.sparkSession)
    return (df.coalesce(parts) if parts else df).checkpoint()


#: Removes the shuffle files of a statement when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, parts: int | None = None, release: bool = False) -> DataFrame:
    """Write as Parquet to the shared folder and read it back: for wide or large tables, which a checkpoint would keep uncompressed.

    With ``release`` the shuffle files of the write go as soon as it ends, not when the driver happens to collect them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)

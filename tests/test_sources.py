"""Upserts into partitions, and the tail of the paired test."""

from pathlib import Path

import pandas as pd

from tapeline.operators.risk import t_tail
from tapeline.sources import io


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda *r: spark.createDataFrame(list(r), "year int, id long, price double, loaded_at long")
    io.write_partitions(rows((2020, 1, 1.0, 1), (2021, 1, 2.0, 1), (2021, 2, 3.0, 1), (2022, 1, 4.0, 1), (None, 5, 5.0, 1)), path, "year")
    before = {p for p in Path(path).rglob("part-*")}
    io.upsert_partitions(rows((2021, 2, 30.0, 2), (2021, 1, 0.0, 0), (2023, 9, 9.0, 2), (None, 5, 50.0, 2)), path, ["year", "id"], "year")
    after = {p for p in Path(path).rglob("part-*")}
    kept = {p.parent.name for p in before & after}
    assert kept == {"year=2020", "year=2022"} and {p.parent.name for p in before - after} == {"year=2021", "year=__HIVE_DEFAULT_PARTITION__"}
    got = {(r.year, r.id): r.price for r in spark.read.parquet(path).collect()}
    assert got == {(2020, 1): 1.0, (2021, 1): 2.0, (2021, 2): 30.0, (2022, 1): 4.0, (2023, 9): 9.0, (None, 5): 50.0}


def test_t_tail(spark):
    pdf = pd.DataFrame({"t": [2.0, -2.0, 0.0, 12.706205, 1.96, 60.0, None], "v": [10.0, 10.0, 5.0, 1.0, 1e6, 30.0, 3.0]})
    got = [r.p for r in spark.createDataFrame(pdf).select(t_tail("t", "v").alias("p")).collect()]
    want = [0.0733880, 0.0733880, 1.0, 0.05, 0.0499958, 0.0]
    assert all(abs(a - b) < 1e-5 for a, b in zip(got, want)) and got[-1] != got[-1] or got[-1] is None

"""Named queries and the DuckDB statements that check them."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}

_BARS = """
{name}_raw AS (SELECT symbol, bar_ts AS ts, first(price ORDER BY ts, {tie}) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY ts, {tie}) AS close, CAST(sum(size) AS DOUBLE) AS volume
  FROM ({ticks}) GROUP BY symbol, bar_ts),
{name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS seq FROM {name}_raw)"""

CTES = {
    "bars_h": _BARS.format(name="bars_h", tie="event_id", ticks="""SELECT event_type AS symbol, ts, date_trunc('hour', ts) AS bar_ts,
        event_id, value AS price, 1 AS size FROM events"""),
    "bars_d": _BARS.format(name="bars_d", tie="o_orderkey", ticks="""SELECT o_orderpriority AS symbol, o_orderdate AS ts,
        o_orderdate AS bar_ts, o_orderkey, o_totalprice AS price, 1 AS size FROM orders"""),
    "bars_b": _BARS.format(name="bars_b", tie="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice",
        ticks="""SELECT p_brand AS symbol, l_shipdate AS ts, l_shipdate AS bar_ts, l_orderkey, l_linenumber, l_partkey,
        l_suppkey, l_extendedprice, l_extendedprice / l_quantity AS price, l_quantity AS size
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "ticks_u": """ticks_u AS (SELECT user_id AS symbol, ts, event_id, event_type, value AS price,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events)""",
    "series": "series AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)",
}
NEEDS: dict = {}


def cte(name: str, body: str, needs: str = "") -> None:
    """Declare an oracle CTE that may build on others."""
    CTES[name] = f"{name} AS ({body})"
    NEEDS[name] = needs.split()


def _closure(names):
    done = []

    def visit(n):
        if n in done:
            return
        for m in NEEDS.get(n, []):
            visit(m)
        done.append(n)

    for n in names:
        visit(n)
    return done


def oracle(needs: str, body: str, nums: str = "", d: int = 6) -> str:
    """SQL with the needed CTEs and ``nums`` rounded to ``d`` decimals."""
    names = _closure(needs.split())
    head = "WITH RECURSIVE " + ",\n".join(CTES[n] for n in names) + "\n" if names else ""
    fix = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c in nums.split())
    return head + (f"SELECT * REPLACE ({fix}) FROM (\n{body}\n)" if fix else f"SELECT * FROM (\n{body}\n)")


def tidy(df, nums: str, d: int):
    cols = set(nums.split())
    return df.select(*[(F.round(F.col(c), d) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def query(name: str, needs: str = "", sql: str | None = None, nums: str = "", d: int = 6):
    """Register ``fn(spark, root)``; round ``nums`` the same way on both sides."""

    def register(fn):
        QUERIES[name] = lambda spark, root: tidy(fn(spark, root), nums, d)
        if sql is not None:
            ORACLES[name] = (needs, sql, nums, d)
        return fn

    return register


def oracles() -> dict:
    """Complete statements, built once every CTE is known."""
    return {name: oracle(*parts) for name, parts in ORACLES.items()}

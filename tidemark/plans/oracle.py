"""SQL building blocks of the queries' oracles (DuckDB)."""

from __future__ import annotations

W = "PARTITION BY symbol ORDER BY ts"


def rows(n: int, end: int = 0) -> str:
    """A window over the n rows that end ``end`` rows before the current one."""
    return f"({W} ROWS BETWEEN {n - 1 - end} PRECEDING AND {f'{-end} PRECEDING' if end else 'CURRENT ROW'})"


def bars(unit: str = "day") -> str:
    """WITH clause for bars of the events table."""
    return f"""WITH bars AS (
  SELECT event_type AS symbol, date_trunc('{unit}', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(*) AS trades
  FROM events GROUP BY ALL)"""


OI = """WITH oi AS (
  SELECT o_orderstatus AS symbol, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS open_interest, avg(o_totalprice) AS price, max(o_totalprice) AS high, min(o_totalprice) AS low
  FROM orders GROUP BY ALL)"""

TRADES = """WITH trades AS (
  SELECT l_returnflag AS symbol, l_shipdate AS ts,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linestatus) AS trade_id,
         CASE WHEN abs(l_quantity) > 1e-9 THEN l_extendedprice / l_quantity ELSE 0 END AS price, l_quantity AS quantity, l_linestatus = 'F' AS is_buyer_maker
  FROM lineitem)"""


def r(expression: str, name: str) -> str:
    """A float rounded for comparison; adding 0 turns -0 into 0."""
    return f"round({expression}, 6) + 0 AS {name}"

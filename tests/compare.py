"""Compare a query with its SQL in DuckDB, as sets of rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.astimezone(datetime.timezone.utc).replace(tzinfo=None).isoformat() if x.tzinfo else x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(_plain(row[i]) for i in order) for row in cursor.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(x) for x in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def difference(df, sql: str, sf_dir: str) -> str:
    """Empty if the rows are the same."""
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, sf_dir)
    if a != b:
        return f"columns {a} and {b}"
    only = list((x - y).items())[:3], list((y - x).items())[:3]
    return "" if not any(only) else f"{sum(x.values())} and {sum(y.values())} rows of {a}; only Spark: {only[0]}; only SQL: {only[1]}"

"""Compare catalogue queries with their SQL on DuckDB: columns by name, rows as multisets."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_cell(v) for v in row) for row in df.select(*names).collect())


def sql_rows(con, sql: str) -> tuple[list[str], Counter]:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in cur.fetchall())


def _close(a, b, tolerance: float) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= tolerance
    return a == b


def _matches(mine: Counter, other: Counter, tolerance: float) -> bool:
    """Row by row, paired by everything but the doubles (then by the doubles in order)."""
    def ordered(rows):
        return sorted(rows.elements(), key=lambda r: ([str(v) for v in r if not isinstance(v, float)],
                                                      [v for v in r if isinstance(v, float)]))
    a, b = ordered(mine), ordered(other)
    return len(a) == len(b) and all(_close(x, y, tolerance) for r, s in zip(a, b) for x, y in zip(r, s))


def difference(df, con, sql: str, tolerance: float = 0.0, may_be_empty: bool = False) -> str | None:
    """None when both agree, otherwise a short description.

    Both sides round, by different methods at exact ties; ``tolerance`` allows for one unit of the last digit.
    """
    names, mine = spark_rows(df)
    other_names, other = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} != {other_names}"
    if mine == other or (tolerance and _matches(mine, other, tolerance)):
        return None if mine or may_be_empty else "no rows"
    extra, missing = mine - other, other - mine
    return (f"{sum(mine.values())} vs {sum(other.values())} rows; {sum(extra.values())} differ; "
            f"e.g. {sorted(extra, key=str)[:2]} vs {sorted(missing, key=str)[:2]}")

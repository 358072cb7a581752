"""Runs registered queries beside their SQL on DuckDB and compares rows without regard to order."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(names: list[str], found) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in found)


def difference(spark, c, sf_dir: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    own = rows(df.columns, df.collect())
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    other = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if own != other:
        return f"{sum(own.values())} and {sum(other.values())} rows; only here {list((own - other).items())[:2]}, only in SQL {list((other - own).items())[:2]}"
    return None

"""Holds Spark results against the oracle's: same rows, in any order, numbers compared to nine digits."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple") or isinstance(v, float):
        return round(float(v), 6) + 0.0
    if isinstance(v, int):
        return float(v)
    return str(v)


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in data)


def duck(sf_dir: str, sql: str) -> Counter:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return rows([d[0] for d in cur.description], cur.fetchall())


def difference(spark, sf_dir: str, fn, sql: str) -> str:
    """Empty if both give the same rows, else what differs."""
    df = fn(spark, sf_dir)
    got, want = rows(df.columns, df.collect()), duck(sf_dir, sql)
    only_spark, only_sql = got - want, want - got
    if not only_spark and not only_sql:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; spark only: {list(only_spark.items())[:3]}; sql only: {list(only_sql.items())[:3]}"

"""Runs a query and its SQL on the same tables and gives both results in a comparable form."""

import math
from pathlib import Path

import duckdb


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return plain(v.item()) if hasattr(v, "item") else str(v)


def both(spark, directory, query, sql):
    rows = query(spark, directory)
    columns = sorted(rows.columns)
    left = sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect())
    with duckdb.connect() as con:
        for p in Path(directory).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        right = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    return left, right

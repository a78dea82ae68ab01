"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or hasattr(v, "__len__"):
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return None if str(v) in ("<NA>", "NaT") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in (plain(r[i]) for i in order)]) for r in rows)


def check(spark, name, query, sql, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    found = query(spark, sf_dir)
    wanted = con.execute(sql)
    names = [c[0] for c in wanted.description]
    assert sorted(found.columns) == sorted(names), name
    a, b = rows_of(found.columns, [tuple(r) for r in found.collect()]), rows_of(names, wanted.fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    assert a == b, (name, next((x, y) for x, y in zip(a, b, strict=True) if x != y))

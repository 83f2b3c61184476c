"""Compare a query with its SQL, rows in any order, columns by name."""

from __future__ import annotations

import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return x


def multiset(rows) -> Counter:
    return Counter(tuple(map(plain, r)) for r in rows)


def sql_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    types = [str(d[1]) for d in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(r[i] for i in order) for r in out.fetchall()], [types[i] for i in order]


def differences(df, sf_dir: str, sql: str) -> str:
    names = sorted(df.columns)
    wanted, rows, types = sql_rows(sf_dir, sql)
    if names != wanted:
        return f"columns {names} and {wanted}"
    got, want = multiset(df.select(*(f"`{n}`" for n in names)).collect()), multiset(rows)
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [(n, t, u) for n, t, u in zip(names, [dict(df.dtypes)[n] for n in names], types, strict=True) if kinds.get(t, t) != u]
    return f"TYPES {odd}" if odd else ""

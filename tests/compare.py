"""Compare a Spark result with the SQL result of the same query."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, _sorted([tuple(_plain(r[n]) for n in names) for r in df.collect()])


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    order = sorted(range(len(found)), key=lambda i: found[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cur.fetchall()]
    return [found[i] for i in order], _sorted(rows)


def difference(df, con, sql) -> str | None:
    """None if both agree, else a short description."""
    sn, sr = rows_of_spark(df)
    dn, dr = rows_of_duck(con, sql)
    if sn != dn:
        return f"columns {sn} <> {dn}"
    if len(sr) != len(dr):
        only = [r for r in sr if r not in dr][:2], [r for r in dr if r not in sr][:2]
        return f"rows {len(sr)} <> {len(dr)}: {only}"
    for a, b in zip(sr, dr):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            bad = [n for n, x, y in zip(sn, a, b) if x != y or type(x) is not type(y)]
            return f"columns {bad}: {a} <> {b}"[:900]
    return None

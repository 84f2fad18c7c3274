"""Holds a Spark result against the rows DuckDB gives for its SQL."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    return None if v is None or v != v else v


def rows(names: list[str], got: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in got), key=repr)


def differences(df, con, sql: str) -> str:
    """Empty if both sides have the same columns, types and rows."""
    theirs = con.execute(sql)
    names = [c[0] for c in theirs.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {c[0]: str(c[1]).upper() for c in theirs.description}
    same = {"bigint": ("BIGINT", "HUGEINT", "NUMBER"), "int": ("INTEGER", "NUMBER"), "double": ("DOUBLE", "NUMBER"), "string": ("VARCHAR", "STRING"), "boolean": ("BOOLEAN", "BOOL")}
    odd = {c: (k, kinds[c]) for c, k in df.dtypes if kinds[c] not in same.get(k, (kinds[c],))}
    a, b = rows(df.columns, df.collect()), rows(names, theirs.fetchall())
    if a != b:
        only = [x for x in a if x not in set(b)][:3] if len(a) < 50_000 else []
        return f"{len(a)} and {len(b)} rows; ours {only or a[:2]}, theirs {[x for x in b if x not in set(a)][:3] if len(b) < 50_000 else b[:2]}"
    return f"types {odd}" if odd else ""

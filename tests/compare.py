"""Rows of a query against those of its SQL."""

from __future__ import annotations

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    return v


def same_rows(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    assert sorted(con.sql(sql).columns) == columns
    wanted = [tuple(map(plain, r)) for r in con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({sql})").fetchall()]
    found = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)

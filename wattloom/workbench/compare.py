"""Runs a query in Spark and its SQL twin in DuckDB and compares the rows as sets with counts."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat(timespec="microseconds")
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in data)


def compare(df, con, sql: str):
    """(row count, list of differences) for one query."""
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_names, want = rows([d[0] for d in rel.description], rel.fetchall())
    if names != want_names:
        return sum(got.values()), [f"columns {names} != {want_names}"]
    diff = [f"- only spark {k} x{n}" for k, n in list((got - want).items())[:3]]
    diff += [f"+ only sql   {k} x{n}" for k, n in list((want - got).items())[:3]]
    if diff:
        diff.insert(0, f"{sum((got - want).values())} spark-only, {sum((want - got).values())} sql-only of {sum(want.values())}")
    return sum(got.values()), diff

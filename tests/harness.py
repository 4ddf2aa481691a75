"""Runs a query and its SQL twin and compares rows, whatever their order."""

from __future__ import annotations

import datetime
import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return int(x) if isinstance(x, bool) else x


def twin(sql: str, sf: str):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, query, sql: str, sf: str = "sf0.001") -> str:
    """Empty if equal, else what differs."""
    df = query(spark, f"{DATA}/{sf}")
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    names, rows = twin(sql, sf)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    at = [names.index(c) for c in sorted(names)]
    other = [tuple(plain(r[i]) for i in at) for r in rows]
    a, b = Counter(mine), Counter(other)
    if a != b:
        return f"{len(mine)} and {len(other)} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}"
    return "" if mine else "no rows"

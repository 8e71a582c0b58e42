"""Runs a registered query and its DuckDB SQL on the same tables, as sorted rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)


def duck_rows(c, sql):
    rel = c.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda k: rel.columns[k])
    return sorted(rel.columns), sorted((tuple(_plain(r[k]) for k in order) for r in rel.fetchall()), key=str)

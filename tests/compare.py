"""Spark results against DuckDB's, as sorted rows with rounded numbers."""

import decimal
import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6f}"
    return str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in data)


def against_sql(df, sql, sf=SF):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = db.execute(sql)
    return rows(df.columns, [tuple(r) for r in df.collect()]), rows([d[0] for d in got.description], got.fetchall())

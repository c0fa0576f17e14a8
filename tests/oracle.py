"""Compares a query's rows with its SQL's, whatever their order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    c = connect(sf_dir).sql(sql)
    want = rows_of(c.columns, c.fetchall())
    if got == want:
        return ""
    return f"{got[0]} {want[0]}: {len(got[1])} and {len(want[1])} rows; {[(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]}"

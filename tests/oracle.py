"""Runs a query and its SQL side by side and compares rows as multisets, and types."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, Decimal):
        return x.normalize()
    return x.isoformat() if hasattr(x, "isoformat") else x


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in data)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def compare(df, con, sql):
    got = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in got.description}
    want = rows([d[0] for d in got.description], got.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0]
    assert {k: KINDS.get(t, t.upper()) for k, t in df.dtypes} == kinds
    assert have[1] == want[1]

"""A query's rows against those of its SQL, as the driver compares them: by column name, in any order."""

import math
import os
from pathlib import Path

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connected(folder=DATA):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def assert_same(df, sql, folder=DATA):
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connected(folder)
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows_of(columns, found.fetchall())
    assert got == want

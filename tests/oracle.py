"""Compare a registered query with its SQL on the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df, sql, folder):
    con = connect(folder)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(got) == len(expected), (len(got), len(expected))
    for mine, theirs in zip(got, expected):
        assert mine == theirs, (sorted(names), mine, theirs)
        assert list(map(type, mine)) == list(map(type, theirs)), (sorted(names), mine, theirs)
    return len(got)

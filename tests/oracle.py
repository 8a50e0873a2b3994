"""Compares a query with its SQL: same columns, same rows, in any order."""

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of_sql(sql: str, sf: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in got.fetchall()), key=repr)


def rows_of_query(df) -> tuple[list[str], list]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)


def assert_same(spark, name: str, sf: str) -> None:
    import __spark_entry__ as entry

    got, want = rows_of_query(entry.queries()[name](spark, sf)), rows_of_sql(entry.oracle_sql()[name], sf)
    assert got[0] == want[0], f"{name}: {got[0]} and {want[0]}"
    assert len(got[1]) == len(want[1]), f"{name}: {len(got[1])} and {len(want[1])} rows"
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, f"{name}: {a} and {b}"

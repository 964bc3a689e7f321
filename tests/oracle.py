"""Compare a query's rows with its SQL run by DuckDB on the same tables."""

import math
from collections import Counter
from decimal import Decimal

import duckdb

from revlake.sources.bindings import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (Decimal, float)):
        value = float(value)
        return None if math.isnan(value) else int(value) if value.is_integer() else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_by_name(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    actual = rows_by_name(df.columns, [tuple(r) for r in df.collect()])
    missing, extra = expected - actual, actual - expected
    assert not missing and not extra, (
        f"{sum(missing.values())} missing, {sum(extra.values())} extra: "
        f"{list(missing)[:2]} vs {list(extra)[:2]}"
    )
    return sum(expected.values())

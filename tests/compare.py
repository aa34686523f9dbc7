"""Row-for-row comparison of a DataFrame with a DuckDB result, columns by name."""

import datetime as dt
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    return value


def _order(row):
    """Exact columns first, so that a last-digit difference cannot reorder rows."""
    exact = [(v is None, isinstance(v, str), v or 0) for v in row if not isinstance(v, float)]
    return exact, [v for v in row if isinstance(v, float)]


def same(one, other):
    """Equal rows; rounded doubles may differ by one unit in the last place kept (ties)."""
    return len(one) == len(other) and all(
        abs(a - b) <= 1.01e-4 + 1e-9 * abs(b) and abs(a - b) <= 0.51 * abs(b) + 1.01e-6
        if isinstance(a, float) and isinstance(b, (int, float))
        else a == b
        for a, b in zip(one, other)
    )


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=_order)


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    found = [d[0] for d in cursor.description]
    order = sorted(range(len(found)), key=found.__getitem__)
    rows = (tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(found), sorted(rows, key=_order)

"""Run a registered query and its oracle and compare the results."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def _plain(value):
    return 0.0 if isinstance(value, float) and value == 0 else value


def differences(df, con, sql: str) -> tuple[str, int]:
    """A description of what differs ('' if nothing does) and the number of rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _bag(names, cursor.fetchall())
    got = _bag(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}", 0
    missing, extra = expected - got, got - expected
    if not missing and not extra:
        return "", sum(got.values())
    return (
        f"{sum(got.values())} rows instead of {sum(expected.values())}; "
        f"missing {sum(missing.values())}: {list(missing)[:3]}; extra {sum(extra.values())}: {list(extra)[:3]}",
        sum(got.values()),
    )

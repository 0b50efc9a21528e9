"""Compare named queries with their SQL: names, types, row counts and values, order ignored."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{root}/{name}.parquet')")
    return connection


def _kind(value) -> str:
    return "NoneType" if value is None else type(value).__name__


def _key(row) -> tuple:
    return tuple(
        (0, "") if v is None else (1, f"{v:.5f}") if isinstance(v, float) else (1, str(v)) for v in row
    )


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def differences(df, connection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    names = sorted(df.columns)
    if names != sorted(relation.columns):
        return [f"columns {names} vs {sorted(relation.columns)}"]
    problems = []
    types = dict(zip(relation.columns, map(str, relation.types)))
    for field in df.schema.fields:
        wanted = SQL_TYPES.get(field.dataType.simpleString(), field.dataType.simpleString())
        if types[field.name] != wanted:
            problems.append(f"type of {field.name}: {wanted} vs {types[field.name]}")
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    order = [relation.columns.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in relation.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return problems + [f"rows {len(ours)} vs {len(theirs)}"]
    wrong = 0
    for a, b in zip(ours, theirs):
        for name, x, y in zip(names, a, b):
            if hasattr(x, "tzinfo") and x is not None:
                x, y = x.replace(tzinfo=None), y.replace(tzinfo=None)
            same = x == y or (
                isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-6)
            )
            if not same:
                wrong += 1
                if wrong <= 3:
                    problems.append(f"{name}: {x!r} vs {y!r}")
    if wrong:
        problems.append(f"{wrong} values differ")
    return problems

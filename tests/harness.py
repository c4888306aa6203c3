"""Runs a query and its DuckDB text on one set of tables and compares them as the driver does: by name, without order."""

from __future__ import annotations

import math

import duckdb

SF = "/root/testdata/sf0.001"


def views(sf_dir: str = SF):
    from quarry.operators.registry import TABLES

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        value = float(value)
        return value if math.isinf(value) else round(value, 6) + 0.0
    return str(value).replace("T", " ").removesuffix(" 00:00:00") if hasattr(value, "isoformat") else str(value)


def rows(columns: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=str)


def compare(spark, db, query, sql: str, sf_dir: str = SF) -> None:
    frame = query(spark, sf_dir)
    got = rows(frame.columns, frame.collect())
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    assert sorted(frame.columns) == sorted(names)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)

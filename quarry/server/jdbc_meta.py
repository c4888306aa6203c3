"""Metadata tables that JDBC drivers ask for."""

from __future__ import annotations

from quarry.server.responses import NAMES

SCHEMA = "system_jdbc"


def refresh(engine) -> None:
    """Tables ``schemas``, ``tables`` and ``columns`` of the schema ``system_jdbc``, as things are now."""
    if SCHEMA not in engine.schemas:
        engine.create_schema(SCHEMA)
    spark, catalog = engine.spark, engine.catalog
    own = {n: s for n, s in engine.schemas.items() if n != SCHEMA}
    schemas = [(catalog, n) for n in own]
    tables = [(catalog, n, t, "TABLE", "", "", "", "", "", "") for n, s in own.items() for t in s.tables]
    columns = []
    for n, s in own.items():
        for t, table in s.tables.items():
            for k, f in enumerate(table.frame.schema):
                columns.append((catalog, n, t, f.name, NAMES.get(f.dataType.simpleString(), "varchar"), k + 1, "YES" if f.nullable else "NO"))
    for name, rows, kinds in (
        ("schemas", schemas, "TABLE_CATALOG string, TABLE_SCHEM string"),
        ("tables", tables, "TABLE_CAT string, TABLE_SCHEM string, TABLE_NAME string, TABLE_TYPE string, REMARKS string, TYPE_CAT string, TYPE_SCHEM string, TYPE_NAME string, SELF_REFERENCING_COL_NAME string, REF_GENERATION string"),
        ("columns", columns, "TABLE_CAT string, TABLE_SCHEM string, TABLE_NAME string, COLUMN_NAME string, TYPE_NAME string, ORDINAL_POSITION int, IS_NULLABLE string"),
    ):
        engine.register(name, spark.createDataFrame(rows, kinds), SCHEMA)

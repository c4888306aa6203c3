"""Statements that aren't queries: schemas, tables, metadata, models."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.dialect.options import options
from quarry.dialect.tokenizer import Group, find, parse, render, string_value
from quarry.errors import ParsingException

if TYPE_CHECKING:
    from quarry.engine import Engine

#: Spark's names of types and SQL's.
SQL_TYPES = {"string": "varchar", "int": "integer", "timestamp_ntz": "timestamp", "timestamp": "timestamp_with_local_time_zone"}


class Words:
    """Reads a statement from left to right."""

    def __init__(self, items: list):
        self.items, self.at = items, 0

    def take(self, *words: str) -> bool:
        if find(self.items[self.at : self.at + len(words)], *words) == 0:
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise ParsingException(f"{' '.join(words)} is expected in: {render(self.items)}")

    def name(self) -> str:
        """A name with its qualifiers."""
        parts = []
        while self.at < len(self.items) and self.items[self.at].kind in ("word", "tick", "quoted"):
            t = self.items[self.at]
            parts.append(t.text if t.kind == "word" else string_value(t.text))
            self.at += 1
            if not self.take("."):
                break
        if not parts:
            raise ParsingException(f"a name is expected in: {render(self.items)}")
        return ".".join(parts)

    def group(self) -> Group:
        if self.at < len(self.items) and isinstance(self.items[self.at], Group):
            self.at += 1
            return self.items[self.at - 1]
        raise ParsingException(f"parentheses are expected in: {render(self.items)}")

    def query(self) -> Group:
        """What follows, a query in parentheses or without."""
        rest = self.items[self.at :]
        if len(rest) == 1 and isinstance(rest[0], Group):
            rest = rest[0].items
        if not rest:
            raise ParsingException("a query is expected")
        return parse(render(rest))

    def end(self) -> None:
        if self.at < len(self.items):
            raise ParsingException(f"can't read on at: {render(self.items[self.at :])}")


def run(engine: Engine, statement: Group) -> tuple[bool, Any]:
    """Whether the statement was one of these, and what it gave."""
    words = Words(statement.items)
    for start, handler in HANDLERS:
        if words.take(*start):
            return True, handler(engine, words)
    return False, None


def _flags(words: Words, thing: str, replace: bool) -> tuple[bool, bool]:
    words.need(thing)
    return replace, words.take("IF", "NOT", "EXISTS")


def _split(engine: Engine, name: str) -> tuple[str, str]:
    schema, _, own = name.rpartition(".")
    schema = schema.rpartition(".")[2] or engine.schema_name
    if schema not in engine.schemas:
        raise RuntimeError(f"Schema {schema} not found.")
    return schema, own


def _create(engine: Engine, words: Words) -> None:
    replace = words.take("OR", "REPLACE")
    if words.take("SCHEMA"):
        unless = words.take("IF", "NOT", "EXISTS")
        name = words.name()
        words.end()
        if name in engine.schemas:
            if not replace and not unless:
                raise RuntimeError(f"A Schema with the name {name} is already present.")
            if unless:
                return
        engine.create_schema(name)
        return
    if words.take("MODEL"):
        unless = words.take("IF", "NOT", "EXISTS")
        name = words.name()
        words.need("WITH")
        given = options(words.group())
        words.need("AS")
        schema, own = _split(engine, name)
        if own.lower() in engine.schemas[schema].models:
            if unless:
                return
            if not replace:
                raise RuntimeError(f"A model with the name {name} is already present.")
        from quarry.ml.train import train

        model, columns = train(given, engine._run(words.query()))
        engine.register_model(own, model, columns, schema)
        return
    if words.take("EXPERIMENT"):
        unless = words.take("IF", "NOT", "EXISTS")
        name = words.name()
        words.need("WITH")
        given = options(words.group())
        words.need("AS")
        schema, own = _split(engine, name)
        if own.lower() in engine.schemas[schema].experiments:
            if unless:
                return
            if not replace:
                raise RuntimeError(f"A experiment with the name {name} is already present.")
        from quarry.ml.experiment import experiment

        model, columns, results = experiment(engine.spark, given, engine._run(words.query()))
        engine.register_model(own, model, columns, schema)
        engine.register_experiment(own, results, schema)
        return results
    view = words.take("VIEW")
    if not view:
        words.need("TABLE")
    unless = words.take("IF", "NOT", "EXISTS")
    name = words.name()
    schema, own = _split(engine, name)
    if own.lower() in engine.schemas[schema].tables:
        if unless:
            return
        if not replace:
            raise RuntimeError(f"A table with the name {name} is already present.")
    if words.take("WITH"):
        given = options(words.group())
        words.end()
        if "location" not in given:
            raise AttributeError("location is missing: it says where the table's data are")
        location, form = given.pop("location"), given.pop("format", None)
        persist, gpu = bool(given.pop("persist", False)), bool(given.pop("gpu", False))
        engine.create_table(own, location, format=form, persist=persist, gpu=gpu, schema_name=schema, **given)
        return
    words.need("AS")
    frame = engine._run(words.query())
    engine.register(own, frame if view else frame.persist(), schema)


def _drop(engine: Engine, words: Words) -> None:
    for thing in ("TABLE", "VIEW", "SCHEMA", "MODEL", "EXPERIMENT"):
        if words.take(thing):
            break
    else:
        raise ParsingException("TABLE, VIEW, SCHEMA or MODEL is expected after DROP")
    maybe = words.take("IF", "EXISTS")
    name = words.name()
    words.end()
    if thing == "SCHEMA":
        if name not in engine.schemas:
            if maybe:
                return
            raise RuntimeError(f"A Schema with the name {name} is not present.")
        engine.drop_schema(name)
        return
    try:
        schema, own = _split(engine, name)
    except RuntimeError:
        if maybe:
            return
        raise
    kept = {"TABLE": "tables", "VIEW": "tables", "MODEL": "models", "EXPERIMENT": "experiments"}[thing]
    if own.lower() not in getattr(engine.schemas[schema], kept):
        if maybe:
            return
        raise RuntimeError(f"A {thing.lower()} with the name {name} is not present.")
    if kept == "tables":
        engine.drop_table(own, schema)
    else:
        del getattr(engine.schemas[schema], kept)[own.lower()]


def _alter(engine: Engine, words: Words) -> None:
    if words.take("SCHEMA"):
        old = words.name()
        words.need("RENAME", "TO")
        new = words.name()
        words.end()
        if old not in engine.schemas:
            raise KeyError(f"A schema with the name {old} is not present.")
        engine.alter_schema(old, new)
        return
    words.need("TABLE")
    maybe = words.take("IF", "EXISTS")
    schema, old = _split(engine, words.name())
    words.need("RENAME", "TO")
    new = words.name()
    words.end()
    if old.lower() not in engine.schemas[schema].tables:
        if maybe:
            return
        raise KeyError(f"A table with the name {old} is not present.")
    engine.alter_table(old, new, schema)


def _use(engine: Engine, words: Words) -> None:
    name = words.name()
    words.end()
    if name not in engine.schemas:
        raise RuntimeError(f"A schema with the name {name} is not present.")
    engine.schema_name = name


def _rows(engine: Engine, rows: list[tuple], *columns: str) -> DataFrame:
    return engine.spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def _schema_of(engine: Engine, name: str | None) -> str:
    catalog, _, schema = (name or engine.schema_name).rpartition(".")
    if catalog and catalog != engine.catalog or schema not in engine.schemas:
        raise AttributeError(f"Schema {name} is not defined.")
    return schema


def _show(engine: Engine, words: Words) -> DataFrame:
    if words.take("SCHEMAS"):
        if words.take("FROM") and (catalog := words.name()) != engine.catalog:
            raise RuntimeError(f"A catalog with the name {catalog} is not present.")
        names = [*engine.schemas, "information_schema"]
        if words.take("LIKE"):
            wanted = string_value(words.items[words.at].text)
            words.at += 1
            names = [n for n in names if n == wanted]
        words.end()
        return _rows(engine, [(n,) for n in names], "Schema")
    if words.take("TABLES"):
        schema = _schema_of(engine, words.name() if words.take("FROM") else None)
        words.end()
        return _rows(engine, [(n,) for n in engine.schemas[schema].tables], "Table")
    if words.take("COLUMNS"):
        words.need("FROM")
        return _columns(engine, words)
    if words.take("MODELS"):
        schema = _schema_of(engine, words.name() if words.take("FROM") else None)
        words.end()
        return _rows(engine, [(n,) for n in engine.schemas[schema].models], "Models")
    raise ParsingException("SCHEMAS, TABLES, COLUMNS or MODELS is expected after SHOW")


def _columns(engine: Engine, words: Words) -> DataFrame:
    name = words.name()
    words.end()
    frame = engine.table(name)
    return _rows(engine, [(f.name, SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()), "", "") for f in frame.schema], "Column", "Type", "Extra", "Comment")


def _describe(engine: Engine, words: Words) -> DataFrame:
    if words.take("MODEL"):
        from quarry.ml.train import describe

        name = words.name()
        words.end()
        try:
            model, columns = engine.model(name)
        except KeyError as error:
            raise RuntimeError(f"A model with the name {name} is not present.") from error
        return _rows(engine, [(k, str(v)) for k, v in sorted({**describe(model), "training_columns": columns}.items())], "Params", "Value")
    words.take("TABLE")
    return _columns(engine, words)


def _analyze(engine: Engine, words: Words) -> DataFrame:
    """Count, mean, deviation and quartiles of columns, a row for each."""
    frame = engine.table(words.name())
    words.need("COMPUTE", "STATISTICS")
    chosen = frame.columns
    if words.take("FOR"):
        if not words.take("ALL", "COLUMNS"):
            words.need("COLUMNS")
            chosen = [words.name()]
            while words.take(","):
                chosen.append(words.name())
    words.end()
    numeric = {f.name for f in frame.schema if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or f.dataType.typeName().startswith("decimal")}
    names = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    wanted = []
    for c in chosen:
        x, number = F.col(f"`{c}`"), c in numeric
        parts = [F.count(x), F.mean(x) if number else F.lit(None), F.stddev(x) if number else F.lit(None), F.min(x)]
        parts += [F.percentile_approx(x, q) if number else F.lit(None) for q in (0.25, 0.5, 0.75)] + [F.max(x)]
        wanted.append(F.array(*[p.cast("string") for p in parts]))
    found = frame.agg(F.array(*wanted).alias("x")).first().x  # one row
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    rows = [(n, *[found[k][j] for k in range(len(chosen))]) for j, n in enumerate(names)]
    rows += [("data_type", *[SQL_TYPES.get(kinds[c], kinds[c]) for c in chosen]), ("col_name", *chosen)]
    return _rows(engine, rows, "summary", *chosen)


def _explain(engine: Engine, words: Words) -> str:
    from quarry.plans.explain import MODES, plan_text

    mode = "formatted"
    if words.at < len(words.items) and words.items[words.at].key.lower() in MODES:
        mode = words.items[words.at].key.lower()
        words.at += 1
    return plan_text(engine._run(words.query()), mode)


def _export(engine: Engine, words: Words) -> None:
    from quarry.ml.export import export

    name = words.name()
    words.need("WITH")
    given = options(words.group())
    words.end()
    try:
        model, _ = engine.model(name)
    except KeyError as error:
        raise RuntimeError(f"A model with the name {name} is not present.") from error
    export(model, **given)


HANDLERS: list[tuple[tuple[str, ...], Callable[[Engine, Words], Any]]] = [
    (("CREATE",), _create),
    (("DROP",), _drop),
    (("ALTER",), _alter),
    (("USE", "SCHEMA"), _use),
    (("SHOW",), _show),
    (("DESCRIBE",), _describe),
    (("DESC",), _describe),
    (("ANALYZE", "TABLE"), _analyze),
    (("EXPLAIN",), _explain),
    (("EXPORT", "MODEL"), _export),
]


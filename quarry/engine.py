"""The engine: SQL in, Catalyst plans, DataFrames out."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.catalog import CATALOG, DEFAULT_SCHEMA, Function, Schema, Table
from quarry.dialect import commands
from quarry.dialect.rewrite import ends_operand, operand_end, operand_start, rewrite
from quarry.dialect.tokenizer import Group, Token, find, fragment, parse, render, split, statements, tick, written
from quarry.errors import ParsingException
from quarry.functions.tree import aggregate, in_steps
from quarry.functions.udf import grouped_udf, row_udf, scalar_udf, type_name
from quarry.plans.explain import plan_text
from quarry.plans.settings import defaults, overlay, settings
from quarry.session import at_home, branch, build_session, ship
from quarry.sources import to_frame

_number = itertools.count()
#: Words after which a table is named, and words that end a FROM clause.
_FROM_ENDS = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "QUALIFY", "DISTRIBUTE", "CLUSTER", "SORT", "SELECT", "LATERAL"}
#: Types whose values a parameter takes without loss.
_WIDER = {"double": ("double", "float", "bigint", "int", "smallint", "tinyint"), "float": ("float", "smallint", "tinyint"), "bigint": ("bigint", "int", "smallint", "tinyint"), "int": ("int", "smallint", "tinyint"), "smallint": ("smallint", "tinyint"), "string": ("string",)}
_BEFORE_NAMES = {"END", "NULL", "TRUE", "FALSE"}
_NO_ALIAS = _FROM_ENDS | {"ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "SEMI", "ANTI", "OUTER", "TABLESAMPLE", "PIVOT", "UNPIVOT", ",", ")"}


class Engine:
    """Tables, functions and models by schema, and SQL over them."""

    def __init__(self, spark: SparkSession | None = None, config: dict[str, Any] | None = None):
        self.spark = spark or build_session()
        ship(self.spark)
        self.id = next(_number)
        self.catalog = CATALOG
        self.schema_name = DEFAULT_SCHEMA
        self.schemas: dict[str, Schema] = {DEFAULT_SCHEMA: Schema(DEFAULT_SCHEMA)}
        self.config = dict(config or {})
        settings(self.config)  # unknown options are an error here
        self._views = itertools.count()
        self._now = self.spark  # the session that the statement at hand runs in

    # Tables and schemas

    def schema(self, name: str | None = None) -> Schema:
        name = name or self.schema_name
        if name not in self.schemas:
            raise KeyError(f"Schema {name} not found.")
        return self.schemas[name]

    def create_table(self, table_name: str, input_table: Any, format: str | None = None, persist: bool = False, schema_name: str | None = None, statistics: float | None = None, gpu: bool = False, **options: Any) -> None:
        """Register a DataFrame, a pandas frame, a location, a catalog entry, or a list of such."""
        if gpu:
            raise NotImplementedError("GPU tables")
        frame = to_frame(self.spark, input_table, format, **options)
        if persist:
            frame = frame.persist()
        self.register(table_name, frame, schema_name, statistics, input_table if isinstance(input_table, str) else None)

    def register(self, table_name: str, frame: DataFrame, schema_name: str | None = None, rows: float | None = None, path: str | None = None) -> None:
        view = f"q{self.id}_{next(self._views)}"
        frame = at_home(self.spark, frame)
        frame.createOrReplaceTempView(view)
        self.schema(schema_name).tables[table_name.lower()] = Table(frame, view, rows, path)

    def drop_table(self, table_name: str, schema_name: str | None = None) -> None:
        table = self.schema(schema_name).tables.pop(table_name.lower())
        self.spark.catalog.dropTempView(table.view)

    def alter_table(self, old_name: str, new_name: str, schema_name: str | None = None) -> None:
        tables = self.schema(schema_name).tables
        tables[new_name.lower()] = tables.pop(old_name.lower())

    def create_schema(self, name: str) -> None:
        self.schemas[name] = Schema(name)

    def drop_schema(self, name: str) -> None:
        if name == DEFAULT_SCHEMA:
            raise RuntimeError(f"the default schema {name} has to stay")
        for table in self.schemas.pop(name).tables.values():
            self.spark.catalog.dropTempView(table.view)
        if self.schema_name == name:
            self.schema_name = DEFAULT_SCHEMA

    def alter_schema(self, old_name: str, new_name: str) -> None:
        schema = self.schemas.pop(old_name)
        schema.name = new_name
        self.schemas[new_name] = schema
        if self.schema_name == old_name:
            self.schema_name = new_name

    def table(self, name: str) -> DataFrame:
        parts = name.lower().split(".")
        found = self._table(parts)
        if found is None:
            raise KeyError(f"Table {name} not found.")
        return found.frame

    def _table(self, parts: list[str]) -> Table | None:
        if len(parts) == 3 and parts[0] == self.catalog:
            parts = parts[1:]
        if len(parts) == 1:
            return self.schemas[self.schema_name].tables.get(parts[0])
        names = {k.lower(): v for k, v in self.schemas.items()}
        return names[parts[0]].tables.get(parts[1]) if len(parts) == 2 and parts[0] in names else None

    # Functions

    def register_function(self, f: Callable, name: str, parameters: list[tuple[str, Any]], return_type: Any, replace: bool = False, schema_name: str | None = None, row_udf: bool = False) -> None:
        """A scalar function: of whole columns, or with ``row_udf`` of a row and further values."""
        self._register(f, name, parameters, return_type, replace, schema_name, False, row_udf)

    def register_aggregation(self, f: Any, name: str, parameters: list[tuple[str, Any]], return_type: Any, replace: bool = False, schema_name: str | None = None) -> None:
        """An aggregate: a function of a series, or an object with ``chunk``, ``agg`` and ``finalize``."""
        self._register(f, name, parameters, return_type, replace, schema_name, True, False)

    def _register(self, f: Any, name: str, parameters: list, return_type: Any, replace: bool, schema_name: str | None, aggregate: bool, row: bool) -> None:
        functions, key = self.schema(schema_name).functions, name.lower()
        kinds = tuple(type_name(k) for _, k in parameters)
        known = functions.get(key)
        if known is not None and not replace and known.f is not f:
            raise ValueError(f"a different function {name} is registered")
        if known is None or replace:
            known = functions[key] = Function(aggregate, f=f, row=row, returns=return_type)
        spark_name = f"q{self.id}_f{next(self._views)}"
        make = grouped_udf if aggregate else row_udf if row else scalar_udf
        self.spark.udf.register(spark_name, make(f, [n for n, _ in parameters], type_name(return_type)))
        known.overloads[kinds] = spark_name

    # Models

    def register_model(self, model_name: str, model: Any, training_columns: list[str], schema_name: str | None = None) -> None:
        self.schema(schema_name).models[model_name.lower()] = (model, list(training_columns))

    def register_experiment(self, name: str, results: DataFrame, schema_name: str | None = None) -> None:
        self.schema(schema_name).experiments[name.lower()] = results

    def model(self, name: str) -> tuple[Any, list[str]]:
        schema, _, own = name.lower().rpartition(".")
        models = self.schema(schema or None).models
        if own not in models:
            raise KeyError(f"A model with the name {name} is not present.")
        return models[own]

    # SQL

    def sql(self, sql: str, return_futures: bool = True, dataframes: dict[str, Any] | None = None, gpu: bool = False, config_options: dict[str, Any] | None = None) -> DataFrame | pd.DataFrame | None:
        """One statement.  A query gives a DataFrame (a pandas frame without ``return_futures``); others what they return or None."""
        for name, frame in (dataframes or {}).items():
            self.create_table(name, frame, gpu=gpu)
        found = statements(sql)
        if len(found) != 1:
            raise RuntimeError(f"one statement is expected, not {len(found)}, in: {sql}" if found else "there is no statement")
        wanted = settings(defaults() | self.config | (config_options or {}))
        before = self._now
        # A frame is planned by its session when it runs, so options need a session that keeps them.
        self._now = branch(self.spark, wanted) if wanted else self.spark
        try:
            with overlay(self._now, {"spark.sql.timestampType": "TIMESTAMP_NTZ"}):
                out = self._run(found[0])
        finally:
            self._now = before
        return out.toPandas() if isinstance(out, DataFrame) and not return_futures else out

    def _run(self, statement: Group) -> Any:
        handled, out = commands.run(self, statement)
        return out if handled else self.query(statement)

    def query(self, statement: Group) -> DataFrame:
        """The DataFrame of a SELECT (as a parsed tree)."""
        text = render(statement)
        if (frame := self._in_steps(statement)) is not None:
            return frame
        try:
            rewrite(statement)
            self._resolve(statement, set())
            frame = self._analyse(statement)
        except (AnalysisException, ParseException) as error:
            raise ParsingException(f"{error}\nin: {text}") from error
        return self._unique(frame)

    def _analyse(self, statement: Group) -> DataFrame:
        try:
            frame = self._now.sql(render(statement))
        except AnalysisException as error:
            if "DATATYPE_MISMATCH" not in str(error) or not _days(statement, self._moments()):
                raise
            frame = self._now.sql(render(statement))
        return self._now.sql(render(statement)) if self._whole_division(statement) else frame

    def _in_steps(self, statement: Group) -> DataFrame | None:
        """Groups with registered aggregations: those in steps are reduced task by task, others and Spark's own are grouped by themselves, and
        the groups are joined by their keys.  None: there are none, or nothing to part."""
        items = statement.items
        source, by = find(items, "FROM"), find(items, "GROUP", "BY")
        own = {name: f for name, f in self.schemas[self.schema_name].functions.items() if f.aggregate}
        if not own or source < 0 or items[0].key != "SELECT" or any(x.key in _FROM_ENDS - {"WHERE", "GROUP", "ORDER", "LIMIT", "OFFSET"} | {"DISTINCT", "ROLLUP", "CUBE", "SETS"} for x in items[1:]):
            return None
        end = min((k for k in range(source, len(items)) if items[k].key in ("ORDER", "LIMIT", "OFFSET")), default=len(items))
        keys = [render(k) for k in split(items[by + 2 : end])] if by > 0 else []
        rest = [f"{k} AS `k{i}`" for i, k in enumerate(keys)]
        inner, outer, steps, plain, builtin = list(rest), [], {}, list(rest), list(rest)
        for part in split(items[1:source]):
            at = find(part, "AS")
            body, name = (part[:at], render(part[at:])) if at > 0 else (part, "AS " + tick(render(part)))
            f = own.get(body[0].text.lower()) if len(body) == 2 and body[0].kind == "word" and isinstance(body[1], Group) else None
            if f is not None and in_steps(f.f) and len(split(body[1].items)) == 1:
                inner.append(f"{render(body[1].items)} AS `a{len(steps)}`")
                outer.append(f"`v{len(steps)}` {name}")
                steps[f"v{len(steps)}"] = (f.f, f"a{len(steps)}", type_name(f.returns))
            elif render(body) in keys:
                outer.append(f"g.`k{keys.index(render(body))}` {name}")
            elif f is not None or not _calls_any(body, own):
                listed, mark = (plain, "p") if f is not None else (builtin, "b")
                listed.append(f"{render(body)} AS `{mark}{len(listed)}`")
                outer.append(f"`{mark}{len(listed) - 1}` {name}")
            else:
                return None
        if not steps and (len(plain) == len(rest) or len(builtin) == len(rest)):
            return None
        body = render(items[source : by if by > 0 else end])
        grouped = f"{body} GROUP BY {', '.join(keys)}" if keys else body
        frames = [aggregate(self.query(parse(f"SELECT {', '.join(inner)} {body}")), [f"k{i}" for i in range(len(keys))], steps)] if steps else []
        frames += [self.query(parse(f"SELECT {', '.join(x)} {grouped}")) for x in (plain, builtin) if len(x) > len(rest)]
        joined = ""
        for alias, frame in zip("ghi", frames, strict=False):
            view = f"q{self.id}_s{next(self._views)}"
            at_home(self._now, frame).createOrReplaceTempView(view)
            on = " AND ".join(f"g.k{i} <=> {alias}.k{i}" for i in range(len(keys))) or "TRUE"
            joined += f" JOIN {view} {alias} ON {on}" if joined else f"{view} {alias}"
        return self.query(parse(f"SELECT {', '.join(outer)} FROM {joined} {render(items[end:])}"))

    def _moments(self) -> set[str]:
        """Names of columns that are time stamps."""
        return {f.name.lower() for s in self.schemas.values() for t in s.tables.values() for f in t.frame.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}

    def _whole_division(self, statement: Group) -> bool:
        """An output column of any SELECT, however deep, that divides whole numbers by whole numbers is whole; whether there is one.

        Only the analyser knows the types: the column is read with bitwise operators around what is divided, which take whole
        numbers alone, first all such columns at once, then one by one.
        """
        found = list(_quotients(statement))
        if not found:
            return False

        def holds() -> bool:
            try:
                self._now.sql(render(statement))
            except (AnalysisException, ParseException):
                return False
            return True

        for q in found:
            q.token.text = q.probe
        if not holds():
            for q in found:
                q.token.text = q.plain
            for q in found:
                q.token.text = q.probe
                if not holds():
                    q.token.text = q.plain
        changed = False
        for q in found:
            if q.token.text == q.probe:
                q.token.text, changed = q.whole, True
        return changed

    def _resolve(self, group: Group, ctes: set[str]) -> None:
        """Names of tables, models in PREDICT and registered functions become what Spark knows them by."""
        items = group.items
        if items and items[0].key == "WITH":
            ctes = set(ctes)
            k = 2 if len(items) > 1 and items[1].key == "RECURSIVE" else 1
            while k < len(items) and items[k].kind in ("word", "tick"):
                ctes.add(items[k].text.strip("`").lower())
                while k < len(items) and items[k].key not in (",", "SELECT"):
                    k += 1
                if k == len(items) or items[k].key == "SELECT":
                    break
                k += 1
        self._calls(group)
        k, within, joined = 0, False, set()
        while k < len(items):
            key = items[k].key
            if key in ("FROM", "JOIN") or key == "," and within:
                within = within or key == "FROM"
                k += 1
                if k < len(items) and isinstance(items[k], Group) and items[k].items and items[k].items[0].key not in ("SELECT", "WITH", "VALUES", "FROM"):
                    items[k].items.insert(0, Token("word", "FROM"))  # a join in parentheses names tables, as a FROM clause does
                    self._resolve(items[k], ctes)
                    items[k].items.pop(0)
                    joined.add(id(items[k]))
                elif k < len(items) and items[k].key == "PREDICT" and k + 1 < len(items) and isinstance(items[k + 1], Group):
                    view = self._predict(items[k + 1])
                    items[k : k + 2] = [Token("tick", tick(view))]
                    if k + 1 == len(items) or items[k + 1].key in _NO_ALIAS:
                        items[k + 1 : k + 1] = fragment("AS predict")
                elif k < len(items) and items[k].kind in ("word", "tick"):
                    end = k + 1
                    while end + 1 < len(items) and items[end].key == ".":
                        end += 2
                    parts = [t.text.strip("`").lower() for t in items[k:end:2]]
                    table = None if len(parts) == 1 and parts[0] in ctes else self._table(parts)
                    if table is not None:
                        new = [Token("tick", tick(table.view))]
                        sampled = end < len(items) and items[end].key == "TABLESAMPLE"
                        if sampled:
                            stop = end + 2
                            while stop < len(items) and (items[stop].key == "REPEATABLE" or isinstance(items[stop], Group)):
                                stop += 1
                            new += items[end:stop]
                            end = stop
                        if end == len(items) or items[end].key in _NO_ALIAS:
                            new += [Token("word", "AS"), items[k + len(parts) * 2 - 2]]
                        items[k:end] = new
                continue
            if key in _FROM_ENDS:
                within = False
            k += 1
        for x in items:
            if isinstance(x, Group) and id(x) not in joined:
                self._resolve(x, ctes)

    def _calls(self, group: Group) -> None:
        items = group.items
        for k, x in enumerate(items[:-1]):
            if x.kind != "word" or not isinstance(items[k + 1], Group):
                continue
            functions = self.schemas[self.schema_name].functions
            if k > 1 and items[k - 1].key == "." and items[k - 2].text in self.schemas:
                functions = self.schemas[items[k - 2].text].functions
                if x.text.lower() in functions:
                    items[k - 2].text = items[k - 1].text = ""
            known = functions.get(x.text.lower())
            if known is not None:
                x.text = self._overload(known, x.text, items[k + 1])

    def _overload(self, known: Function, name: str, group: Group) -> str:
        count = len(split(group.items)) if group.items else 0
        able = {kinds: f for kinds, f in known.overloads.items() if len(kinds) == count}
        if not able:
            raise ParsingException(f"{name} isn't defined for {count} values")
        if len(able) == 1:
            return next(iter(able.values()))
        given = [self._kind(p) for p in split(group.items)]
        # Of several overloads that whose types are those of the values, else one that a value of these types can be passed to.
        for fits in (lambda a, b: a is None or a == b, lambda a, b: a is None or a in _WIDER.get(b, ())):
            for kinds, f in able.items():
                if all(fits(a, b) for a, b in zip(given, kinds, strict=True)):
                    return f
        return next(iter(able.values()))

    def _kind(self, items: list) -> str | None:
        """Spark's type of a literal, a cast or a column whose name has one type in the schema's tables; None: it isn't known here."""
        if len(items) == 1 and items[0].kind == "number":
            return "double" if "." in items[0].text or "e" in items[0].text.lower() else "bigint"
        if len(items) == 1 and items[0].kind in ("string", "literal"):
            return "string"
        if len(items) == 2 and items[0].key == "CAST" and (at := find(items[1].items, "AS")) > 0:
            try:
                return type_name(render(items[1].items[at + 1 :]))
            except NotImplementedError:
                return None
        if items[-1].kind in ("word", "tick") and all(x.key == "." for x in items[1::2]) and len(items) % 2:
            name = items[-1].text.strip("`").lower()
            kinds = {f.dataType.simpleString() for t in self.schemas[self.schema_name].tables.values() for f in t.frame.schema if f.name.lower() == name}
            return kinds.pop() if len(kinds) == 1 else None
        return None

    def _predict(self, group: Group) -> str:
        from quarry.ml.predict import predict

        if not group.items or group.items[0].key != "MODEL":
            raise ParsingException("PREDICT needs MODEL name, SELECT ...")
        parts = split(group.items)
        name = "".join(t.text.strip("`") for t in parts[0][1:])
        rest = Group(group.items[len(parts[0]) + 1 :], root=True)
        model, columns = self.model(name)
        frame = at_home(self._now, predict(model, columns, self._run(parse(render(rest)))))
        view = f"q{self.id}_p{next(self._views)}"
        frame.createOrReplaceTempView(view)
        return view

    def _unique(self, frame: DataFrame) -> DataFrame:
        """Names that occur twice are qualified, as far as that tells them apart."""
        doubled = {c for c, n in Counter(frame.columns).items() if n > 1}
        if not doubled:
            return frame
        output = frame._jdf.queryExecution().analyzed().output()
        names = []
        for k, c in enumerate(frame.columns):
            qualifier = output.apply(k).qualifier()
            names.append(f"{qualifier.last()}.{c}" if c in doubled and qualifier.nonEmpty() else c)
        return frame.toDF(*names)

    def explain(self, sql: str, dataframes: dict[str, Any] | None = None, mode: str = "formatted") -> str:
        return plan_text(self.sql(sql, dataframes=dataframes), mode)

    def visualize(self, sql: str, filename: str = "plan.txt") -> None:
        with open(filename, "w", encoding="utf-8") as file:
            file.write(self.explain(sql, mode="extended"))

    # Serving

    def run_server(self, **options: Any):
        from quarry.server.app import run_server

        self.server = run_server(self, **options)
        return self.server

    def stop_server(self) -> None:
        if getattr(self, "server", None):
            self.server.stop()
        self.server = None

    def ipython_magic(self, auto_include: bool = False) -> None:
        from quarry.notebook import register

        register(self, auto_include)


@dataclass
class _Quotient:
    """An output column with a division: its token, and its text as it is, as a test for whole numbers, and as a whole number."""

    token: Token
    plain: str
    probe: str
    whole: str


def _quotients(group: Group) -> Iterator[_Quotient]:
    for x in group.items:
        if isinstance(x, Group):
            yield from _quotients(x)
    items, at = group.items, 0
    while (at := find(items, "SELECT", start=at)) >= 0:
        first = at + 2 if at + 1 < len(items) and items[at + 1].key in ("DISTINCT", "ALL") else at + 1
        end = min((k for k in range(first, len(items)) if items[k].key in _FROM_ENDS or items[k].key == "FROM" and not _compares(items, k)), default=len(items))
        new: list = []
        for part in split(items[first:end]):
            new += [Token("sign", ",")] if new else []
            alias = find(part, "AS")
            stop = alias if alias > 0 else len(part)
            if alias < 0 and len(part) > 1 and part[-1].kind in ("word", "tick") and ends_operand(part[-2]) and part[-1].key not in _BEFORE_NAMES:
                stop = len(part) - 1
            if not _divides(part[:stop]) or any(x.key in ("AND", "OR", "<", ">", "=", "<=", ">=", "<>", "!=", "||", "IN", "LIKE", "RLIKE", "IS", "BETWEEN", "NOT", "CASE") for x in part[:stop]):
                new += part
                continue
            text, name = render(part[:stop]), render(part[stop:]) or "AS " + tick(written(part[:stop]))
            places = [k for k, x in enumerate(part[:stop]) if x.key == "/"]
            alone = len(places) == 1 and operand_start(part, places[0]) == 0 and operand_end(part, places[0] + 1) == stop and not any(isinstance(x, Group) and _divides(x.items) for x in part[:stop])
            whole = f"(({render(part[: places[0]])}) DIV ({render(part[places[0] + 1 : stop])}))" if alone else f"CAST({text} AS BIGINT)"
            token = Token("literal", f"{text} {name}")
            new.append(token)
            yield _Quotient(token, token.text, f"(({render(_tested(part[:stop]))}) | 0) {name}", f"{whole} {name}")
        items[first:end] = new
        at = first


def _calls_any(items: list, names: dict[str, Any]) -> bool:
    return any(_calls_any(x.items, names) if isinstance(x, Group) else x.kind == "word" and x.text.lower() in names for x in items)


def _divides(items: list) -> bool:
    return any(x.key == "/" or isinstance(x, Group) and x.items and x.items[0].key not in ("SELECT", "WITH") and _divides(x.items) for x in items)


def _tested(items: list) -> list:
    """The expression with whole division of what bitwise operators take, at every level."""
    out = [Group(_tested(x.items), root=x.root) if isinstance(x, Group) and _divides([x]) else x for x in items]
    for k in reversed([k for k, x in enumerate(out) if x.key == "/"]):
        left, right = operand_start(out, k), operand_end(out, k + 1)
        sides = [Token("literal", f"(({render(x)}) | 0)") for x in (out[left:k], out[k + 1 : right])]
        out[left:right] = [Group([sides[0], Token("word", "DIV"), sides[1]])]
    return out


def _compares(items: list, k: int) -> bool:
    """FROM of IS DISTINCT FROM."""
    return k > 0 and items[k - 1].key == "DISTINCT" and k > 1 and items[k - 2].key in ("IS", "NOT")


def _days(group: Group, moments: set[str]) -> bool:
    """``time stamp +- whole number`` counts days."""
    changed, items = False, group.items
    for k, x in enumerate(items):
        if isinstance(x, Group):
            changed |= _days(x, moments)
        elif x.key in ("+", "-") and 0 < k < len(items) - 1 and (items[k - 1].text.strip("`").lower() in moments if items[k - 1].kind in ("word", "tick") else k > 1 and items[k - 2].key == "TIMESTAMP") and re.fullmatch(r"\d+", getattr(items[k + 1], "text", "")):
            items[k + 1].text, items[k + 1].kind = f"INTERVAL '{items[k + 1].text}' DAY", "literal"
            changed = True
    return changed


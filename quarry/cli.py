"""A prompt for SQL."""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from pyspark.sql import DataFrame

HELP = r"""\l                list schemas            \d? [schema]  help, or with a name its tables
\dt [schema]      list tables             \df [schema]  list functions
\dm [schema]      list models             \de [schema]  list experiments
\dss [schema]     switch the schema       \dsc          the catalog
\conninfo         the Spark session       quit, \q      leave"""


class Prompt:
    def __init__(self, engine, out: TextIO = sys.stdout, rows: int = 50):
        self.engine, self.out, self.rows = engine, out, rows

    def show(self, value) -> None:
        if isinstance(value, DataFrame):
            found = value.limit(self.rows).toPandas()
            value = found.to_string(index=False) if len(found.columns) else "(no columns)"
        if value is not None:
            print(value, file=self.out)

    def listed(self, title: str, names) -> None:
        print("\n".join([title, *(f"  {n}" for n in names)]), file=self.out)

    def meta(self, line: str) -> bool:
        """Whether the line was a command of the prompt."""
        word, _, name = line.partition(" ")
        name = name.strip() or None
        engine = self.engine
        if word in ("\\?", "\\d?", "help", "?"):
            print(HELP, file=self.out)
        elif word == "\\l":
            self.listed("Schemas", engine.schemas)
        elif word == "\\dt":
            self.listed("Tables", engine.schema(name).tables)
        elif word == "\\df":
            self.listed("Functions", engine.schema(name).functions)
        elif word == "\\dm":
            self.listed("Models", engine.schema(name).models)
        elif word == "\\de":
            self.listed("Experiments", engine.schema(name).experiments)
        elif word == "\\dss":
            if name not in engine.schemas:
                print(f"Schema {name} not available", file=self.out)
            else:
                engine.schema_name = name
        elif word == "\\dsc":
            self.listed("Catalog", [engine.catalog])
        elif word == "\\conninfo":
            context = engine.spark.sparkContext
            print(f"Spark {context.version} at {context.master}, application {context.applicationId}", file=self.out)
        else:
            return False
        return True

    def line(self, line: str) -> bool:
        """Do one line; False to leave."""
        line = line.strip().removesuffix(";").strip()
        if line in ("quit", "exit", "\\q"):
            return False
        try:
            if line and not self.meta(line):
                self.show(self.engine.sql(line))
        except Exception as error:  # noqa: BLE001  the prompt goes on
            print(f"{type(error).__name__}: {error}", file=self.out)
        return True

    def loop(self, source: TextIO | None = None) -> None:
        while True:
            try:
                line = source.readline() if source else input("(quarry) > ")
            except (EOFError, KeyboardInterrupt):
                return
            if source and not line or not self.line(line):
                return


def main(args: list[str] | None = None) -> None:
    from quarry.engine import Engine
    from quarry.session import build_session

    parser = argparse.ArgumentParser(prog="quarry", description="a prompt for SQL")
    parser.add_argument("--master", default=None)
    parser.add_argument("--table", action="append", default=[], metavar="NAME=LOCATION")
    given = parser.parse_args(args)
    engine = Engine(build_session(master=given.master))
    for entry in given.table:
        name, _, location = entry.partition("=")
        engine.create_table(name, location)
    Prompt(engine).loop()


if __name__ == "__main__":
    main()

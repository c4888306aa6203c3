"""The HTTP server: statements are planned at once and run in a pool; results are fetched by query."""

from __future__ import annotations

import argparse
import json
import logging
import threading
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame

from quarry.server import jdbc_meta
from quarry.server.responses import answer, failure

log = logging.getLogger(__name__)


class Queries:
    """Statements that run or have run, by id."""

    def __init__(self, engine, workers: int = 8, limit: int = 100_000):
        self.engine, self.limit = engine, limit
        self.pool = ThreadPoolExecutor(workers)
        self.running: dict[str, tuple[Future, Any]] = {}
        self.lock = threading.Lock()

    def submit(self, sql: str) -> tuple[str, Any]:
        query = uuid.uuid4().hex
        with self.lock:  # an engine's catalog is for one statement at a time
            if "system.jdbc" in sql:
                jdbc_meta.refresh(self.engine)
                sql = sql.replace("system.jdbc", jdbc_meta.SCHEMA)
            out = self.engine.sql(sql)
        if isinstance(out, DataFrame):
            self.running[query] = (self.pool.submit(self._collect, query, out), out.schema)
        return query, out

    def _collect(self, query: str, frame: DataFrame) -> list:
        frame.sparkSession.sparkContext.setJobGroup(query, "statement", interruptOnCancel=True)
        rows = frame.limit(self.limit + 1).collect()  # a client's result, bounded
        if len(rows) > self.limit:
            raise ValueError(f"the result has more than {self.limit} rows; write it to a table")
        return rows

    def cancel(self, query: str) -> bool:
        found = self.running.pop(query, None)
        if found is None:
            return False
        self.engine.spark.sparkContext.cancelJobGroup(query)
        found[0].cancel()
        return True


class Handler(BaseHTTPRequestHandler):
    queries: Queries

    def _send(self, body: dict[str, Any], status: int = 200) -> None:
        data = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    @property
    def base(self) -> str:
        return f"http://{self.headers.get('Host', 'localhost')}"

    def do_POST(self) -> None:
        if self.path.rstrip("/") != "/v1/statement":
            return self._send({"error": "not found"}, 404)
        sql = self.rfile.read(int(self.headers.get("Content-Length", 0))).decode()
        query = ""
        try:
            query, out = self.queries.submit(sql)
        except Exception as error:  # noqa: BLE001  whatever it is, the client is told
            log.warning("a statement failed: %s", error)
            return self._send(failure(query or uuid.uuid4().hex, self.base, error))
        if isinstance(out, DataFrame):
            return self._send(answer(query, self.base, "QUEUED", pending=True))
        body = answer(query, self.base, "FINISHED")
        if isinstance(out, str):
            body |= {"columns": [{"name": "plan", "type": "varchar", "typeSignature": {"rawType": "varchar", "arguments": []}}], "data": [[out]]}
        return self._send(body)

    def do_GET(self) -> None:
        path = self.path.rstrip("/")
        if path == "/v1/empty":
            return self._send(answer("empty", self.base, "FINISHED"))
        query = path.removeprefix("/v1/status/")
        if query == path or query not in self.queries.running:
            return self._send({"error": "there is no such query"}, 404)
        future, schema = self.queries.running[query]
        if not future.done():
            return self._send(answer(query, self.base, "RUNNING", pending=True))
        del self.queries.running[query]
        error = future.exception()
        return self._send(failure(query, self.base, error) if error else answer(query, self.base, "FINISHED", schema, future.result()))

    def do_DELETE(self) -> None:
        query = self.path.rstrip("/").removeprefix("/v1/cancel/")
        found = self.queries.cancel(query)
        self._send(answer(query, self.base, "FINISHED") if found else {"error": "there is no such query"}, 200 if found else 404)

    def log_message(self, form: str, *args: Any) -> None:
        log.debug(form, *args)


class Server:
    def __init__(self, engine, host: str = "0.0.0.0", port: int = 8080, workers: int = 8):
        handler = type("OwnHandler", (Handler,), {"queries": Queries(engine, workers)})
        self.http = ThreadingHTTPServer((host, port), handler)
        self.port = self.http.server_address[1]
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)

    def start(self) -> Server:
        self.thread.start()
        return self

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()


def run_server(engine=None, host: str = "0.0.0.0", port: int = 8080, blocking: bool = False, jdbc_metadata: bool = True) -> Server:
    from quarry.engine import Engine

    engine = engine or Engine()
    if jdbc_metadata:
        jdbc_meta.refresh(engine)
    server = Server(engine, host, port).start()
    if blocking:
        try:
            server.thread.join()
        except KeyboardInterrupt:
            server.stop()
    return server


def main(args: list[str] | None = None) -> None:
    from quarry.engine import Engine
    from quarry.session import build_session

    parser = argparse.ArgumentParser(prog="quarry-server", description="SQL over HTTP")
    parser.add_argument("--host", default="0.0.0.0")
    parser.add_argument("--port", type=int, default=8080)
    parser.add_argument("--master", default=None, help="the Spark master")
    parser.add_argument("--log-level", default="INFO")
    parser.add_argument("--table", action="append", default=[], metavar="NAME=LOCATION", help="a table to begin with")
    parser.add_argument("--startup", action="store_true", help="plan one statement before serving")
    given = parser.parse_args(args)
    logging.basicConfig(level=given.log_level.upper())
    engine = Engine(build_session(master=given.master))
    for entry in given.table:
        name, _, location = entry.partition("=")
        engine.create_table(name, location)
    if given.startup:
        engine.sql("SELECT 1 + 1 AS two").collect()
    run_server(engine, given.host, given.port, blocking=True)


if __name__ == "__main__":
    main()

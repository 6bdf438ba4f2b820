"""A small HTTP front: PUT makes a database, POST runs statements in it, GET shows its
branches, DELETE drops it. One statement at a time; results have `limit` rows at most, which
is a feature of the transport (0: all)."""

from __future__ import annotations

import itertools
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .errors import StatementError
from .types import show
from .vsql import Session
from .vsql.parser import split


class Databases:
    def __init__(self, spark):
        self.spark, self.numbers, self.all, self.lock = spark, itertools.count(1), {}, threading.Lock()

    def new(self) -> int:
        n = next(self.numbers)
        self.all[n] = Session(self.spark)
        return n

    def run(self, n: int, text: str, limit: int = 0) -> list[dict]:
        out = []
        with self.lock:
            for statement in split(text):
                got, timings = self.all[n].timed(statement, lambda df: (df.columns, (df.limit(limit) if limit else df).collect()))
                columns, rows = got or ([], [])
                out.append({"columns": columns, "content": [[show(v) for v in r] for r in rows], "timings": timings})
        return out


def handler(databases: Databases):
    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, value) -> None:
            body = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def number(self) -> int | None:
            n = self.path.strip("/")
            if n.isdigit() and int(n) in databases.all:
                return int(n)
            self.reply(404, {"error": f"there is no database '{n}'"})
            return None

        def do_PUT(self):
            self.reply(200, {"id": databases.new()})

        def do_POST(self):
            if (n := self.number()) is not None:
                text = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
                try:
                    self.reply(200, databases.run(n, text))
                except StatementError as e:
                    self.reply(400, {"error": str(e)})
                except Exception as e:  # such as a division by zero in the rows: an answer all the same
                    self.reply(500, {"error": str(e).splitlines()[0] if str(e) else type(e).__name__})

        def do_GET(self):
            if (n := self.number()) is not None:
                with databases.lock:
                    self.reply(200, databases.all[n].catalog.graph(counts=True))

        def do_DELETE(self):
            if (n := self.number()) is not None:
                with databases.lock:
                    catalog = databases.all.pop(n).catalog
                    for t in list(catalog.tables):
                        catalog.drop_table(t)
                self.reply(200, {})

        def log_message(self, *_):
            pass

    return Handler


def serve(spark, port: int = 5000) -> ThreadingHTTPServer:
    """Call serve_forever() on the result."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(Databases(spark)))

"""python -m forkline.cli: named queries, their timings, or statements from the terminal."""

from __future__ import annotations

import argparse
import sys
import time

from .errors import StatementError
from .plans import catalogue
from .session import session
from .streaming.sink import print_rows
from .vsql import Session


def repl(db: Session, lines, out=sys.stdout) -> None:
    """A statement a line, until quit; errors are reported and don't end the loop."""
    for line in lines:
        text = line.strip()
        if text in ("quit", "quit;"):
            return
        if not text:
            continue
        try:
            rows = db.sql(text)
            if rows is not None:
                print_rows(rows, out)
        except StatementError as e:
            print(f"error: {e}", file=out)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("-q", "--query", help="a named query: its rows")
    p.add_argument("-b", "--bench", help="a named query: its seconds")
    p.add_argument("-n", type=int, default=3, help="how often -b runs it")
    p.add_argument("-d", "--data", default="/root/testdata/sf0.001", help="the folder with the tables")
    p.add_argument("-t", "--table", action="append", default=[], metavar="NAME=PATH:KEY", help="a Parquet table to register for statements")
    a = p.parse_args(argv)
    spark = session()
    for name in filter(None, (a.query, a.bench)):
        if name not in catalogue.QUERIES:
            print(f"queries: {', '.join(sorted(catalogue.QUERIES))}", file=sys.stderr)
            return 1
    if a.query:
        print_rows(catalogue.QUERIES[a.query](spark, a.data))
    elif a.bench:
        for _ in range(a.n):
            t = time.perf_counter()
            catalogue.QUERIES[a.bench](spark, a.data).write.format("noop").mode("overwrite").save()
            print(f"{a.bench}\t{time.perf_counter() - t:.3f}")
    else:
        db = Session(spark)
        for spec in a.table:
            name, _, rest = spec.partition("=")
            path, _, key = rest.rpartition(":")
            db.catalog.register(name, spark.read.parquet(path), key)
        repl(db, sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())

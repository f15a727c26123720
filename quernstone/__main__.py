"""Queries from the command line.

    python -m quernstone list
    python -m quernstone run NAME --data FOLDER --out FOLDER [--master local[8]] [--csv FOLDER] [--limit N]
    python -m quernstone status --out FOLDER

--also names a module with more QUERIES, such as that of the text operators.
A run is sealed under an identity of its inputs, code and arguments; a second
run of the same identity makes nothing again. --limit shows rows, and keeps all.
"""

from __future__ import annotations

import argparse
import importlib
import json

from quernstone import session
from quernstone.plans import catalogue
from quernstone.sources import runs, sinks


def queries(also: list[str]) -> dict:
    found = dict(catalogue.QUERIES)
    for module in also:
        found |= importlib.import_module(module).QUERIES
    return found


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("action", choices=("list", "run", "status"))
    p.add_argument("name", nargs="?")
    p.add_argument("--also", action="append", default=[], metavar="MODULE")
    for option in ("--data", "--out", "--csv"):
        p.add_argument(option)
    p.add_argument("--master", default="local[*]")
    p.add_argument("--limit", type=int, default=20)
    a = p.parse_args(arguments)
    known = queries(a.also)
    if a.action == "list":
        print("\n".join(sorted(known)))
        return 0
    if not a.out or (a.action == "run" and (a.name not in known or not a.data)):
        p.error("run needs a known NAME, --data and --out; status needs --out")
    spark = session.build(a.master)
    if a.action == "status":
        print("\n".join(json.dumps(r, sort_keys=True) for r in runs.status(spark, a.out)))
        return 0
    session.ship(spark)
    run_id = runs.identity({"data": runs.files_of(spark, a.data)}, runs.code_version(), {"query": a.name})
    folder, rows = runs.run(spark, a.out, a.name, lambda: known[a.name](spark, a.data), run_id)
    result = spark.read.parquet(f"{folder}/rows")
    if a.csv:
        sinks.export_csv(result, a.csv)
    result.show(a.limit, truncate=60)
    print(json.dumps({"folder": folder, "rows": rows}))
    session.release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""python -m tessergrid list | run NAME [--data DIR] [--limit N] | explain NAME: queries from the shell, answers as JSON lines."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import functions as F

from . import get_session, registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessergrid", description=__doc__)
    parser.add_argument("action", choices=("list", "run", "explain"))
    parser.add_argument("name", nargs="?")
    parser.add_argument("--data", default="/root/testdata/sf0.001")
    parser.add_argument("--limit", type=int, default=20)
    args = parser.parse_args(argv)
    for module in ("catalog_queries", "evidence_queries", "runtime_queries", "store_queries"):
        importlib.import_module(f"tessergrid.plans.{module}")
    if args.action == "list":
        for name, q in sorted(registry.QUERIES.items()):
            print(name, *q.covers)
        return 0
    if args.name not in registry.QUERIES:
        print(f"no query {args.name}", file=sys.stderr)
        return 2
    spark = get_session("tessergrid", **{"spark.ui.enabled": "false"})
    df = registry.as_callables()[args.name](spark, args.data)
    if args.action == "explain":
        df.explain("formatted")
    else:
        for row in df.limit(args.limit).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect():
            print(row[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())

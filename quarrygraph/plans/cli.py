"""Command line over evidence tables in a folder: ``python -m quarrygraph.plans.cli query symbols --facts DIR``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions.text import response_text, structured
from quarrygraph.plans.paging import View
from quarrygraph.plans.request import COMMANDS, DEFAULT_LIMIT, QueryError, Spec, exit_code
from quarrygraph.plans.session import Session
from quarrygraph.plans.sessions import Registry, listing
from quarrygraph.sources.facts import read_facts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrygraph")
    sub = p.add_subparsers(dest="mode", required=True)
    q = sub.add_parser("query")
    q.add_argument("verb", choices=COMMANDS)
    q.add_argument("term", nargs="?", help="search text or symbol id")
    q.add_argument("--facts", required=True)
    for name in ("path", "project", "namespace", "kind", "direction", "cursor", "snapshot", "output"):
        q.add_argument(f"--{name}")
    q.add_argument("--group-by", default="")
    q.add_argument("--limit", type=int, default=DEFAULT_LIMIT)
    q.add_argument("--json", action="store_true")
    ps = sub.add_parser("ps")
    ps.add_argument("--registry", required=True)
    return p


def spec_of(a: argparse.Namespace) -> Spec:
    filters = {k: getattr(a, k) for k in ("path", "project", "namespace", "kind") if getattr(a, k) is not None}
    searching = a.verb in ("symbols", "usage-summary")
    return Spec(a.verb, search=a.term if searching else None, symbol_id=None if searching else a.term, filters=filters, direction=a.direction, group_by=tuple(x for x in a.group_by.split(",") if x), limit=a.limit, cursor=a.cursor, snapshot_id=a.snapshot, output_path=a.output)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.mode == "ps":
        for row in listing(Registry(a.registry)):
            print("  ".join(f"{k}={v}" for k, v in row.items()))
        return 0
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        decl = read_facts(spark, a.facts, "declarations")
        first = F.get("locations", F.lit(0))
        flat = decl.withColumns({"file": first["file"], "line": first["line"], "column": first["column"]}).drop("locations")
        out = Session(flat, read_facts(spark, a.facts, "observations"), view=View(warm=False)).run(spec_of(a))
    except QueryError as e:
        print(f"error {e.code}: {e}", file=sys.stderr)
        return exit_code(e.code)
    print(structured(out) if a.json else response_text(out))
    return 0 if out["success"] else exit_code(out["error"]["code"])


if __name__ == "__main__":
    sys.exit(main())

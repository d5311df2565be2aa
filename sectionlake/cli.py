"""Command line: python -m sectionlake.cli COMMAND STORE ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from sectionlake import tools
from sectionlake.operators import contents
from sectionlake.plans.engine import Engine, QueryError
from sectionlake.plans.ingest import INDEX_BUDGET, ingest
from sectionlake.plans.store import StoreError, open_store
from sectionlake.session import build_session
from sectionlake.sources.sections import Limits


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sectionlake", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *names: str, store: bool = True):
        p = sub.add_parser(name)
        if store:
            p.add_argument("--store", default=os.environ.get("SECTIONLAKE_STORE", "sectionlake.store"))
        for n in names:
            p.add_argument(n)
        p.add_argument("--json", action="store_true")
        return p

    p = command("ingest", "corpus")
    p.add_argument("--max-chars", type=int, default=Limits.max_chars)
    p.add_argument("--index-budget", type=int, default=INDEX_BUDGET)
    p.add_argument("--ignore", action="append", default=[])
    command("index").add_argument("prefix", nargs="?")
    p = command("search", "query")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--in", dest="within", action="append")
    command("read", "id").add_argument("--context", type=int, default=0)
    p = command("grep", "pattern")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--in", dest="within", action="append")
    p = command("neighbours", "id")
    p.add_argument("--before", type=int, default=1)
    p.add_argument("--after", type=int, default=1)
    command("export-chunks")
    command("preamble")
    command("tools-json", store=False)
    return top


def run(args: argparse.Namespace, spark=None) -> int:
    if args.command == "tools-json":
        sys.stdout.write(tools.tools_json())
        return 0
    spark = spark or build_session()
    if args.command == "ingest":
        report = ingest(spark, args.corpus, args.store, limits=Limits(max_chars=args.max_chars), index_budget=args.index_budget, ignore=tuple(args.ignore), progress=lambda m: print(m, file=sys.stderr))
        print(json.dumps(report.to_dict(), ensure_ascii=False))
        return 0
    engine = Engine(open_store(spark, args.store))
    if args.command == "export-chunks":
        for row in engine.export_chunks().toLocalIterator():
            print(row[0])
        return 0
    if args.command == "preamble":
        print(contents.DISCIPLINE + "\n\n" + engine.index())
        return 0
    names = {"index": ("prefix",), "search": ("query", "limit"), "read": ("id", "context"), "grep": ("pattern", "regex", "limit"), "neighbours": ("id", "before", "after")}[args.command]
    arguments = {n: getattr(args, n) for n in names} | ({"in": args.within} if getattr(args, "within", None) else {})
    result = tools.call(engine, args.command, arguments)
    print(result if isinstance(result, str) else json.dumps(result, indent=None if args.json else 1, ensure_ascii=False))
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    """0 for a result, 1 for a query's error, 2 for a wrong call or store, 130 for an interrupt."""
    args = parser().parse_args(argv)
    try:
        return run(args, spark)
    except QueryError as e:
        print(json.dumps(e.to_dict(), ensure_ascii=False), file=sys.stderr)
        return 1
    except (StoreError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())

"""Command line: run or explain any registered query.

    python -m lotquery list
    python -m lotquery run <query> <sf_dir> [--out PATH] [--format parquet|csv] [--show N]
    python -m lotquery explain <query> <sf_dir>
"""

from __future__ import annotations

import argparse
import os
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lotquery")
    sub = parser.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("sf_dir")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    run.add_argument("--show", type=int, default=20)
    explain = sub.add_parser("explain")
    explain.add_argument("query")
    explain.add_argument("sf_dir")
    args = parser.parse_args(argv)

    sys.path.insert(0, os.getcwd())
    from lotquery.plans.catalog import QUERIES, load_all
    load_all()
    if args.cmd == "list":
        for name in QUERIES:
            print(name)
        return 0
    if args.query not in QUERIES:
        parser.error(f"unknown query {args.query!r}; see 'python -m lotquery list'")

    from lotquery.session import build_session
    from lotquery.sources.sinks import export_report

    spark = build_session()
    df = QUERIES[args.query](spark, args.sf_dir)
    if args.cmd == "explain":
        df.explain("formatted")
    elif args.out:
        export_report(df, args.out, fmt=args.format)
        print(f"wrote {args.out}")
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

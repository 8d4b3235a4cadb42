"""``python -m larkfield``: list and run the registered queries, list sources, describe a published store."""

from __future__ import annotations

import argparse
import json

from larkfield.runtime import session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="larkfield")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("queries", help="names of the registered queries")
    commands.add_parser("sources", help="names of the source builders")
    run = commands.add_parser("run", help="one query over a folder of tables")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--output", help="write Parquet there instead of showing rows")
    run.add_argument("--rows", type=int, default=20)
    status = commands.add_parser("status", help="what a published store holds")
    status.add_argument("root")
    given = parser.parse_args(args)
    if given.command == "sources":
        from larkfield.sources.builders import REGISTRY

        print(*REGISTRY, sep="\n")
        return
    if given.command == "queries":
        from larkfield.plans import catalog

        print(*catalog.QUERIES, sep="\n")
        return
    spark = session()
    if given.command == "status":
        from larkfield.operators.corpus import profile
        from larkfield.sources.publish import Store

        store = Store(spark, given.root)
        rows = profile(store.read("documents"), "source", "kind").collect() if store.current() else []  # sources times kinds
        print(json.dumps({"version": store.current(), "documents": [r.asDict() for r in rows]}, ensure_ascii=False))
        return
    from larkfield.plans import catalog

    df = catalog.QUERIES[given.name](spark, given.tables)
    df.write.parquet(given.output) if given.output else df.show(given.rows, truncate=80)


if __name__ == "__main__":
    main()

"""Command line: export, import, restore and purge."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources.records import read_export


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 when it was done, else 1."""
    parser = argparse.ArgumentParser(prog="recollect")
    parser.add_argument("--store", required=True, help="folder of the store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("export", "import"):
        commands.add_parser(name).add_argument("path")
    commands.add_parser("restore").add_argument("id", type=int)
    purge = commands.add_parser("purge")
    purge.add_argument("id", type=int)
    purge.add_argument("--yes", action="store_true", help="without this nothing is removed")
    a = parser.parse_args(args)
    engine = Engine(spark or SparkSession.builder.appName("recollect").getOrCreate(), a.store)
    if a.command == "export":
        engine.export(a.path)
        print(json.dumps({"exported": engine.status()["memories"]}))
    elif a.command == "import":
        print(json.dumps(engine.import_records(read_export(engine.spark, a.path))))
    elif a.command == "restore":
        try:
            outcome = engine.restore(a.id)
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
        print(outcome)
        return int(outcome == "missing")
    else:
        if not a.yes:
            print("purge removes a row for good; say --yes", file=sys.stderr)
            return 1
        return int(not engine.purge(a.id))
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Answers JSON requests, one a line: python -m quarry FOLDER ROOT < requests; FOLDER holds the tables, ROOT the files."""

from __future__ import annotations

import argparse
import json
import sys

from . import __version__


def main(arguments: list[str] | None = None, lines=None, out=None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("root")
    parser.add_argument("--config", help="a JSON file of Spark settings, spark.quarry.* among them")
    parser.add_argument("--precise", action="store_true", help="use the precise extractors")
    parser.add_argument("--version", action="version", version=__version__)
    given = parser.parse_args(arguments)
    from pyspark.sql import SparkSession

    from .plans.engine import Engine

    builder = SparkSession.builder.appName("quarry")
    if given.config:
        with open(given.config, encoding="utf-8") as f:
            for name, value in json.load(f).items():
                builder = builder.config(name, value)
    engine = Engine(builder.getOrCreate(), given.folder, given.root, precise=given.precise)
    if engine.nodes().isEmpty():
        engine.index()
    for line in lines if lines is not None else sys.stdin:
        if line.strip():
            print(engine.handle(line), file=out or sys.stdout, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())

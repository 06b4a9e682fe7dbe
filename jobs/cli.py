"""What the command lines share: a small JSON config under explicit options, a session, a log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(name: str, run: Callable, paths: tuple[str, ...], argv: list[str] | None = None) -> None:
    """Calls run(spark, *paths, **config). The config file is read by Spark, so it may lie where the tables do."""
    parser = argparse.ArgumentParser(prog=name, description=run.__doc__)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file with run()'s further parameters")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        config = given.pop("config")
        extra = json.loads("\n".join(r.value for r in spark.read.text(config, wholetext=True).collect())) if config else {}
        run(spark, *(given[p] for p in paths), **extra)
    finally:
        spark.stop()

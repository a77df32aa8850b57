"""What the jobs share: their command line, sessions and logs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

log = logging.getLogger("meshframe.jobs")


def main(run: Callable, description: str | None, arguments: list[str] | None = None) -> None:
    """Read a config file, let ``--set name=value`` replace its entries, and call ``run`` with a session of its own.

    Values of ``--set`` are JSON where they can be read as such, and text otherwise.
    """
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", required=True, help="a JSON file with the arguments of the job")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="an argument in place of that of the file")
    asked = parser.parse_args(arguments)
    options = json.loads(Path(asked.config).read_text())
    for name, _, value in (x.partition("=") for x in asked.set):
        try:
            options[name] = json.loads(value)
        except ValueError:
            options[name] = value
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **options)
    finally:
        spark.stop()

"""What the jobs' command lines share: a JSON config, arguments that override it, a session of their own."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Sequence
from pathlib import Path


def settings(description: str, names: dict[str, str], argv: Sequence[str] | None) -> dict:
    """The config file's values, over which arguments of the same names win.

    ``names`` has the paths that a run needs, each with its help; a name that
    neither the file nor the arguments give, or a key in the file that is
    not one of them, ends the run.
    """
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="JSON file with the same names as the arguments")
    for name, text in names.items():
        parser.add_argument(f"--{name.replace('_', '-')}", help=text)
    given = vars(parser.parse_args(argv))
    config = given.pop("config")
    found = json.loads(Path(config).read_text(encoding="utf-8")) if config else {}
    if unknown := sorted(set(found) - set(names)):
        parser.error(f"unknown in {config}: {', '.join(unknown)}")
    found |= {k: v for k, v in given.items() if v is not None}
    if missing := [n for n in names if n not in found]:
        parser.error(f"not given: {', '.join(missing)}")
    return found


def start(app: str, run: Callable, found: dict) -> dict:
    """Run ``run(spark, **found)`` in a session that is stopped at the end."""
    from pyspark.sql import SparkSession

    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(app).getOrCreate()
    try:
        return run(spark, **found)
    finally:
        spark.stop()

"""What the jobs share: configuration, the session of a command line, logs."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

log = logging.getLogger("passagework.jobs")


def configured(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults with what the JSON file says in their place; the path may be remote."""
    if path is None:
        return dict(defaults)
    given = json.loads(spark.read.option("wholetext", True).text(path).first()[0])
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | given


def main(name: str, arguments: Sequence[str], defaults: dict, work: Callable[..., dict]) -> None:
    """Parses the command line, makes a session, runs ``work(spark, *arguments, config)`` in it and stops it."""
    import argparse

    parser = argparse.ArgumentParser(name)
    for a in arguments:
        parser.add_argument(f"--{a}", required=True)
    parser.add_argument("--config")
    given = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        work(spark, *(getattr(given, a) for a in arguments), configured(spark, given.config, defaults))
    finally:
        spark.stop()

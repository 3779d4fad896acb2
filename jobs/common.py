"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger("hexapla.jobs")


def settings(defaults: dict[str, Any], given: dict[str, Any] | None) -> dict[str, Any]:
    """The defaults with what is given instead; names that don't exist are an error."""
    unknown = set(given or {}) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return defaults | (given or {})


def main(run: Callable[..., dict[str, int]], name: str, paths: list[str], about: str) -> None:
    """Command line of a job: its paths, in order, and --config; its own session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for p in paths:
        parser.add_argument(p)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), help="JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *[getattr(args, p) for p in paths], config=config)
    finally:
        spark.stop()

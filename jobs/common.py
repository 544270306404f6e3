"""What the jobs share: command line, config file, log, counts that cost no pass of their own."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object over defaults, read by Spark so that it may be remote; a name that the job doesn't know is an error."""
    text = spark.read.text(path, wholetext=True).first()
    given = json.loads(text[0]) if text else {}
    if unknown := sorted(set(given) - set(defaults)):
        raise ValueError(f"{path}: unknown settings {unknown}; known are {sorted(defaults)}")
    return defaults | given


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """`df` and what counts its rows while they pass by."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def main(job: Callable, defaults: dict, paths: list[str], about: str) -> None:
    """The command line: plain paths, a config file; a session for just this run."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    parser = argparse.ArgumentParser(description=about)
    for p in paths:
        parser.add_argument(f"--{p}", required=True)
    parser.add_argument("--config", help="a JSON file of settings: " + json.dumps(defaults))
    given = vars(parser.parse_args())
    spark = SparkSession.builder.appName(about).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        config = read_config(spark, given["config"], defaults) if given["config"] else defaults
        job(spark, *[given[p] for p in paths], config)
    finally:
        spark.stop()

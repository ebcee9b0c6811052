"""What both jobs need: their config, their log, and a session for the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def config_of(job: str, path: str | None = None) -> dict:
    """The settings of the file at path, or of the one beside the job."""
    return json.loads(Path(path or Path(__file__).with_name(f"{job}.json")).read_text())


def log_of(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def started(parser: argparse.ArgumentParser, job: str, act: Callable[[SparkSession, argparse.Namespace, dict], dict], arguments: list[str] | None = None) -> dict:
    """The command line: reads the config, makes a session, runs the job, and stops the session."""
    parser.add_argument("--config", help="JSON of settings; without, the file beside the job")
    a = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(f"sightline {job}").getOrCreate()
    try:
        return act(spark, a, config_of(job, a.config))
    finally:
        spark.stop()

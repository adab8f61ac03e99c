"""What the jobs share: configuration, log, a session of their own for the command line, folders for registered queries."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
log = logging.getLogger("jobs")


def configuration(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of a new name under spark.checkpoint.dir, or on one machine where that is unset under a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tessella-jobs-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def command_line(name: str, config: str, paths: dict[str, str], work: Callable[..., int]) -> int:
    """Read the arguments, make a session, run the work in it and stop it; the work's number is the exit code."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}")
    for p, said in paths.items():
        parser.add_argument(f"--{p}", required=True, help=said)
    parser.add_argument("--config", default=str(HERE / config), help="a JSON file")
    args = parser.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        return work(spark, configuration(args.config), *(getattr(args, p) for p in paths))
    finally:
        spark.stop()

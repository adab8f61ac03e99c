"""Session settings that the library needs but never forces on a session it is handed."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and bench.py."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application.

    Python workers import the kernels by name; this makes that work wherever
    the driver found the package, without an install on the executors.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tessella-ship-")) / "tessella.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, Path("tessella") / p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._tessella_shipped = True


def by_value(module: str) -> None:
    """Send what a module defines along with each use, for Python processes that ship doesn't reach: those that plan stateful queries."""
    cloudpickle.register_pickle_by_value(sys.modules[module])

"""Sends this package to the executors of a session, for programs run from a source folder."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="framelake-")) / "framelake.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    return str(at)


_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once a Spark application."""
    app = spark.sparkContext.applicationId
    if app not in _sent:
        spark.sparkContext.addPyFile(_archive())
        _sent.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; one of its own only for a local master, whose executors are the driver itself."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")

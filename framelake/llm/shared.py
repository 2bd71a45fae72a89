"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from contextvars import ContextVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \t \n \v \f \r.
SEPARATORS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class.
SEPARATOR_CLASS = "[ \\t-\\r]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of at most a few dozen bytes that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: What `cut` has written inside the innermost `settled`.
_steps: ContextVar[list[str] | None] = ContextVar("steps", default=None)

M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only for a local master, whose executors are the driver itself."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="framelake-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """names, each with underscores before it until it is none of columns."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: computed once, lineage ends here."""
    at = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    if (steps := _steps.get()) is not None:
        steps.append(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build makes, cut; what build itself cut on the way is deleted, so nothing else may read it."""
    held = _steps.set(steps := [])
    try:
        df = build()
    finally:
        _steps.reset(held)
    out = cut(df)
    for at in steps:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def lookup_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written narrow table as the small side of a join: broadcast if counted at most `rows` rows, else left to a shuffle join."""
    return F.broadcast(df) if df.count() <= rows else df


def bounded_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of at most `rows` rows from now on in this session: with the default of 10,000, long texts fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def wrap(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)

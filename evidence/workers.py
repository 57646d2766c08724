"""Python workers import this package from where the driver has it, if they share that folder; and the folder that all share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
_LOCAL: dict[str, str] = {}
#: Rows of an Arrow batch: texts are long, and JVM and worker both hold a batch.
BATCH_ROWS = 512


def on_workers(spark: SparkSession) -> None:
    have = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; only a local session may fall back to a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="evidence-"))


def delete_on_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)

"""Intermediate tables: written once to the folder that driver and executors share, read as often as needed."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), f"specforge-{os.getuid()}")
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001  the session has ended: nothing to ask
        return


@atexit.register
def clean() -> None:
    """Remove the tables that this process wrote."""
    while _written:
        _remove(*_written.pop())


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/specforge-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, what: str, parts: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.  A lost executor costs nothing that was written.

    parts: at most so many files, for tables of sums, so that their size on disk is that of their rows.
    """
    path = new_path(df.sparkSession, what)
    (df.coalesce(parts) if parts else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

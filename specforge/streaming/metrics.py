"""Extensions: quality metrics over streams of question events and uploaded matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.operators.conformity import items
from specforge.operators.qa import last_events, metrics
from specforge.schemas import MATRIX_ROWS


def hourly_metrics(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Metrics per hour of event time; what comes later than the watermark is dropped, so state stays bounded."""
    windowed = events.withWatermark("ts", late).withColumn("window", F.window("ts", "1 hour"))
    d = metrics(windowed, "window")
    return d.select(F.col("window.start").alias("hour"), *[c for c in d.columns if c != "window"])


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Questions per user and session (a session ends after a gap)."""
    d = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("questions"), F.count_if("was_not_found").alias("not_found"))
    return d.select("user_id", F.col("session.start").alias("begin"), F.col("session.end").alias("end"), "questions", "not_found")


def matrix_stream(spark: SparkSession, path: str, files: int = 10) -> DataFrame:
    """Rows of matrices as they arrive as Parquet files of matrix rows."""
    return spark.readStream.schema(MATRIX_ROWS).option("maxFilesPerTrigger", files).parquet(path)


def status_counts(stream: DataFrame, status_column: int, comment_column: int) -> DataFrame:
    """Running counts of categories by file."""
    cell = lambda k: F.coalesce(F.get("cells", F.lit(k)), F.lit(""))
    rows = stream.select("file_name", cell(status_column).alias("conformity_raw"), cell(comment_column).alias("comment"))
    return items(rows).groupBy("file_name", "category").agg(F.count("*").alias("n"))


def versions(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: every batch makes a new version of a small table out of the one before.

    A version is named by its batch and is overwritten whole, and a batch only reads versions before its own, so a batch that is run again
    after a failure gives the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        merge(latest(batch.sparkSession, path, epoch), batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch:012d}")

    return write


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version of such a table (before a batch), or None."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []
    done = [n for n in names if n.startswith("epoch=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    kept = [n for n in done if before is None or int(n[6:]) < before]
    return spark.read.parquet(f"{path}/{kept[-1]}") if kept else None


def last_events_sink(path: str, n: int = 1000) -> Callable[[DataFrame, int], None]:
    """The newest n events of a stream, whatever order they come in; an event that comes twice counts once."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        every = batch if old is None else old.unionByName(batch)
        return last_events(every.dropDuplicates(["event_id"]), n)

    return versions(path, merge)


def counts_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Running counts (file_name, category, n) of a stream of items."""

    def merge(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = batch.groupBy("file_name", "category").agg(F.count("*").alias("n"))
        every = new if old is None else old.unionByName(new)
        return every.groupBy("file_name", "category").agg(F.sum("n").alias("n")).coalesce(1)

    return versions(path, merge)

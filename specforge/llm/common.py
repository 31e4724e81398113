"""What the training-data operators share: tables, intermediate results, Arrow helpers."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.tables import clean, new_path, shared_dir, written  # noqa: F401  as the operators know them

#: White space of the contracts' word pattern ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"\x20\x09-\x0D"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(docs: DataFrame) -> DataFrame:
    """(_doc, _file, _row): rows of docs as structs, whatever their columns are called, and the place of each.

    A place is the file (a hash of its path) and the row's index there, so it is the same at every reading and costs no pass over
    the texts.  Rows that don't come straight from files, one of docs for one of a file, are written first.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    if "_metadata" not in docs.columns and read_straight(docs):
        return docs.select(whole, *_places())
    return written(docs.select(whole), "placed").select("_doc", *_places())


def read_straight(docs: DataFrame) -> bool:
    """Whether docs are columns and rows of files, without anything between that could repeat a row."""
    plan = docs._jdf.queryExecution().analyzed()
    kind = lambda: plan.getClass().getSimpleName()
    while kind() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().apply(0)
    return kind() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"


def _places() -> list[Column]:
    return [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


PLACE = ["_file", "_row"]


def unplaced(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns of placed rows."""
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def sums_before(counts: DataFrame, by: str, bucket: str, n: str, wide: int = 1024) -> DataFrame:
    """counts (by, bucket, n) with _before, the sum of n over the earlier buckets of its group.

    Sums run within `wide` buckets and then over such runs, so a group of any size is no single ordered partition.
    """
    d = counts.withColumn("_run", F.floor(F.col(bucket) / wide))
    inner = Window.partitionBy(by, "_run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum(n).over(inner), F.lit(0)))
    outer = Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    runs = d.groupBy(F.col(by).alias("_by"), F.col("_run").alias("_of")).agg(F.sum(n).alias("_sum"))
    runs = runs.withColumn("_start", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    joined = d.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_run") == F.col("_of")))
    return joined.withColumn("_before", F.col("_start") + F.col("_in")).drop("_run", "_in", "_by", "_of", "_sum", "_start")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once: Arrow batches of at most so many rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame without Python on the executors (createDataFrame goes through a Python RDD)."""
    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ': ').replace(',:', ',')}>>")).alias("x")).select("x.*")


def long_ids(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and the named columns; other columns, whatever their names, are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more)


def numbers(column: pa.Array, null: int = -1) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()

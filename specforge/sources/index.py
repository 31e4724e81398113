"""Vector indexes as Parquet: partitioned by source, appended once per source, read with the filter at the scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.operators.chunking import with_overlap
from specforge.operators.retrieval import cosine_topk, embedded, index_of
from specforge.schemas import VECTORS


def save_index(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    vectors.write.mode(mode).partitionBy("source_code").parquet(path)


def load_index(spark: SparkSession, path: str, codes: list[str] | None = None) -> DataFrame:
    d = spark.read.schema(VECTORS).parquet(path)
    return d.where(F.col("source_code").isin(codes)) if codes else d


def add_new(vectors: DataFrame, path: str) -> None:
    """Append sources that the index doesn't hold yet; the known codes are a bounded list of standards."""
    known = load_index(vectors.sparkSession, path).select("source_code").distinct()
    vectors.join(known, "source_code", "left_anti").write.mode("append").partitionBy("source_code").parquet(path)


def status(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("chunks"), F.sort_array(F.collect_set("source_code")).alias("sources"))


def index_documents(texts: DataFrame, path: str, embed: Callable[[Column], Column] = embedded) -> None:
    """Chunk (with overlap), embed and store texts (doc_id, text): one write, with a file's chunks under its own partition."""
    chunks = with_overlap(texts).select(F.col("doc_id").cast("string").alias("source_code"), "chunk_id", "text")
    save_index(index_of(chunks, embed).select("source_code", "chunk_id", "text", F.col("embedding").cast("array<float>").alias("embedding")), path)


def search_standards(queries: DataFrame, index: DataFrame, codes: list[str], k: int = 5, threshold: float = 0.65) -> DataFrame:
    """Best chunks of some standards (codes in any case) for query vectors; the filter stands before the scores."""
    some = index.where(F.upper("source_code").isin([c.upper() for c in codes])).withColumn("chunk_key", F.concat_ws("#", "source_code", F.col("chunk_id").cast("string")))
    return cosine_topk(queries, some, k, threshold)

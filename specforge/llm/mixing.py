"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled by a hash of their number, lie behind one another on a line of words that is cut into blocks of
``BLOCK`` words.  The mix is a row of slots; slot t has the golden-ratio point ``t * 2654435769 mod 2**32`` (the multiplier
is 2**32 over the golden ratio), the point falls into one source's part of the cumulative targets, and the slots of a source
are ranked: rank r takes block r mod (number of blocks), so a source goes round at most twice.

Everything per document and per slot is distributed: prefix sums go through hash buckets and slot chunks of bounded size, so a
source with a third of all rows is never one group.  The driver sees one row per source (at most ``MAX_SOURCES``).

Nulls: a null text has no words, a null source is the last of the sources.  Documents without words are taken zero times.
Repeated rows are separate documents.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.llm.common import PLACE, SPACE, local_rows, placed, sums_before, table, unplaced, written

BLOCK = 128
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
MAX_SOURCES = 100_000
#: Rows of a hash bucket on a source's line, about; slots of a chunk at least, and chunks at most.
BUCKET, CHUNK, CHUNKS = 256, 1024, 8192
GOLDEN, TURN = 2654435769, 32


def targets(sizes: list[int], share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Words to take of each source: by weight, none above `most` times its size, the excess reshared by weight."""
    total = share * sum(sizes)
    got = [0.0] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    open_ = set(range(len(sizes)))
    while open_:
        pool = total - sum(got[k] for k in range(len(sizes)) if k not in open_)
        whole = sum(weight[k] for k in sorted(open_))
        for k in open_:
            got[k] = pool * weight[k] / whole
        above = {k for k in open_ if got[k] > most * sizes[k]}
        if not above:
            break
        for k in above:
            got[k] = float(most * sizes[k])
        open_ -= above
    return got


def laid(docs: DataFrame, key: list[str]) -> DataFrame:
    """key columns, _number, source, size and begin, the place of the first word on the source's line of shuffled documents."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")
    source = F.col("source").cast("string").alias("source")
    sized = docs.select(*key, source, size.alias("size"), F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long")).alias("_h"), F.monotonically_increasing_id().alias("_number"))
    sized = written(sized, "sized")
    buckets = max(1, -(-sized.count() // BUCKET))
    sized = sized.withColumn("_b", F.pmod(F.xxhash64("_h"), F.lit(buckets)))
    before = sums_before(sized.groupBy("source", "_b").agg(F.sum("size").alias("_n")), "source", "_b", "_n")
    before = written(before.drop("_n").withColumnsRenamed({"source": "_s", "_b": "_c"}), "before")
    own = Window.partitionBy("source", "_b").orderBy("_h", "_number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = sized.withColumn("_upto", F.sum("size").over(own))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c"))
    return within.join(before, same).select(*key, "_number", "source", "size", (F.col("_before") + F.col("_upto") - F.col("size")).alias("begin"))


def schedule(spark: SparkSession, goal: list[float], blocks: list[int], block: int) -> DataFrame:
    """(slot, source_index, block, round): which block of which source every slot of the mix takes."""
    slots = -(-int(np.ceil(sum(goal))) // block)
    chunk = max(CHUNK, -(-slots // CHUNKS))
    edges = np.cumsum(goal) / max(sum(goal), 1.0) * 2**TURN
    edges[-1:] = 2**TURN

    def drawn(first: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(first, min(first + chunk, slots), dtype=np.uint64)
        points = slot * np.uint64(GOLDEN) & np.uint64(2**TURN - 1)
        return slot.astype(np.int64), np.searchsorted(edges, points.astype(np.float64), side="right")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                source, n = np.unique(drawn(c * chunk)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), c)), pa.array(source), pa.array(n)], ["chunk", "source_index", "n"])

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, sources, befores in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                slot, source = drawn(c * chunk)
                order = np.argsort(source, kind="stable")
                grouped = source[order]
                rank = np.empty(len(slot), np.int64)
                rank[order] = np.arange(len(slot)) - np.searchsorted(grouped, grouped)
                known = np.argsort(sources)
                rank += np.array(befores, np.int64)[known][np.searchsorted(np.array(sources)[known], source)]
                number = sizes[source]
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(source), pa.array(rank % number), pa.array(rank // number)], ["slot", "source_index", "block", "round"])

    sizes = np.array(blocks, np.int64)
    chunks = spark.range(-(-slots // chunk)) if slots else spark.range(0)
    counts = chunks.mapInArrow(counted, "chunk long, source_index long, n long")
    counts = written(counts, "slot-counts")
    before = written(sums_before(counts, "source_index", "chunk", "n").drop("n").withColumnRenamed("_before", "before"), "slots-before")
    listed = F.sort_array(F.collect_list(F.struct("source_index", "before")))  # one entry a source
    offsets = before.groupBy("chunk").agg(listed.alias("x")).select("chunk", F.col("x.source_index").alias("sources"), F.col("x.before").alias("befores"))
    return offsets.mapInArrow(ranked, "slot long, source_index long, block long, round long").where(F.col("round") < MOST)


def mixed(docs: DataFrame, key: list[str] | tuple[str, ...] = ("doc_id",), block: int = BLOCK) -> DataFrame:
    """key columns, _number, size, source_size, target, taken (words, repeats counted) and copies (takings of the first word)."""
    spark, key = docs.sparkSession, list(key)
    line = written(laid(docs, key), "line")
    found = line.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes)
    blocks = [max(1, -(-n // block)) for n in sizes]
    known = local_rows(spark, [(r.source, k, n, float(t)) for k, (r, n, t) in enumerate(zip(found, sizes, goal, strict=True))], "_s string, source_index long, source_size long, target double")
    lined = line.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    times = schedule(spark, goal, blocks, block).groupBy("source_index", "block").agg(F.count("*").alias("times"))
    last = F.floor((F.col("begin") + F.col("size") - 1) / block)
    first = F.floor(F.col("begin") / block)
    parts = lined.where("size > 0").select("_number", "source_index", "begin", "size", first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    # the optimizer can't know how many slots a row of chunks becomes: no broadcast of them
    got = parts.join(times.hint("merge"), ["source_index", "block"]).groupBy("_number")
    got = got.agg(F.sum(overlap * F.col("times")).alias("taken"), F.sum(F.when(F.col("block") == F.col("first"), F.col("times")).otherwise(0)).alias("copies"))
    none = F.lit(0).cast("long")
    return lined.join(got, "_number", "left").select(*key, "_number", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), F.coalesce("copies", none).alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs' columns: every document as often as the mix takes its first word, so that whole documents meet the targets.

    Copies are known by the place of their row, so repeated rows, repeated or null doc_ids and columns of any name are documents of
    their own.  They meet the documents in a merge join at every size: each text is shuffled once.
    """
    rows = placed(docs)
    lean = rows.select(*PLACE, *[F.col(f"_doc.{c}").alias(c) for c in ("doc_id", "text", "source")])
    copies = written(mixed(lean, PLACE).where("copies > 0").select(*PLACE, "copies"), "copies")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_time")
    return unplaced(rows.join(copies.hint("merge"), PLACE).select("_doc", times), docs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")

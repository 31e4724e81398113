"""K-d tree sharding by bytes, in DataFrame functions only.

Every document is a point of its metadata: size (log scale), characters per byte, language and source (the first letters as a number, so
that their order is kept).  A node is split across the dimension along which it varies most (variance, weighted by bytes, of the
place between the least and the greatest value of the whole table) at the weighted median of bytes, until the wanted number of
leaves (or a size in bytes) is reached.

Equal texts are one group: they take the least language and source of the group, so they share a point, and the order along a dimension is
(value, digest of the text, number, row).  A median that falls among a group moves to its nearer edge; only a group that holds
more than ``WHOLE`` of a leaf's bytes is cut inside, so a text that a third of all rows hold is still cut to measure.

The median is found by histograms: 1024 bins a node, summed before any exchange and run through in Spark, so that the driver sees one
row a node, then 1024 bins within the bin that holds the median, and so on.  The driver holds the tree: a few numbers a leaf.
Places in a shard are ranks within hash buckets of bounded size plus the sizes of earlier buckets.

Nulls: a null text has size 1 and checksum 0; a null language or source comes before any other.  Null and repeated numbers are
ordered by row.  Tables without lang or source have nothing to split there.  Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.llm.common import local_rows, long_ids, sums_before, table, written

BINS = 1024
#: Rows of a bucket in which places are ranked, about.
BUCKET = 512
#: A bin with less than this part of a leaf's bytes isn't refined further; a group of equal texts with less isn't cut.
CLOSE, WHOLE = 1e-3, 0.1
DIMS = ("size_log", "density", "lang_at", "source_at")
ORDER = ("_text", "_id", "_row")
#: Steps between the least and the greatest value of a dimension, for variances in whole numbers.
STEPS = 1023


@dataclass
class Node:
    """A node: number, leaves below it, bytes; while its median is sought, the state of that search."""

    number: int
    leaves: int
    weight: int
    dim: int = 0
    fixed: list[int] = field(default_factory=list)
    low: int = 0
    width: int = 1
    below: int = 0

    @property
    def goal(self) -> float:
        return self.weight * (self.leaves // 2) / self.leaves


def letters(c: Column) -> Column:
    """The first seven bytes of a name as a number: names in order have numbers in order; null is 0."""
    first = F.rpad(F.substring(F.coalesce(c.cast("string"), F.lit("")).cast("binary"), 1, 7), 7, F.lit(b"\x00"))
    return F.conv(F.hex(first), 16, 10).cast("long")


def points(docs: DataFrame) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    chars = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    size = (F.octet_length(raw) + 1).cast("long")
    named = [letters(F.col(c) if c in docs.columns else F.lit(None)).alias(f"{c}_at") for c in ("lang", "source")]
    d = long_ids(docs, size.alias("size"), F.crc32(raw).alias("text_crc32"), chars.alias("chars"), F.shiftrightunsigned(F.xxhash64(raw), 2).alias("_text"), *named)
    d = d.select(
        "doc_id", "size", "text_crc32", "_text",
        F.floor(F.log2("size") * 2**20).alias("size_log"),
        F.floor((F.col("chars") + 1) / F.col("size") * 2**20).alias("density"), "lang_at", "source_at",
        F.coalesce("doc_id", F.lit(-(2**62))).alias("_id"), F.monotonically_increasing_id().alias("_row"),
    )
    d = written(d, "points")
    differ = lambda c: F.min(c) != F.max(c)
    groups = d.groupBy(F.col("_text").alias("_g")).agg(F.min("lang_at").alias("_lang"), F.min("source_at").alias("_source"), (differ("lang_at") | differ("source_at")).alias("_mixed"))
    groups = written(groups.where("_mixed").drop("_mixed"), "mixed-groups", 4)
    joined = d.join(groups, F.col("_text") == F.col("_g"), "left")
    return joined.select("doc_id", "size", "text_crc32", "_text", "size_log", "density", F.coalesce("_lang", "lang_at").alias("lang_at"), F.coalesce("_source", "source_at").alias("source_at"), "_id", "_row")


def bounds_of(d: DataFrame):
    return d.agg(F.sum("size").alias("w"), *[f(c).alias(f"{n}_{c}") for c in (*DIMS, *ORDER) for n, f in (("lo", F.min), ("hi", F.max))]).first()


def spreads(d: DataFrame, whole) -> DataFrame:
    """(_node, w, dim): bytes of every node, and the dimension along which it varies most; sums are exact, so reruns agree."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    sums, varied = [F.sum("size").alias("w")], []
    for k, c in enumerate(DIMS):
        low, wide = whole[f"lo_{c}"], max(1, whole[f"hi_{c}"] - whole[f"lo_{c}"])
        x = F.floor((F.col(c) - low) / F.lit(float(wide)) * STEPS).cast("long")
        sums += [exact(F.col("size") * x).alias(f"_s{k}"), exact(F.col("size") * x * x).alias(f"_q{k}")]
        mean = F.col(f"_s{k}").cast("double") / F.col("w")
        varied.append(F.struct(F.round(F.col(f"_q{k}").cast("double") / F.col("w") - mean * mean, 6).alias("v"), F.lit(-k).alias("k")))
    return d.groupBy("_node").agg(*sums).select("_node", "w", (-F.array_max(F.array(*varied))["k"]).alias("dim"))


def medians(d: DataFrame, nodes: list[Node], whole) -> dict[int, tuple]:
    """Thresholds (dim, value, checksum, id, row) of nodes: what lies below goes left."""
    spark, found, searched = d.sparkSession, {}, {n.number: n for n in nodes}
    bounds = {c: (whole[f"lo_{c}"], whole[f"hi_{c}"]) for c in (*DIMS, *ORDER)}

    def begin(n: Node, column: str, low: int | None = None, high: int | None = None) -> None:
        low, high = (bounds[column][0], bounds[column][1]) if low is None else (low, high)
        n.low, n.width = low, max(1, -(-(high - low + 1) // BINS))

    def close(n: Node, value: int) -> None:
        least = [-(2**63)] * 4
        found[n.number] = (n.dim, *[*n.fixed, value, *least][:4])
        del searched[n.number]

    for n in nodes:
        begin(n, DIMS[n.dim])
    while searched:
        rows = [(n.number, n.dim, len(n.fixed), *[*n.fixed, 0, 0, 0][:3], n.low, n.width, n.below, float(n.goal)) for n in searched.values()]
        asked = local_rows(spark, rows, "_node long, dim int, depth int, f0 long, f1 long, f2 long, low long, width long, below long, goal double")
        own = F.element_at(F.array(*DIMS), F.col("dim") + 1)
        x = F.when(F.col("depth") == 0, own).when(F.col("depth") == 1, F.col(ORDER[0])).when(F.col("depth") == 2, F.col(ORDER[1])).otherwise(F.col(ORDER[2]))
        here = ((F.col("depth") < 1) | (own == F.col("f0"))) & ((F.col("depth") < 2) | (F.col(ORDER[0]) == F.col("f1"))) & ((F.col("depth") < 3) | (F.col(ORDER[1]) == F.col("f2")))
        hist = d.join(F.broadcast(asked), "_node").where(here).withColumn("_x", x).where("_x >= low")
        hist = hist.withColumn("_bin", F.expr("(_x - low) div width")).where(f"_bin < {BINS}")  # whole numbers: quotients of doubles lose bits
        hist = hist.groupBy("_node", "_bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("below").alias("below"), F.first("goal").alias("goal"))
        run = F.sum("w").over(Window.partitionBy("_node").orderBy("_bin")) + F.col("below")  # at most BINS rows a node
        met = hist.withColumn("run", run).groupBy("_node").agg(F.min_by(F.struct("_bin", "w", "n", "run"), F.struct(F.col("run") < F.col("goal"), F.when(F.col("run") < F.col("goal"), -F.col("_bin")).otherwise(F.col("_bin")))).alias("m"))
        at_median = {r["_node"]: r["m"] for r in met.collect()}
        for n in list(searched.values()):
            at, w, rows_there, upto = at_median[n.number]
            last = upto - w
            nearer = upto - n.goal < n.goal - last
            leaf = n.weight / n.leaves
            if rows_there == 1 or w <= CLOSE * leaf or n.width == 1 and (len(n.fixed) == 3 or len(n.fixed) == 1 and w <= WHOLE * leaf):
                close(n, n.low + (at + nearer) * n.width)
            elif n.width > 1:
                n.below = last
                begin(n, "", n.low + at * n.width, n.low + (at + 1) * n.width - 1)
            else:  # one value holds too many bytes: order within it
                n.below = last
                n.fixed.append(n.low + at)
                begin(n, ORDER[len(n.fixed) - 1])
    return found


def kd_shards(docs: DataFrame, leaves: int | None = None, leaf_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) over `leaves` shards, or as many as keep a shard at about leaf_bytes."""
    d = written(points(docs), "points")
    whole = bounds_of(d)
    if whole["w"] is None:
        return d.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    leaves = leaves or max(1, round(whole["w"] / leaf_bytes))
    open_, done, level = [Node(1, leaves, whole["w"])], {}, 0
    d = d.withColumn("_node", F.lit(1).cast("long"))
    while open_:
        by = {r["_node"]: r for r in spreads(d, whole).collect()}  # one row a node
        splitting = []
        for n in open_:
            if n.leaves == 1 or n.number not in by:
                done[n.number] = n
                continue
            n.weight, n.dim = by[n.number]["w"], by[n.number]["dim"]
            splitting.append(n)
        if not splitting:
            break
        cuts = medians(d, splitting, whole)
        rows = [(k, *v) for k, v in cuts.items()]
        cut = local_rows(d.sparkSession, rows, "_node long, dim int, v0 long, v1 long, v2 long, v3 long")
        own = F.struct(F.element_at(F.array(*DIMS), F.col("dim") + 1).alias("a"), F.col(ORDER[0]).alias("b"), F.col(ORDER[1]).alias("c"), F.col(ORDER[2]).alias("d"))
        edge = F.struct(F.col("v0").alias("a"), F.col("v1").alias("b"), F.col("v2").alias("c"), F.col("v3").alias("d"))
        side = F.when(F.col("v0").isNull(), F.col("_node")).otherwise(F.col("_node") * 2 + (own >= edge).cast("long"))
        d = d.join(F.broadcast(cut), "_node", "left").withColumn("_node", side).drop("dim", "v0", "v1", "v2", "v3")
        level += 1
        if level % 3 == 0:
            d = written(d, "nodes")
        open_ = [Node(2 * n.number + k, (n.leaves // 2, n.leaves - n.leaves // 2)[k], 0) for n in splitting for k in (0, 1)]
    first = lambda n: n / 2 ** n.bit_length()  # noqa: E731  leaves from left to right
    names = [(n, k) for k, n in enumerate(sorted(done, key=first))]
    shards = local_rows(d.sparkSession, names, "_node long, shard int")
    return slotted(d.join(F.broadcast(shards), "_node"))


def slotted(d: DataFrame) -> DataFrame:
    """Places from 0 in every shard, without gaps."""
    d = written(d.select("doc_id", "size", "text_crc32", "shard", "_id", "_row"), "sharded")
    buckets = max(1, -(-d.count() // BUCKET))
    d = d.withColumn("_b", F.pmod(F.xxhash64("_id", "_row"), F.lit(buckets)))
    before = sums_before(d.groupBy("shard", "_b").agg(F.count("*").alias("_n")), "shard", "_b", "_n")
    before = written(before.drop("_n"), "before")
    rank = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_id", "_row"))
    ranked = d.withColumn("_rank", rank.cast("long")).join(before, ["shard", "_b"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kd_shards(table(spark, sf_dir, "documents"), leaves=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Standards that specifications cite, and the images that they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States of a standard; kinds of images by the text near them, the first that fits.
DRAFTS, PUBLISHED = ("DRAFT", "DRAFTING", "IN_REVIEW"), ("PUBLISHED", "PUBLIÉ", "APPROVED")
KINDS = (
    (r"(?i)(?:contextual|context|system).*diagram", "contextual_diagram"), (r"(?i)(?:state|transition|mode).*diagram", "state_machine_diagram"), (r"(?i)(?:architect|physical|connection).*diagram", "architecture_diagram"),
    (r"(?i)(?:block|functional).*diagram", "block_diagram"), (r"(?i)(?:I/O|input|output|signal).*diagram", "io_diagram"), (r"(?i)figure|fig\.|image|illustration", "figure"), (r"(?i)graphic|flowchart|schema", "diagram"),
)


def is_active(state: Column, cancelled: Column) -> Column:
    return ~cancelled & F.upper(state).isin(*PUBLISHED)


def resolved(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(code, found, status, title, place) of wanted codes against known standards (k, code, title, state, cancelled).

    A search finds codes that begin with the wanted one; the same code comes first, else the first found.  Found ones come before others.
    """
    joined = wanted.join(known.withColumnsRenamed({"code": "_code"}), F.upper("_code").startswith(F.upper("code")), "left")
    best = joined.groupBy("code").agg(F.min_by(F.struct("title", "state", "cancelled"), F.struct((F.upper("_code") != F.upper("code")).alias("far"), "k")).alias("x"))
    state, gone = F.upper("x.state"), F.col("x.cancelled")
    status = F.when(F.col("x.title").isNull(), "unknown").when(gone, "cancelled").when(state.isin(*DRAFTS), "draft").when(is_active(state, gone), "active").otherwise("unknown_status")
    d = best.select("code", F.col("x.title").isNotNull().alias("found"), status.alias("status"), F.col("x.title").alias("title"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(~F.col("found"), "code")))  # the few codes of one report


def norm_files(norms: DataFrame) -> DataFrame:
    """(code, files, published) of norms (code, translations array<struct<files array<struct<name, is_published>>>>)."""
    files = F.flatten(F.transform("translations", lambda t: t["files"]))
    return norms.select("code", F.transform(files, lambda f: f["name"]).alias("files"), F.transform(F.filter(files, lambda f: f["is_published"]), lambda f: f["name"]).alias("published"))


def image_kinds(images: DataFrame) -> DataFrame:
    """images (with `nearby`, the text around) and their kind."""
    kind = F.when(F.col("nearby").rlike(KINDS[0][0]), KINDS[0][1])
    for pattern, name in KINDS[1:]:
        kind = kind.when(F.col("nearby").rlike(pattern), name)
    return images.withColumn("kind", kind.otherwise("unknown"))


def sql_kind(c: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {quoted(p)}) THEN '{k}'" for p, k in KINDS) + " ELSE 'unknown' END"


def largest_images(images: DataFrame, most: int = 5) -> DataFrame:
    """The largest images of every document: they are most likely diagrams."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("n_bytes"))
    return images.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def image_summary(images: DataFrame) -> DataFrame:
    return images.groupBy("doc_id").agg(F.count("*").alias("images"), F.sort_array(F.collect_set("section")).alias("sections"), F.sort_array(F.collect_set("kind")).alias("kinds"))

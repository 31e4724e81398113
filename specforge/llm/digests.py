"""Canonical exact digests, in DataFrame functions only.

A text's canonical form is its compatibility composition (NFKC), full case folding, and white space folded to single blanks;
both Unicode functions are those of the ICU library that Spark ships, called through ``java_method``.  Its fingerprint is two
chained xxHash64 values (128 bits) and the form's length.  Documents that share a fingerprint are compared byte by byte: the least and
the greatest form of a bucket are the same unless different forms collide, and then the bucket is cut by the rank of the form.

The text that follows a document in descending order of numbers comes from a window over ranges of numbers (quantiles, so no
range holds many more rows than others) and, across the edge of a range, from the first row of the next one; texts are
shuffled once.

Nulls: a null text is empty; null numbers come last in descending order.  Rows with one number follow one another in any
order that is fixed by their texts.  A single document is its own next one.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.llm.common import local_rows, long_ids, table, written

#: Rows of a range, about; splitters of a level (ranges are at most its square; beyond that they grow, and windows over them spill).
RANGE, LEVEL = 500, 512
LEAST_ID = -(2**63)


def canonical(text: Column) -> Column:
    compose = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True))
    return F.trim(F.regexp_replace(compose(fold), r"[\s\p{Z}\x85]+", " "))


def wide(form: Column) -> Column:
    """128 bits and the length of a canonical form, as hexadecimal digits."""
    parts = [F.lpad(F.lower(F.hex(x)), 16, "0") for x in (F.xxhash64(form), F.xxhash64(F.lit("wide"), form))]
    return F.concat(*parts, F.lit("-"), F.lower(F.hex(F.octet_length(form).cast("long"))))


def splitters(ids: DataFrame) -> list[int]:
    """Quantiles of _id, RANGE rows apart; drawn once, since another draw could give others."""
    wanted = max(1, min(LEVEL * LEVEL, -(-ids.count() // RANGE)))
    if wanted == 1:
        return []
    return sorted({int(x) for x in ids.stat.approxQuantile("_id", [k / wanted for k in range(1, wanted)], min(0.01, 1 / (8 * wanted)))})


def ranged(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """docs with _range, ascending with _id: two levels of splitters as literal arrays, so a lookup costs 2 * LEVEL comparisons."""
    if not cuts:
        return docs.withColumn("_range", F.lit(0))
    step = max(1, -(-len(cuts) // LEVEL))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")
    inner = F.transform(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), lambda x: F.split(x, ",").cast("array<long>"))
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("_id")))
    d = docs.withColumn("_top", below(longs([g[0] for g in groups])))
    low = F.when(F.col("_top") == 0, F.lit(0)).otherwise((F.col("_top") - 1) * step + below(F.get(inner, F.col("_top") - 1)))
    return d.withColumn("_range", low).drop("_top")


def with_ids(docs: DataFrame, *more: Column) -> DataFrame:
    return long_ids(docs, *more).withColumn("_id", F.coalesce("doc_id", F.lit(LEAST_ID)))


def followed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): beside every document the next one in descending order, round about."""
    cuts = splitters(with_ids(docs))
    d = ranged(with_ids(docs, F.coalesce("text", F.lit("")).alias("text")), cuts)
    d = d.withColumn("fp", wide(canonical(F.col("text"))))
    order = Window.partitionBy("_range").orderBy(F.desc("_id"), "fp", "text")
    d = d.withColumns({"_place": F.row_number().over(order), "next_text": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)})
    tops = written(ranged(with_ids(docs), cuts).groupBy("_range").agg(F.max("_id").alias("_id")), "tops")
    # one row per range, so at most LEVEL * LEVEL of them
    heads = d_heads(docs, tops)
    lower = Window.orderBy(F.desc("_range"))
    chain = tops.select("_range", F.lead("_range").over(lower).alias("_to"))
    last = tops.agg(F.max("_range").alias("_top"))
    chain = chain.crossJoin(F.broadcast(last)).select("_range", F.coalesce("_to", "_top").alias("_to"))
    edge = written(chain.join(heads, F.col("_to") == heads.head_range).select(F.col("_range").alias("edge_range"), "head_text", "head_fp"), "edges")
    joined = d.join(edge, F.col("_range") == F.col("edge_range"), "left")
    return joined.select("doc_id", "text", "fp", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_fp", "head_fp").alias("next_fp"))


def d_heads(docs: DataFrame, tops: DataFrame) -> DataFrame:
    """(head_range, head_text, head_fp): the first row of every range."""
    d = with_ids(docs, F.coalesce("text", F.lit("")).alias("text"))
    some = d.join(tops, "_id").withColumn("fp", wide(canonical(F.col("text"))))
    first = F.row_number().over(Window.partitionBy("_range").orderBy("fp", "text"))
    return some.withColumn("_n", first).where("_n = 1").select(F.col("_range").alias("head_range"), F.col("text").alias("head_text"), F.col("fp").alias("head_fp"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def collided(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(fp, form, part): forms of buckets in which documents' bytes differ; part is 0 for the least form.  Nearly always empty."""
    shared = written(marked.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "shared")
    members = written(marked.join(shared, "fp", "left_semi").select(F.col("doc_id").alias("_m")).distinct(), "members")
    some = long_ids(docs, F.coalesce("text", F.lit("")).alias("text")).join(members, F.col("doc_id").eqNullSafe(F.col("_m")), "left_semi")
    forms = some.select(canonical(F.col("text")).alias("form")).withColumn("fp", wide(F.col("form")))
    differ = forms.groupBy("fp").agg(F.min("form").alias("least"), F.max("form").alias("greatest")).where("least <> greatest").select(F.col("fp").alias("_fp"))
    differ = written(differ, "collided")
    if not differ.limit(1).count():
        return local_rows(docs.sparkSession, [], "fp string, form string, part int")
    distinct = forms.join(differ, F.col("fp") == F.col("_fp"), "left_semi").distinct()
    return written(distinct.withColumn("part", F.row_number().over(Window.partitionBy("fp").orderBy("form")) - 1), "parts")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = followed(docs).withColumn("_edit", edited(F.col("text"), F.col("next_text")))
    marked = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edit").cast("binary"), 256).alias("edited_sha256"),
        "fp",
        wide(canonical(F.col("_edit"))).alias("edited_fp"),
        "next_fp",
    )
    marked = written(marked, "digests")
    parts = collided(docs, marked)
    if parts.limit(1).count():
        marked = told_apart(rows, parts)
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        same("fp", "edited_fp").alias("near_edited"), same("fp", "next_fp").alias("near_next"),
    )


def told_apart(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """As `marked`, with the rank of the form added to fingerprints of buckets in which forms differ."""
    d = rows.select("doc_id", "text", "_edit", "next_text")
    for name, source in (("fp", "text"), ("edited_fp", "_edit"), ("next_fp", "next_text")):
        form = canonical(F.col(source))
        known = parts.select(F.col("fp").alias("_f"), F.col("form").alias("_form"), F.col("part").alias("_part"))
        d = d.withColumns({"_form_here": form, name: wide(form)})
        d = d.join(known, (F.col(name) == F.col("_f")) & (F.col("_form_here") == F.col("_form")), "left")
        d = d.withColumn(name, F.when(F.col("_part") > 0, F.concat(name, F.lit("-"), F.col("_part"))).otherwise(F.col(name)))
        d = d.drop("_f", "_form", "_part", "_form_here")
    return d.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edit").cast("binary"), 256).alias("edited_sha256"), "fp", "edited_fp", "next_fp")


def op4_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))

"""Rule checks over specification lines, as findings and as counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions.text import strip
from specforge.operators.lines import by_line, context_flags, detected_sections

# Patterns of the rules.
REQUIREMENT_ID = r"(?i)\b(?:REF|APP|GEN)\s*[-_\s]\s*[A-Z0-9][A-Z0-9_-]*?\s*[-_]\s*\d+"
SHALL = r"(?i)\bshall\b"
SUBJECTIVE = r"(?i)\b(certain|various|some|several|little|much|often|almost|sometimes|etc\.?)\b"
PLACEHOLDER = r"<<[^>]*>>"
TBD = r"(?i)\b(TBD|TBC|TODO|XXX)\b"
VARIABLE = r"<(component name|part name|Part name|name of the Model|reference|PSP|stakeholder|project name)>"
TRACE = (
    r"(?i)\binput\s+requirement\b|\bupstream\s+requirement\b|\bderived\s+from\b|\btraced?\s+(?:to|from)\b|\bISO\s*\d{4,6}",
    r"\bN/A\b|\bVF_\d{2,6}\b|\bCS\.\d{4,6}\b|\[([A-Z]{2,}[_\s][A-Z]{2,}[_\d]*)\]",
)


def is_shall(line: Column) -> Column:
    return line.rlike(SHALL) & (F.char_length(strip(line)) > 20)


def is_traced(line: Column) -> Column:
    return line.rlike(TRACE[0]) | line.rlike(TRACE[1])


def placeholder_counts(lines: DataFrame) -> DataFrame:
    """Per document: angle placeholders, variables, open points; a match counts under each pattern that finds it."""
    n = lambda p: F.sum(F.regexp_count("line", F.lit(p))).cast("long")
    return lines.groupBy("doc_id").agg(n(PLACEHOLDER).alias("placeholders"), n(VARIABLE).alias("variables"), n(TBD).alias("tbd"), n(r"\bXXX\b").alias("xxx"))


def requirement_language(lines: DataFrame) -> DataFrame:
    """Per document: shall, should and may, and shall-lines with subjective words."""
    n = lambda p: F.sum(F.regexp_count("line", F.lit(p))).cast("long")
    return lines.groupBy("doc_id").agg(
        n(SHALL).alias("shall"), n(r"(?i)\bshould\b").alias("should"), n(r"(?i)\bmay\b").alias("may"),
        F.count_if(F.col("line").rlike(SHALL) & F.col("line").rlike(SUBJECTIVE)).alias("subjective"),
    )


def requirement_format(lines: DataFrame) -> DataFrame:
    """Per document: shall-lines and table rows (two bars or more)."""
    bars = F.regexp_count("line", F.lit(r"\|"))
    return lines.groupBy("doc_id").agg(F.count_if(is_shall(F.col("line"))).alias("shall_lines"), F.count_if(bars >= 2).alias("table_rows"))


def requirement_ids(lines: DataFrame) -> DataFrame:
    """Per document: shall-lines, those with an identifier within ten lines, distinct identifiers."""
    line = F.col("line")
    near = context_flags(lines, is_shall(line), line.rlike(REQUIREMENT_ID)).groupBy("doc_id").agg(F.count("*").alias("shall_lines"), F.count_if("near").alias("with_id"))
    ids = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(f"({REQUIREMENT_ID})"), F.lit(1))).alias("id"))
    return near.join(ids.groupBy("doc_id").agg(F.count_distinct("id").alias("distinct_ids")), "doc_id", "left")


def traceability(lines: DataFrame) -> DataFrame:
    """Per document: shall-lines, those traced on the line, and (if none is) those traced within ten lines; the ratio."""
    line = F.col("line")
    window = by_line().rowsBetween(-10, 10)
    d = lines.withColumns({"_shall": is_shall(line), "_inline": is_traced(line)}).withColumn("_near", F.max(F.col("_inline").cast("int")).over(window) == 1).where("_shall")
    per = d.groupBy("doc_id").agg(F.count("*").alias("shall_lines"), F.count_if("_inline").alias("inline"), F.count_if("_near").alias("near"))
    traced = F.when(F.col("inline") > 0, F.col("inline")).otherwise(F.col("near"))
    return per.withColumn("traced", traced).withColumn("ratio", traced / F.col("shall_lines"))


def catalogue(spark, names=lexicon.MANDATORY_SECTIONS) -> DataFrame:
    """Rule catalogue: mandatory sections in their order."""
    return spark.createDataFrame([(n, k) for k, n in enumerate(names)], "required string, place int")


def matched_sections(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, required, place, section): for every document and required section the section that meets it, or null.

    The catalogue is a handful of rows, so each document's few sections are held against it.
    """
    found = detected_sections(lines)
    words = lambda c: F.array_distinct(F.split(F.lower(F.trim(c)), r"\s+"))
    docs = lines.select("doc_id").distinct()
    every = docs.join(F.broadcast(wanted))
    pairs = found.join(F.broadcast(wanted)).withColumns({"rw": words("required"), "fw": words("section"), "rl": F.lower("required"), "fl": F.lower(F.trim("section"))})
    overlap = F.size(F.array_intersect("rw", "fw")) / F.size("rw")
    grade = (
        F.when(F.col("rl") == F.col("fl"), 2.0)
        .when((F.size("rw") <= 2) & F.contains("fl", "rl") & (F.size("fw") <= F.size("rw") + 1), 1.5)
        .when((F.size("rw") > 2) & (overlap >= 0.6), overlap)
    )
    graded = pairs.withColumn("grade", grade).where("grade is not null")
    best = graded.groupBy("doc_id", "required").agg(F.max_by("section", F.struct("grade", -F.col("line_no"))).alias("section"))
    return every.join(best, ["doc_id", "required"], "left").select("doc_id", "required", "place", "section")


# Unit patterns of physical parameters.
UNITS = (
    ("sound_level_db", r"(?i)(\d+(?:\.\d+)?)\s*(?:dB|dB\(A\)|dBA?)"), ("voltage_v", r"(?i)(\d+(?:\.\d+)?)\s*(?:V|volts?)\b"),
    ("time_ms", r"(?i)(\d+(?:\.\d+)?)\s*(?:ms|milliseconds?)"), ("percentage", r"(?i)(\d+(?:\.\d+)?)\s*%"), ("frequency_hz", r"(?i)(\d+(?:\.\d+)?)\s*(?:Hz|hertz)"),
)


def physical_parameters(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, unit, value, suspicious): numbers with units; loud, odd voltage, or over 100 %."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(1)), _valued(unit)) for unit, p in UNITS]))
    d = lines.select("doc_id", "line_no", F.explode(found).alias("x")).select("doc_id", "line_no", "x.unit", "x.value")
    v, u = F.col("value"), F.col("unit")
    odd = ((u == "sound_level_db") & (v > 130)) | ((u == "voltage_v") & ((v < 1) | (v > 48))) | ((u == "percentage") & (v > 100))
    return d.withColumn("suspicious", odd)


def _valued(unit: str):
    return lambda v: F.struct(F.lit(unit).alias("unit"), v.cast("double").alias("value"))


def standard_codes(lines: DataFrame) -> DataFrame:
    """Distinct bracketed standard codes per document."""
    return lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\[([A-Z][A-Z0-9_-]+)\]"), F.lit(1))).alias("code")).distinct()


def requirement_patterns(lines: DataFrame) -> DataFrame:
    """Per document: shall-lines and those with a trigger or precondition."""
    low = F.lower("line")
    shall = is_shall(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count_if(shall).alias("shall_lines"), F.count_if(shall & low.rlike(r"\b(when|if|while|during|upon)\b")).alias("conditioned"))

"""Lines and sections of documents: windows instead of loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge.functions.text import bound, strip, upper_ratio

#: Words that make a Title Case line a heading (fixed values).
SECTION_WORDS = tuple(
    """purpose scope system development context general description roles physical architecture diversity quoted documents reference
    applicable terminology glossary acronyms requirements functional performance external interfaces operational mission profile lifetime
    ergonomics human factors rams safety maintainability product quality constraint design manufacturing environment conditions integration
    validation demonstration compliance traceability configuration network electrical mechanical machine weight withdrawal flexibility
    extension transportability storage packaging protection hostility resources reserve capacity document""".split()
)
#: The same for the first review.
SECTION_WORDS_V1 = tuple(
    """purpose scope system development context general description roles physical architecture diversity quoted documents reference
    applicable terminology glossary acronyms requirements functional performance external interfaces operational mission profile lifetime
    ergonomics human factors rams safety maintainability product quality constraint design manufacturing environment conditions integration
    validation demonstration compliance traceability configuration parameters appendix annex component output input analysis noise water
    tightness corrosion electronic mechanical testing""".split()
)
CAPS_V1 = r"^([A-Z][A-Z\s/()\-&,:;.–—]{2,})$"
CONTENTS = r"^\d+\t([A-Z][A-Za-z\s/()\-&,:;.]{2,})\t\d+"
CAPS = r"^([A-Z][A-Z0-9\s/()\-&,:;.–—]{2,})$"
TITLE = r"^([A-Z][A-Za-z]+(?:\s+(?:[A-Z][A-Za-z]+|[a-z]+)){0,5})$"
NUMBERED = r"^\d+(?:\.\d+)*\.?\s+([A-Z][A-Za-z\s/()\-&,:;.]{2,})$"
LISTED = r"^\d+\.\s+[A-Z][a-z]"


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line)."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def by_line(*more: str) -> Window:
    return Window.partitionBy("doc_id", *more).orderBy("line_no")


def heading_of(line: Column, caps_pattern: str = CAPS, section_words: tuple[str, ...] = SECTION_WORDS, longest: int = 120, contents: str | None = None) -> Column:
    """Name of the section that a line begins, or null: capitals, Title Case with a section word, numbered, or a line of a table of contents."""

    def capitals(s: Column) -> Column:
        caps = F.regexp_replace(strip(F.regexp_extract(s, caps_pattern, 1)), ":+$", "")
        return bound(caps, lambda c: F.when((F.char_length(c) >= 3) & (upper_ratio(c) >= 0.8), c))

    def titled(s: Column) -> Column:
        worded = lambda t: F.arrays_overlap(F.split(F.lower(t), r"\s+"), F.array(*[F.lit(w) for w in section_words]))
        return bound(F.regexp_extract(s, TITLE, 1), lambda t: F.when((F.char_length(t) >= 3) & worded(t), t))

    def extracted(s: Column, pattern: str) -> Column:
        return bound(strip(F.regexp_extract(s, pattern, 1)), lambda n: F.when(F.char_length(n) >= 3, n))

    def name(s: Column) -> Column:
        more = [extracted(s, contents)] if contents else []
        return F.coalesce(capitals(s), titled(s), extracted(s, NUMBERED), *more)

    return bound(strip(line), lambda s: F.when((s != "") & (F.char_length(s) <= longest) & ~s.rlike(LISTED), name(s)))


def first_review_heading(line: Column) -> Column:
    """As the first review sees headings: no digits in capitals, another list of words, and lines of the table of contents."""
    return heading_of(line, CAPS_V1, SECTION_WORDS_V1, 100, CONTENTS)


def detected_sections(lines: DataFrame, heading=heading_of) -> DataFrame:
    """(doc_id, section, line_no): first occurrence of every heading."""
    return lines.withColumn("section", heading(F.col("line"))).where("section is not null").groupBy("doc_id", "section").agg(F.min("line_no").alias("line_no"))


def with_section(lines: DataFrame) -> DataFrame:
    """Lines with the section that they stand in: the last heading at or before them."""
    marked = lines.withColumn("_h", heading_of(F.col("line")))
    return marked.withColumn("section", F.last("_h", True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))).drop("_h")


def section_slices(lines: DataFrame) -> DataFrame:
    """(doc_id, section, begin, end): every heading line and the next different heading's line (exclusive)."""
    marked = lines.withColumn("section", heading_of(F.col("line"))).where("section is not null")
    fresh = marked.withColumn("_prev", F.lag("section").over(by_line())).where("_prev is null or _prev <> section")
    last = lines.groupBy("doc_id").agg((F.max("line_no") + 1).alias("_n"))
    sliced = fresh.withColumn("_next", F.lead("line_no").over(by_line()))
    return sliced.join(last, "doc_id").select("doc_id", "section", F.col("line_no").alias("begin"), F.coalesce("_next", "_n").alias("end"))


def context_flags(lines: DataFrame, own: Column, near: Column, around: int = 10) -> DataFrame:
    """Lines for which `own` holds, with whether `near` holds on one of the lines around."""
    flagged = lines.withColumns({"_own": own, "_near": near.cast("int")})
    window = by_line().rowsBetween(-around, around)
    return flagged.withColumn("near", F.max("_near").over(window) == 1).where("_own").drop("_own", "_near")


def declaration_islands(lines: DataFrame) -> DataFrame:
    """Lines with `declared`: they belong to a run of lines with bars that has two declaration rows or more."""
    declares = F.col("line").rlike(r"^\s*\[[A-Z0-9_]{1,15}\]\s*\|[^|\n]*\|").cast("int")
    barred = lines.withColumns({"_bar": F.col("line").contains("|"), "_decl": declares})
    runs = barred.withColumn("_run", F.col("line_no") - F.row_number().over(by_line("_bar")))
    total = F.sum("_decl").over(Window.partitionBy("doc_id", "_bar", "_run"))
    return runs.withColumn("declared", F.col("_bar") & (total >= 2)).drop("_bar", "_decl", "_run")


def duplicate_lines(lines: DataFrame, least: int = 15, head: int = 80) -> DataFrame:
    """Normalised line heads that two documents or more share."""
    head_ = F.lower(F.substring(strip(F.col("line")), 1, head))
    kept = lines.withColumn("head", head_).where(F.char_length("head") >= least)
    return kept.groupBy("head").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("n")).where("documents >= 2")

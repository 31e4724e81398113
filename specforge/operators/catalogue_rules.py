"""Rules taken from the reference documents themselves: the plan and instructions of a template, the rules and sections of a writing guide.

Both documents are single files of some hundred lines, so a window over their lines is small whatever the number of specifications.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge.functions.text import strip, upper_ratio
from specforge.operators import rules
from specforge.operators.lines import by_line

# Headings, lines about the template itself, examples, sections below others.
CAPS = r"^([A-Z][A-Z0-9\s/()\-&,:;.–—]{2,})$"
META_LINES = (
    "COMPONENT TECHNICAL SPECIFICATION STANDARD TEMPLATE APPLICABLE FOR MECHATRONIC COMPONENT_STELLANTIS HARMONIZED", "Writing instructions are PRINTED IN RED, delete them before submitting the document for revision",
    "Avoid changing formatting display of the template", "WARNING", "Table of contents", "Table of updates", "DOCUMENT", "ARCHITECTURES", "CS.00050", "THIS IS AN INFORMATIVE TABLE; NOT TO BE INCLUDED IN YOUR SPEC",
)
EXAMPLE = r"^REF-|^GEN-|^APP-|^ER\s+ERF|^USE CASE|\bXXX\b|\bYYY\b|\(\d+\)$|^\d{2,}"
SUBSECTIONS = (
    "UPSTREAM REQUIREMENTS", "CONSTRAINT REQUIREMENTS FROM OTHER DISCIPLINES", "REGULATION AND CONSUMERISM", "MANDATORY REQUIREMENTS", "STANDARDS", "TECHNICAL SPECIFICATIONS", "TECHNICAL SPECIFICATIONS FOR CONNECTORS",
    "GENERAL TECHNICAL ON FAULT FINDING AND DOWNLOAD", "OTHER TECHNICAL SPECIFICATIONS APPLICABLE", "DEPENDABILITY VOCABULARY", "OTHER GENERIC TERMS", "MEASURING UNITS", "VOCABULARY SPECIFIC TO THE COMPONENT",
    "FUNCTIONAL COMPLEXITY", "ARCHITECTURE COMPLEXITY", "FUNCTIONAL DIVERSITY", "ARCHITECTURE DIVERSITY", "SYSTEM COMPLEXITY", "SYSTEM DIVERSITY",
)
# Rules of the guide, its headings, and words by which the language of a rule is told.
RULE = r"^([RP]\d{1,2})\s*:?\s*(.+)"
GUIDE_NUMBERED = r"^\d+(?:\.\d+)*\.?\s+([A-Z][A-Za-z\s/()\-&,:;.]{2,})$"
GUIDE_CAPS = r"^([A-Z][A-Z\s/()\-&,:;.–—]{2,})$"
LANGUAGES = {
    "R": (("shall", "must", "should", "the", "requirement", "rule", "document", "system", "presented"), ("exigence", "règle", "document", "système", "présenté", "rédaction", "doit", "sont")),
    "P": (("shall", "must", "should", "the", "requirement", "each", "service", "described", "system"), ("exigence", "règle", "chaque", "service", "décrit", "système", "doit")),
}
RECOMMENDED = (
    "MISSION PROFILE", "LIFETIME", "ERGONOMICS", "SAFETY", "MAINTAINABILITY", "PRODUCT QUALITY", "TRACEABILITY", "DESIGN AND MANUFACTURING", "ENVIRONMENT CONDITIONS", "INTEGRATION AND VALIDATION",
    "DEMONSTRATION OF COMPLIANCE",
)


def template_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, name, line_no, level, place): headings in capitals, without the template's own lines and examples; place counts the top ones before."""
    s = strip(F.col("line"))
    name = F.regexp_replace(strip(F.regexp_extract(s, CAPS, 1)), ":+$", "")
    d = lines.select("doc_id", "line_no", s.alias("s"), name.alias("name")).where((F.char_length("name") >= 3) & (F.char_length("s") <= 120) & (upper_ratio(F.col("name")) >= 0.8))
    d = d.where(~F.col("s").isin(*META_LINES) & ~F.col("name").isin(*META_LINES) & ~F.lower("s").startswith("figure") & ~F.col("name").rlike(EXAMPLE))
    first = d.groupBy("doc_id", "name").agg(F.min("line_no").alias("line_no")).withColumn("level", F.when(F.col("name").isin(*SUBSECTIONS), 2).otherwise(1))
    top = (F.col("level") == 1).cast("int")
    return first.withColumn("place", (F.sum(top).over(by_line()) - top).cast("int"))


def template_instructions(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, line_no, section, placeholder, instruction): placeholders and variables with the section that they stand in."""
    s = strip(F.col("line"))
    here = lines.withColumn("s", s).join(sections.select("doc_id", F.col("name").alias("s"), F.col("name").alias("_section")).distinct(), ["doc_id", "s"], "left")
    here = here.withColumn("_section", F.when(F.char_length("s") < 100, F.col("_section")))
    above = F.last("_section", True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    found = F.concat(F.regexp_extract_all("line", F.lit("(<<[^>]*>>)"), F.lit(1)), F.regexp_extract_all("line", F.lit(f"({rules.VARIABLE})"), F.lit(1)))
    return here.select("doc_id", "line_no", F.coalesce(above, F.lit("")).alias("section"), found.alias("f"), F.substring("s", 1, 200).alias("instruction")).select("doc_id", "line_no", "section", F.explode("f").alias("placeholder"), "instruction")


def leftover_sentences(instructions: DataFrame, least: int = 40) -> DataFrame:
    """Distinct sentences of placeholders, normalised, that are long enough to be told from other text."""
    inner = F.lower(strip(F.regexp_replace(F.regexp_replace("placeholder", r"^<<|>>$", ""), r"\s+", " ")))
    return instructions.select(inner.alias("sentence")).where(F.char_length("sentence") >= least).distinct()


def _words(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))


def guide_rules(lines: DataFrame) -> DataFrame:
    """(doc_id, rule_id, category, section, text, line_no): of each number the first text, replaced by a later one that reads more English than
    French and is no shorter than the one that is held by then."""
    s = F.regexp_replace(F.col("line"), r"^ +| +$", "")
    head = F.when(F.char_length(s) < 100, F.coalesce(F.when(s.rlike(GUIDE_NUMBERED), F.regexp_extract(s, GUIDE_NUMBERED, 1)), F.when(s.rlike(GUIDE_CAPS), F.regexp_extract(s, GUIDE_CAPS, 1))))
    above = F.last("_head", True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    d = lines.withColumns({"s": s, "_head": head}).withColumn("section", F.regexp_replace(strip(F.coalesce(above, F.lit(""))), ":+$", ""))
    d = d.select("doc_id", "line_no", "s", "section", F.regexp_extract("s", RULE, 1).alias("rule_id"), strip(F.regexp_extract("s", RULE, 2)).alias("text"))
    d = d.where((F.col("rule_id") != "") & (F.char_length("text") >= 10) & ~F.col("s").rlike(r"\t\d+$"))
    kind = F.substring("rule_id", 1, 1)
    english = F.when(kind == "R", _words(F.col("text"), LANGUAGES["R"][0]) > _words(F.col("text"), LANGUAGES["R"][1])).otherwise(_words(F.col("text"), LANGUAGES["P"][0]) > _words(F.col("text"), LANGUAGES["P"][1]))
    per = d.groupBy("doc_id", "rule_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "section", "text", english.alias("english")))).alias("xs"))
    best = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs"), F.lit(1))), F.get("xs", F.lit(0)), lambda a, x: F.when(x["english"] & (F.char_length(x["text"]) >= F.char_length(a["text"])), x).otherwise(a))
    return per.withColumn("b", best).select("doc_id", "rule_id", F.when(F.col("rule_id").startswith("R"), "rule").otherwise("principle").alias("category"), "b.section", "b.text", "b.line_no")


def recommended(lines: DataFrame) -> DataFrame:
    """(doc_id, name): recommended sections that a guide names anywhere."""
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n"))
    d = lines.groupBy("doc_id").agg(text.alias("low"))
    return d.select("doc_id", F.explode(F.filter(F.array(*[F.lit(n) for n in RECOMMENDED]), lambda n: F.contains(F.col("low"), F.lower(n)))).alias("name"))

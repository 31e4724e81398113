"""Report tables: groupings that feed the reports, without their rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions.text import strip
from specforge.operators import rules, scoring
from specforge.operators.lines import detected_sections, first_review_heading, with_section


def placeholder_places(lines: DataFrame, shown: int = 5) -> DataFrame:
    """(doc_id, label, n, first_lines): placeholders by label, with the first lines that hold them."""
    label = F.array_compact(F.array(F.when(F.col("line").rlike(rules.PLACEHOLDER), "template_placeholder"), F.when(F.col("line").rlike(r"(?i)\bTBD\b"), "tbd_placeholder"), F.when(F.col("line").rlike(r"\bXXX\b"), "xxx_placeholder")))
    hits = lines.select("doc_id", "line_no", F.explode(label).alias("label"))
    return hits.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("line_no")), 1, shown).alias("first_lines"))


def requirement_quality(lines: DataFrame) -> DataFrame:
    """Per document: table rows with an identifier, with an input requirement, with a weak description, and their shares."""
    cells = F.transform(F.split("line", r"\|"), lambda c: strip(c))
    rows = lines.withColumn("cells", cells).where((F.size("cells") >= 3) & F.col("line").rlike(rules.SHALL))
    ref = F.get("cells", F.lit(2))
    d = rows.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(F.get("cells", F.lit(0)).rlike(rules.REQUIREMENT_ID)).alias("with_id"),
        F.count_if(~ref.isin("", "N/A")).alias("with_input"), F.count_if(F.char_length(F.get("cells", F.lit(1))) < 40).alias("weak"),
    )
    return d.withColumns({"id_share": F.col("with_id") / F.col("total"), "input_share": F.col("with_input") / F.col("total")})


def section_summary(lines: DataFrame) -> DataFrame:
    """(doc_id, section, requirements, placeholders, issues): counters per section, in one pass over lines with their section."""
    line = F.col("line")
    d = with_section(lines).where("section is not null")
    residue = F.regexp_count(line, F.lit(rules.PLACEHOLDER)) + F.regexp_count(line, F.lit(rules.TBD))
    return d.groupBy("doc_id", "section").agg(
        F.count_if(rules.is_shall(line)).alias("requirements"), F.sum(residue).cast("long").alias("placeholders"), F.count_if(line.rlike(rules.SHALL) & line.rlike(rules.SUBJECTIVE)).alias("issues")
    )


def matrix_stats(found: DataFrame, shown: int = 10) -> DataFrame:
    """Per document of requirements (doc_id, req_id, line_no): total, with and without identifier, the first identifiers."""
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("req_id") != "", F.struct("line_no", "req_id")))), lambda x: x["req_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(F.col("req_id") != "").alias("with_id"), F.count_if(F.col("req_id") == "").alias("without_id"), F.slice(ids, 1, shown).alias("first_ids"))


#: Weights of the first review's axes: structure, cleanliness, requirements, writing guide.
WEIGHTS_V1 = (0.35, 0.15, 0.30, 0.20)
# Patterns of the first review.
VARIABLE_V1 = r"<component name>|<part name>|<Part name>|<name of the Model>|<reference>|<PSP>"
TRACE_V1 = (
    r"(?i)\binput\s+requirement\b|\bderived\s+from\b|\bbased\s+on\b.{0,50}(?:requirement|spec|standard|regulation)|\b(?:traced|traceable)\s+to\b"
    r"|\boriginating\s+(?:from|requirement)\b|\bupstream\s+(?:requirement|source)\b|\bsource\s+(?:requirement|document|spec)\b|\bISO\s*\d{4,6}(?:[:\-]\d+)?\b"
    r"|\bSAE[-\s]?[JZ]\d+\b|\bECER\d{2,3}\b|\bFMVSS\s*\d+\b|\bISTA\s*\d[\.\d]*\b|\btraced?\s+(?:to|from)\b",
    r"\bVF_\d{2,6}\b|\bCS\.\d{4,6}\b|PSA_Comments@|Att_Sdf@|\[([A-Z]{2,}[_\s][A-Z]{2,}[_\d]*)\]|\b[tT]raceability\b|\bN/A\b",
)


def met_v1(required: str) -> Column:
    """Whether a detected section (names) meets a required one: one name in the other, or 60 % of the required words."""
    want = sorted(set(required.lower().split()))

    def fits(n: Column) -> Column:
        low = F.lower(n)
        shared = F.size(F.array_intersect(F.split(low, r"\s+"), F.array(*[F.lit(w) for w in want])))
        return F.contains(low, F.lit(required.lower())) | F.contains(F.lit(required.lower()), low) | (shared * 10 >= 6 * len(want))

    return F.exists("names", fits)


def v1_report(lines: DataFrame, mandatory=lexicon.MANDATORY_SECTIONS, recommended=lexicon.RECOMMENDED_SECTIONS) -> DataFrame:
    """First review: four axes and the weighted score (two decimals), the verdict, and counts of findings by severity.  A blank document is one error."""
    l = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("rows"))
    heads = detected_sections(lines, first_review_heading).groupBy("doc_id").agg(F.collect_list("section").alias("names"))
    d = l.join(heads, "doc_id", "left").withColumns({"names": F.coalesce("names", F.array().cast("array<string>")), "text": F.array_join("rows", "\n")})
    rows, text = F.col("rows"), F.col("text")
    count = lambda p: F.regexp_count(text, F.lit(p))
    missed = lambda names: sum(((~met_v1(n)).cast("int") for n in names), F.lit(0))
    sentences = F.filter(rows, rules.is_shall)
    around = lambda i: F.array_join(F.slice(rows, F.greatest(i - 9, F.lit(1)), F.least(i, F.lit(10)) + 11), " ")
    placed = F.filter(F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: rules.is_shall(s["x"]))
    ids = F.size(F.array_distinct(F.flatten(F.transform(rows, lambda x: F.regexp_extract_all(x, F.lit(f"({rules.REQUIREMENT_ID})"), F.lit(1))))))
    d = d.select(
        "doc_id", "text", "names", missed(mandatory).alias("missing"), missed(recommended).alias("unrecommended"), count(rules.PLACEHOLDER).alias("placeholders"), count(rules.TBD).alias("tbds"),
        count(VARIABLE_V1).alias("variables"), F.size(sentences).alias("total"), ids.alias("ids"), F.size(F.filter(sentences, lambda x: x.rlike(rules.REQUIREMENT_ID))).alias("inline"),
        F.size(F.filter(placed, lambda s: around(s["i"]).rlike(rules.REQUIREMENT_ID))).alias("nearby"), F.size(F.filter(sentences, lambda x: x.rlike(TRACE_V1[0]) | x.rlike(TRACE_V1[1]))).alias("traced"),
        count(rules.SHALL).alias("shall"), count(r"(?i)\bshould\b").alias("should"), count(r"(?i)\bmay\b").alias("may"),
    )
    near = F.when(F.col("inline") > 0, F.col("inline")).when(F.col("ids") > 0, F.col("nearby")).otherwise(0)
    d = d.withColumn("with_id", F.when(near > 0, near).otherwise(F.least("ids", "total")))
    told = F.exists("names", lambda n: F.lower(n).rlike("update|revision|history")) | text.rlike(r"(?i)table\s+of\s+updates|revision\s+history|update\s+history")
    faults = (
        (~told, 0.1), (~text.rlike(r"(?i)author|identification|RSP-\d+"), 0.1), ((F.col("shall") == 0) & ((F.col("should") > 5) | (F.col("may") > 5)), 0.15),
        (~text.rlike(r"(?i)figure\s+<?\d+|picture\s+\d+|table\s+\d+"), 0.05), (met_v1("ACRONYMS") & ~text.rlike(r"[A-Z]{2,}\s*[:\-—]\s*[A-Z]"), 0.05),
    )
    d = d.withColumns({f"_f{k}": test for k, (test, _) in enumerate(faults)})
    lost = sum((F.when(F.col(f"_f{k}"), w).otherwise(0.0) for k, (_, w) in enumerate(faults)), F.lit(0.0))
    found = sum((F.col(f"_f{k}").cast("int") for k in range(len(faults))), F.lit(0))
    total, some = F.col("total"), lambda c: (c > 0).cast("int")
    axes = {
        "structure": scoring.structure_curve((len(mandatory) - F.col("missing")) / len(mandatory)), "cleanliness": scoring.cleanliness(F.col("placeholders") + F.col("tbds") + F.col("variables")),
        "requirements": F.least(F.lit(1.0), scoring.requirements_v1(total, F.col("with_id") / total, F.col("traced") / total)), "writing_guide": F.greatest(1 - lost, F.lit(0.0)),
    }
    blank = strip(F.col("text")) == ""
    warnings = F.col("unrecommended") + some(F.col("placeholders")) + some(F.col("tbds")) + some(F.col("variables")) + found
    warnings = warnings + ((total > 0) & (F.col("with_id") == 0)).cast("int") + ((total > 0) & (F.col("traced") == 0)).cast("int")
    d = d.select(
        "doc_id", blank.alias("blank"), F.when(blank, 1).otherwise(F.col("missing") + (total == 0).cast("int")).alias("errors"), F.when(blank, 0).otherwise(warnings).alias("warnings"),
        F.when(blank, 0).otherwise(some(total)).alias("infos"), "total", "with_id", "traced", *[F.when(~blank, scoring.two_decimals(c)).alias(a) for a, c in axes.items()],
    )
    overall = scoring.two_decimals(sum((F.col(a) * w for a, w in zip(axes, WEIGHTS_V1, strict=True)), F.lit(0.0)))
    d = d.withColumn("overall", F.coalesce(overall, F.lit(0.0)))
    return d.withColumn("verdict", F.when(F.col("blank"), "NON_COMPLIANT").otherwise(scoring.verdict(F.col("overall"), F.col("errors")))).drop("blank")

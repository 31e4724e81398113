"""The review of a specification by its lines: sections as paths, contents of sections, leftovers, rows of requirements, and what joins findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge.functions.text import bound, strip
from specforge.operators import rules, scoring
from specforge.operators.lines import by_line

# Headings as the review sees them.
NUMBERED_CAPS = r"^\d+[.)\-\s/]\s*([A-Z][A-Z\s/()\-&,:;.–—]{3,})$"
PLAIN_CAPS = r"^([A-Z][A-Z\s/()\-&,:;.–—]{3,})$"
LEVELLED = r"^(\d+(?:\.\d+)+\.?\s+[A-Z][A-Za-z\s/()\-&,:;.]{3,})$"
LEVELLED_NAME = r"^\d+(?:\.\d+)+\s+([A-Z][A-Za-z\s/()\-&,:;.]{3,})$"
CAPS_NAME = r"^[A-Z][A-Z\s/()\-&,:;.–—]{3,}$"
# Sections that are looked for anywhere, those whose lack is an error, and those of the structure's score.
EXPECTED = (
    "PURPOSE", "SCOPE", "SYSTEM DEVELOPMENT CONTEXT", "GENERAL DESCRIPTION OF THE SYSTEM", "SYSTEM ROLES", "PHYSICAL SYSTEM ARCHITECTURE", "SYSTEM DIVERSITY", "QUOTED DOCUMENTS", "REFERENCE DOCUMENTS",
    "UPSTREAM REQUIREMENTS", "CONSTRAINT REQUIREMENTS FROM OTHER DISCIPLINES", "REGULATION AND CONSUMERISM", "MANDATORY REQUIREMENTS", "APPLICABLE DOCUMENTS", "STANDARDS", "TECHNICAL SPECIFICATIONS",
    "TERMINOLOGY", "GLOSSARY", "ACRONYMS", "REQUIREMENTS", "FUNCTIONAL REQUIREMENTS", "PERFORMANCE REQUIREMENTS", "EXTERNAL INTERFACES REQUIREMENTS", "ELECTRICAL INTERFACES", "MECHANICAL INTERFACES",
    "HUMAN-MACHINE INTERFACES", "OPERATIONAL REQUIREMENTS", "MISSION PROFILE", "LIFETIME", "ERGONOMICS AND HUMAN FACTORS", "RAMS REQUIREMENTS", "SAFETY REQUIREMENTS", "MAINTAINABILITY", "PRODUCT QUALITY",
    "CONSTRAINT REQUIREMENTS", "DESIGN AND MANUFACTURING", "MATERIALS", "MANUFACTURING", "ENVIRONMENT CONDITIONS", "INTEGRATION AND VALIDATION REQUIREMENTS", "DEMONSTRATION OF COMPLIANCE WITH REQUIREMENTS",
    "IMPOSED ELEMENTS OF VALIDATION PLAN",
)
KEY_SECTIONS = (
    "FUNCTIONAL REQUIREMENTS", "PERFORMANCE REQUIREMENTS", "EXTERNAL INTERFACES REQUIREMENTS", "OPERATIONAL REQUIREMENTS", "RAMS REQUIREMENTS", "CONSTRAINT REQUIREMENTS",
    "INTEGRATION AND VALIDATION REQUIREMENTS", "VALIDATION PLAN",
)
SCORED = (
    "PURPOSE", "SCOPE", "SYSTEM DEVELOPMENT CONTEXT", "GENERAL DESCRIPTION", "SYSTEM ROLES", "PHYSICAL SYSTEM ARCHITECTURE", "SYSTEM DIVERSITY", "QUOTED DOCUMENTS", "REFERENCE DOCUMENTS", "APPLICABLE DOCUMENTS",
    "TERMINOLOGY", "GLOSSARY", "ACRONYMS", "REQUIREMENTS", "FUNCTIONAL REQUIREMENTS", "PERFORMANCE REQUIREMENTS", "EXTERNAL INTERFACES", "OPERATIONAL REQUIREMENTS", "MISSION PROFILE", "RAMS REQUIREMENTS",
    "CONSTRAINT REQUIREMENTS", "INTEGRATION AND VALIDATION", "DEMONSTRATION OF COMPLIANCE",
)
LEFTOVERS = (
    (r"<<[^>]*>>", "template_placeholder"), (r"(?i)\bTBD\b", "tbd_placeholder"), (r"\bXXX\b", "xxx_placeholder"), (r"<<\s*\(\*\).*?>>", "template_instruction"),
)
NOT_APPLICABLE = r"(?i)^(?:N/?A|Not\s+Applicable|NA)\s*$"
NO_SECTION = r"(?i)^(?:Sections?:?\s*\[|Sections?:?\s|THEN\s|ELSE\s|IF\s|OF\s+THE\s|AND\s|OR\s|VERSION\s*$|\d+\s|0\s*=?\s|\d+$|x+$|\[MISSING\]|\d+\s+requirements?$)"
TRANSITION = (
    r"(?i)(?:switch|transition|go|move)\s+(?:from\s+)?([A-Z][\w\s]{2,30}?)\s+(?:to|into)\s+([A-Z][\w\s]{2,30}?)(?:\s*,|\s*\.|\s*$|\s*\n|\s+and|\s+or|\s+the|\s+shall)"
)
STATE = r"(?im)(?:^|\n|\s{2,})([A-Z][\w\s]{2,30}?)\s*(?:state|mode|status)(?:\s*[:;.\-]|\s*$)"
STATE_NAME = r"^[A-Z][\w\s]{2,30}$"
EXTERNAL, INDIRECT = r"\[[A-Z]+\d*\]", r"(?i)\b(?:respect|comply|accord(?:ance)?|specified|defined|described|refer(?:enced)?|see|per)\b"
START = "Document Start"


def clean_name(c: Column) -> Column:
    """A heading's name: without a colon at its end, up to a dash, blanks collapsed."""
    return F.regexp_replace(strip(F.element_at(F.split(F.regexp_replace(strip(c), r"\s*:\s*$", ""), r"\s*[–—-]\s*"), 1)), r"\s+", " ")


def headings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, level): headings with the level that they stand at; capitals stand at the top."""

    def found(s: Column) -> Column:
        caps = F.coalesce(*[bound(clean_name(F.regexp_extract(s, p, 1)), lambda n: F.when(F.char_length(n) >= 4, n)) for p in (NUMBERED_CAPS, PLAIN_CAPS)])

        def levelled(whole: Column) -> Column:
            name = clean_name(F.regexp_replace(whole, r"^\d+(?:\.\d+)*\.?\s*", ""))
            dots = F.regexp_count(whole, F.lit(r"\."))
            return F.when(whole != "", bound(name, lambda n: F.struct(n.alias("name"), F.when(n.rlike(CAPS_NAME), 1).otherwise(F.least(dots + 1, F.lit(4))).alias("level"))))

        top = bound(caps, lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit(1).alias("level"))))
        return F.coalesce(top, bound(strip(F.regexp_extract(s, LEVELLED, 1)), levelled))

    plain = F.regexp_replace(strip(F.col("line")), r"^#+\s*", "")
    head = bound(plain, lambda s: F.when(F.char_length(s).between(4, 120), found(s)))
    return lines.select("doc_id", "line_no", head.alias("h")).where("h is not null").select("doc_id", "line_no", "h.name", "h.level")


def paths(lines: DataFrame) -> DataFrame:
    """lines with `section`, the path of the heading above: '[TOP] > leaf', '[TOP]', or 'Document Start'.

    A heading cuts the stack to its level less one and goes on top; only a document's headings are folded, its lines look back to them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "name", "level")))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<line_no:bigint,path:string>>").alias("out"))

    def step(a: Column, h: Column) -> Column:
        stack = F.concat(F.slice(a["stack"], 1, h["level"] - 1), F.array(h["name"]))
        label = lambda st: F.when(F.size(st) >= 2, F.concat(F.lit("["), F.element_at(st, 1), F.lit("] > "), F.element_at(st, -1))).otherwise(F.concat(F.lit("["), F.element_at(st, 1), F.lit("]")))
        return bound(stack, lambda st: F.struct(st.alias("stack"), F.concat(a["out"], F.array(F.struct(h["line_no"].cast("long").alias("line_no"), label(st).alias("path")))).alias("out")))

    folded = headings(lines).groupBy("doc_id").agg(ordered.alias("h")).select("doc_id", F.explode(F.aggregate("h", start, step, lambda a: a["out"])).alias("x"))
    marked = lines.join(folded.select(F.col("doc_id").alias("_d"), F.col("x.line_no").alias("_l"), F.col("x.path").alias("_path")), (F.col("doc_id") == F.col("_d")) & (F.col("line_no") == F.col("_l")), "left")
    above = F.last("_path", True).over(by_line().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("section", F.coalesce(above, F.lit(START))).drop("_d", "_l", "_path")


def top_of(section: Column) -> Column:
    """'TOP' of '[TOP] > leaf'."""
    return bound(F.regexp_extract(section, r"\[([^\]]+)\]", 1), lambda t: F.when(t != "", t).otherwise(section))


def is_section_name(c: Column) -> Column:
    """A name that a report may show: 4 to 100 characters with a letter, no fragment of a sentence."""
    return bound(strip(c), lambda s: F.char_length(s).between(4, 100) & ~s.rlike(NO_SECTION) & s.rlike("[A-Za-z]") & ~s.rlike(r"^[\d\sxX×<>\[\]\(\)\{\}@#$%^&*=+./\\|-]+$"))


def contents(lines: DataFrame) -> DataFrame:
    """(doc_id, section, status, lines, chars, statements) of the top sections: empty, na_only, has_placeholders, minimal_content or ok."""
    d = paths(lines).withColumn("top", top_of(F.col("section"))).where(F.col("top") != START)
    s = strip(F.col("line"))
    filled, na = s != "", s.rlike(NOT_APPLICABLE)
    own = filled & ~s.rlike(r"^[A-Z][A-Z\s/()-]{5,}$") & ~s.rlike(r"(?i)^(?:N/?A|Not\s+Applicable)\s*$")
    count = lambda p: F.sum(F.regexp_count("line", F.lit(p)))
    per = d.groupBy("doc_id", F.col("top").alias("section")).agg(
        F.count_if(filled).alias("filled"), F.count_if(filled & ~na).alias("told"), F.count_if(own).alias("own"), F.sum(F.when(own, F.char_length(s)).otherwise(0)).alias("chars"),
        (count(r"<<[^>]*>>") + count(r"(?i)\bTBD\b") + count(r"\bXXX\b")).alias("left"), count(r"(?i)\b(?:shall|must)\b").alias("statements"),
    )
    status = (
        F.when(F.col("filled") == 0, "empty").when(F.col("told") == 0, "na_only").when(F.col("left") > 0, "has_placeholders").when((F.col("own") >= 5) | (F.col("chars") >= 100), "ok").otherwise("minimal_content")
    )
    return per.select("doc_id", "section", status.alias("status"), F.col("own").alias("lines"), "chars", "statements")


def scan(lines: DataFrame) -> DataFrame:
    """(doc_id, found, added, missing, missing_keys, structure): headings, expected sections that only the text names, those that nothing names."""
    s = F.regexp_replace(strip(F.col("line")), r"^#+\s*", "")

    def name(x: Column) -> Column:
        each = [bound(clean_name(F.regexp_extract(x, p, 1)), lambda n: F.when(n != "", n)) for p in (NUMBERED_CAPS, PLAIN_CAPS, LEVELLED_NAME)]
        return F.when(F.char_length(x).between(4, 120), F.coalesce(*each))

    heads = F.collect_set(F.when(F.char_length("name").between(5, 79), F.col("name")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    d = lines.withColumn("name", bound(s, name)).groupBy("doc_id").agg(heads.alias("heads"), F.lower(text).alias("low"))
    d = d.withColumn("lows", F.transform("heads", F.lower))
    expected = F.array(*[F.lit(x) for x in EXPECTED])
    headed = lambda x: F.exists("lows", lambda h: F.contains(h, F.lower(x)))
    d = d.withColumn("_named", F.filter(expected, lambda x: ~headed(x) & F.contains(F.col("low"), F.lower(x))))
    # an earlier added section that holds this one's name stands for it
    added = F.filter("_named", lambda x, i: ~F.exists(F.slice("_named", 1, i), lambda y: F.contains(y, x)))
    d = d.withColumns({"_added": added, "_missing": F.filter(expected, lambda x: ~headed(x) & ~F.contains(F.col("low"), F.lower(x)))})
    every = F.concat("lows", F.transform("_added", F.lower))
    met = F.size(F.filter(F.array(*[F.lit(x.lower()) for x in SCORED]), lambda x: F.exists(every, lambda h: F.contains(h, x))))
    keys = F.filter("_missing", lambda x: x.isin(*KEY_SECTIONS))
    return d.select(
        "doc_id", F.size("heads").alias("found"), F.size("_added").alias("added"), F.size("_missing").alias("missing"), F.array_join(F.slice(keys, 1, 5), ", ").alias("missing_keys"),
        F.round(scoring.structure_curve(met / len(SCORED)), 9).alias("structure"),
    )


def leftovers(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, label, text): every placeholder, under each pattern that finds it."""
    s = strip(F.col("line"))
    found = [F.transform(F.regexp_extract_all(s, F.lit(f"({p})"), F.lit(1)), _labelled(label, k)) for k, (p, label) in enumerate(LEFTOVERS)]
    return lines.select("doc_id", "line_no", F.explode(F.flatten(F.array(*found))).alias("x")).select("doc_id", "line_no", "x.label", F.substring("x.text", 1, 120).alias("text"), "x.k", "x.i")


def _labelled(label: str, k: int):
    return lambda t, i: F.struct(F.lit(label).alias("label"), t.alias("text"), F.lit(k).alias("k"), i.alias("i"))


def leftover_findings(lines: DataFrame, shown: int = 5) -> DataFrame:
    """(doc_id, label, n, places, example, sections): a finding per label, with the lines (from 1) of its first instances and their sections."""
    d = leftovers(lines).join(paths(lines).select("doc_id", "line_no", "section"), ["doc_id", "line_no"])
    order = F.array_sort(F.collect_list(F.struct("line_no", "i", "text", "section")))
    per = d.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.slice(order, 1, shown).alias("o"))
    places = F.array_join(F.transform("o", lambda x: F.concat(F.lit("line "), (x["line_no"] + 1).cast("string"))), ", ")
    sections = F.array_join(F.array_sort(F.array_distinct(F.transform("o", lambda x: x["section"]))), " | ")
    return per.select("doc_id", "label", "n", places.alias("places"), F.get("o", F.lit(0))["text"].alias("example"), sections.alias("sections"))


def merged_leftovers(found: DataFrame) -> DataFrame:
    """One finding per document in place of several of leftovers: kinds, and instances of all of them."""
    return found.groupBy("doc_id").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).withColumn("type", F.when(F.col("kinds") > 1, "template_artifacts").otherwise("placeholder_detected"))


# ---------------------------------------------------------------- rows of requirements
def row_findings(rows: DataFrame) -> DataFrame:
    """(doc_id, total, no_id, not_applicable, weak, id_finding, weak_finding, traceability, structured, pattern_finding) over requirement rows."""
    desc, own, up = (strip(F.coalesce(c, F.lit(""))) for c in ("description", "req_id", "input_requirement"))
    raw = F.coalesce("description", F.lit(""))
    before, trigger = raw.rlike(r"(?i)(?:when|if|during|upon|after)\s+"), raw.rlike(r"(?i)\b(?:shall|must|will)\b")
    d = rows.groupBy("doc_id").agg(
        F.count("*").alias("total"), F.count_if(own == "").alias("no_id"), F.count_if(up.rlike(r"(?i)^N/?A$|^Not\s+Applicable$")).alias("not_applicable"), F.count_if((desc != "") & (F.char_length(desc) < 30)).alias("weak"),
        F.count_if(~up.isin("N/A", "n/a", "", "N / A")).alias("traced"), F.count_if(before & trigger).alias("structured"), F.count_if(~before & trigger).alias("unconditioned"),
    )
    return d.select(
        "doc_id", "total", "no_id", "not_applicable", "weak", F.when(F.col("no_id") > 0, "warning").otherwise("none").alias("id_finding"), F.when(F.col("weak") * 5 > F.col("total"), "warning").otherwise("none").alias("weak_finding"),
        scoring.traceability_rubric(F.col("traced") / F.col("total"), F.col("total")).alias("traceability"), "structured", "unconditioned", F.when(F.col("structured") * 2 < F.col("total"), "warning").otherwise("none").alias("pattern_finding"),
    )


def row_issues(rows: DataFrame) -> DataFrame:
    """(doc_id, table_index, row_index, section, type, req_id, description): several issues a row."""
    desc, own, up = (strip(F.coalesce(c, F.lit(""))) for c in ("description", "req_id", "input_requirement"))
    bare = strip(F.regexp_replace(desc, EXTERNAL, ""))
    kinds = F.array_compact(
        F.array(
            F.when(own == "", "missing_id"), F.when(desc.rlike(rules.PLACEHOLDER) | desc.rlike(r"\bXXX\b"), "placeholder_in_desc"), F.when(F.upper(up).isin("N/A", "N / A", "NA", ""), "missing_input_ref"),
            F.when((desc != "") & (F.char_length(desc) < 40), "weak_description"), F.when((own != "") & desc.rlike(EXTERNAL) & desc.rlike(INDIRECT) & (F.char_length(bare) < 60), "indirect_requirement"),
        )
    )
    return rows.select("doc_id", "table_index", "row_index", "section", F.explode(kinds).alias("type"), F.when(own == "", "[MISSING]").otherwise(own).alias("req_id"), F.substring(desc, 1, 150).alias("description"))


def issue_groups(issues: DataFrame) -> DataFrame:
    """(doc_id, type, severity, req_id, description, n): issues alike in type and first three telling words are shown one by one (two at most), or as a pattern."""
    told = F.slice(F.filter(F.split("description", r"\s+"), lambda w: F.char_length(w) > 2), 1, 3)
    d = issues.withColumn("key", F.when(F.size(told) > 0, F.array_join(told, " ")).otherwise("[empty]"))
    order = F.array_sort(F.collect_list(F.struct("table_index", "row_index", "req_id", "description")))
    per = d.groupBy("doc_id", "type", "key").agg(F.count("*").alias("n"), order.alias("o"))
    filled = F.filter("o", lambda x: x["description"] != "")
    single = F.transform(filled, lambda x: F.struct(x["req_id"].alias("req_id"), x["description"].alias("description"), F.lit(1).cast("long").alias("n")))
    example = F.coalesce(F.substring(F.get(filled, F.lit(0))["description"], 1, 80), F.lit("[empty description]"))
    pattern = F.array(F.struct(F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" requirements]")).alias("req_id"), example.alias("description"), F.col("n").alias("n")))
    severity = F.when(F.col("type").isin("missing_id", "placeholder_in_desc"), "error").otherwise("warning")
    return per.select("doc_id", "type", severity.alias("severity"), F.inline(F.when(F.col("n") <= 2, single).otherwise(pattern)))


def repeated_descriptions(rows: DataFrame) -> DataFrame:
    """(doc_id, description, tables, n): heads of descriptions (80 characters, 15 at least) that two tables or more share."""
    head = F.lower(F.substring(strip(F.coalesce("description", F.lit(""))), 1, 80))
    d = rows.withColumn("head", head).where(F.char_length("head") >= 15).withColumn("head", F.regexp_replace("head", r"\s+", " "))
    per = d.groupBy("doc_id", "head").agg(F.count_distinct("table_index").alias("tables"), F.count("*").alias("n")).where("tables >= 2")
    return per.select("doc_id", F.substring("head", 1, 100).alias("description"), "tables", "n")


def section_counts(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, section, status, issues, requirements, placeholders) of sections with a showable name, most issues and placeholders first when
    ordered by (issues + placeholders) descending; three grouped sources under one key."""
    left = leftovers(lines).join(paths(lines).select("doc_id", "line_no", "section"), ["doc_id", "line_no"]).select("doc_id", top_of(F.col("section")).alias("section"), F.lit("placeholders").alias("what"))
    poor = row_issues(rows).select("doc_id", "section", F.lit("requirements").alias("what"))
    weak = contents(lines).where("status <> 'ok'").select("doc_id", "section", F.lit("issues").alias("what"))
    every = left.unionByName(poor).unionByName(weak).where(is_section_name(F.col("section")))
    n = lambda what: F.count_if(F.col("what") == what).alias(what)
    per = every.groupBy("doc_id", "section").agg(n("issues"), n("requirements"), n("placeholders"))
    known = contents(lines).select("doc_id", "section", "status")
    return per.join(known, ["doc_id", "section"], "left").select("doc_id", "section", F.coalesce("status", F.lit("checked_with_issues")).alias("status"), "issues", "requirements", "placeholders")


# ---------------------------------------------------------------- states
def states(texts: DataFrame) -> DataFrame:
    """(doc_id, states, transitions, no_way_in, no_way_out, findings) of whole texts: names of states and moves between them."""
    good = lambda xs: F.filter(F.transform(xs, strip), lambda s: s.rlike(STATE_NAME))
    each = lambda p, k: F.regexp_extract_all("text", F.lit(p), F.lit(k))
    moves = F.filter(F.arrays_zip(F.transform(each(TRANSITION, 1), strip).alias("a"), F.transform(each(TRANSITION, 2), strip).alias("b")), lambda m: m["a"].rlike(STATE_NAME) & m["b"].rlike(STATE_NAME))
    d = texts.select("doc_id", F.array_distinct(good(each(STATE, 1))).alias("s"), moves.alias("m"))
    a, b = F.array_distinct(F.transform("m", lambda m: m["a"])), F.array_distinct(F.transform("m", lambda m: m["b"]))
    known = (F.size("s") > 0) & (F.size("m") > 0)
    count = lambda x, y: F.when(known, F.size(F.array_except(x, y))).otherwise(0)
    d = d.select("doc_id", F.size("s").alias("states"), F.size("m").alias("transitions"), count(a, b).alias("no_way_in"), count(b, a).alias("no_way_out"))
    return d.withColumn("findings", (F.col("no_way_in") > 2).cast("int") + (F.col("no_way_out") > 1).cast("int"))


# ---------------------------------------------------------------- findings of a model beside those of rules
def verified(evidence: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, finding_id, verdict, n, template_only) of pieces of evidence (doc_id, finding_id, source_document, excerpt, support).

    A piece is verified if its excerpt (or, of a short one, its support) stands in the document's text; one from the template alone that
    doesn't is no evidence.  A finding all of whose pieces are such is a hypothesis.
    """
    src = F.lower(F.coalesce("source_document", F.lit("")))
    template = src.contains("template") & ~src.contains("writing") & ~src.contains("guide") & ~src.contains("deterministic")
    said = F.coalesce("excerpt", F.lit(""))
    looked = F.when(F.char_length(said) < 10, F.coalesce("support", F.lit(""))).otherwise(said)
    d = evidence.join(texts, "doc_id").withColumn("_looked", looked)
    here = (F.char_length("_looked") >= 10) & (F.contains("text", F.col("_looked")) | F.contains("text", F.substring("_looked", 1, 40)))
    per = d.groupBy("doc_id", "finding_id").agg(F.count("*").alias("n"), F.count_if(~here & template).alias("template_only"))
    return per.select("doc_id", "finding_id", F.when(F.col("n") == F.col("template_only"), "hypothesis").otherwise("verified").alias("verdict"), "n", "template_only")


def completed(model: DataFrame, own: DataFrame) -> DataFrame:
    """Findings (doc_id, type, severity) of the model, and of the rules those of types that the model hasn't named."""
    missed = own.join(model.select("doc_id", "type").distinct(), ["doc_id", "type"], "left_anti")
    return model.select("doc_id", "type", "severity", F.lit("model").alias("origin")).unionByName(missed.select("doc_id", "type", "severity", F.lit("rules").alias("origin")))


def model_verdicts(found: DataFrame, answers: DataFrame) -> DataFrame:
    """Findings (key, severity) with the model's verdict for their key; the rule's own where there is none."""
    return found.join(answers.select("key", F.col("severity").alias("_told")), "key", "left").select("key", F.coalesce("_told", "severity").alias("severity"), F.when(F.col("_told").isNull(), "motifs").otherwise("ia").alias("method"))


def parsed(answer: Column, kind: str) -> Column:
    """A model's answer as a struct: code fences taken away; null if it isn't JSON of that kind."""
    bare = F.regexp_replace(F.regexp_replace(strip(answer), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(bare, kind)


# ---------------------------------------------------------------- lookups by section
def section_rules(sections: DataFrame, catalogue: DataFrame, defaults: tuple[str, ...]) -> DataFrame:
    """(section, rules) of sections: those of the same name, else of the first entry (place) of which one name holds the other, else the default ones.

    The catalogue (name, place, rule) is a handful of fixed rows, gathered into one.
    """
    per = catalogue.groupBy("name").agg(F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", "rule"))).alias("r"))
    book = per.agg(F.array_sort(F.collect_list(F.struct("place", "name", "r"))).alias("book"))
    d = sections.select("section", F.upper(F.trim("section")).alias("s")).crossJoin(F.broadcast(book))
    same = F.get(F.filter("book", lambda b: b["name"] == F.col("s")), F.lit(0))
    near = F.get(F.filter("book", lambda b: F.contains(F.col("s"), b["name"]) | F.contains(b["name"], F.col("s"))), F.lit(0))
    found = F.transform(F.coalesce(same, near)["r"], lambda r: r["rule"])
    return d.select("section", F.coalesce(found, F.array(*[F.lit(x) for x in defaults])).alias("rules"))


def plain_name(c: Column) -> Column:
    """Capitals and digits only, other signs as single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.upper(strip(c)), r"[^A-Z0-9\s]", " "), r"\s+", " "))


def nearest_section(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(target, section): of known sections (name, place) the first that holds the target or lies in it, then the same without signs, then the one
    that shares most of its words (two, and half of them); null without one.  Known sections of one report are gathered into a row."""
    book = known.agg(F.array_sort(F.collect_list(F.struct("place", F.upper("name").alias("up"), plain_name(F.col("name")).alias("plain"), "name"))).alias("book"))
    long = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.char_length(w) > 2))
    d = wanted.select("target", F.upper(F.trim("target")).alias("up"), plain_name(F.col("target")).alias("plain")).crossJoin(F.broadcast(book))
    within = lambda a, b: F.contains(a, b) | F.contains(b, a)
    first = F.get(F.filter("book", lambda k: within(k["up"], F.col("up"))), F.lit(0))["name"]
    second = F.get(F.filter("book", lambda k: within(k["plain"], F.col("plain"))), F.lit(0))["name"]
    own = long(F.col("plain"))
    shared = lambda k: F.size(F.array_intersect(own, long(k["plain"])))
    graded = F.transform(F.filter("book", lambda k: shared(k) >= 2), lambda k: F.struct(shared(k).alias("g"), (-k["place"]).alias("p"), k["name"].alias("name")))
    third = bound(F.array_max(graded), lambda g: F.when(g["g"] * 2 >= F.size(own), g["name"]))
    return d.select("target", F.coalesce(first, second, third).alias("section"))

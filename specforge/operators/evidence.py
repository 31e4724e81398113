"""Evidence checks A to J: findings of a specification, from one row per document.

A document is a row (its text, its lines, its sections in order); every check is an expression over that row, so nothing is
exchanged after documents have been put together.  Patterns of the rules search the text as the rules were written: those over lower-cased text
keep their upper-case alternatives, which then never match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions.text import bound, strip
from specforge.operators import rules, scoring
from specforge.operators.lines import declaration_islands, detected_sections

CHECKS = (
    "A_SECTION_COVERAGE", "B_SECTION_ORDER", "C_PLACEHOLDER_RESIDUE", "D_REQUIREMENT_FORMAT", "E_REQUIREMENT_LANGUAGE", "F_REQUIREMENT_IDS",
    "G_TRACEABILITY", "H_WRITING_GUIDE_RULES", "I_EXTENDED_WG_RULES", "J_STANDARDS_CONSISTENCY",
)
#: Lines that look like headings and are title lines.
META = ("requirements document", "of the alarm siren unit", "module")
#: Parts of a document that rules look into: by a word of their heading.
PARTS = {
    "diversity_part": "DIVERSITY", "reference_part": "REFERENCE DOCUMENTS", "applicable_part": "APPLICABLE DOCUMENTS", "standards_part": "STANDARDS",
    "environment_part": "ENVIRONMENT", "constraint_part": "CONSTRAINT REQUIREMENTS", "design_part": "DESIGN AND MANUFACTURING",
}
#: Sections whose presence rules ask for.
ASKED = {
    "scope": "SCOPE", "acronyms": "ACRONYMS", "system_diversity": "SYSTEM DIVERSITY", "diversity": "DIVERSITY", "functional": "FUNCTIONAL REQUIREMENTS",
    "mission_profile": "MISSION PROFILE", "operational": "OPERATIONAL REQUIREMENTS", "reference": "REFERENCE DOCUMENTS", "applicable": "APPLICABLE DOCUMENTS",
    "rams": "RAMS REQUIREMENTS", "network": "NETWORK INTERFACES", "electrical": "ELECTRICAL INTERFACES", "environment": "ENVIRONMENT CONDITIONS",
    "external": "EXTERNAL INTERFACES", "performance": "PERFORMANCE REQUIREMENTS", "requirements": "REQUIREMENTS",
}
# Patterns of the writing-guide rules, by what they search ("text" in any case, "exact" in its own case, "low" lower-cased, or a part).
SEARCHED = {
    "revision": ("text", r"table\s+of\s+updates|revision\s+history|update\s+history|version\s+history"),
    "title_id": ("text", r"RSP-\d+|REQUIREMENTS DOCUMENT|TECHNICAL SPECIFICATION|CTS|Specification\s+of\s+the"),
    "writer": ("text", r"written\s+by|writter|author|checked\s+by|approved\s+by|writer"),
    "diagrams": ("text", r"figure\s+<?\d+|diagram|use\s+case|state\s+chart|sequence\s+diagram"),
    "acronym_defs": ("exact", r"[A-Z]{2,}\s*[:\-—]\s*[A-Z][a-z]"),
    "numbered": ("text", r"figure\s+<?\d+|picture\s+\d+|table\s+\d+"),
    "coloured": ("low", r"\b(?:in\s+red|in\s+blue|in\s+green|red\s+text|blue\s+text|colored\s+in)\b"),
    "generic_spec": ("low", r"\bgeneric\s+(specification|RD|document|spec)\b"),
    "unspecified": ("low", r"\b(?:TBD|to\s+be\s+defined|to\s+be\s+specified|per\s+project|per\s+application)\b"),
    "all_projects": ("low", r"\ball\s+projects\b"),
    "generic": ("low", r"\bgeneric\b"),
    "written_by": ("low", r"written\s+by|writter"),
    "checked_by": ("low", r"checked\s+by|auditor|verifier"),
    "variants": ("diversity_part", r"(?i)\||\bvariant\b|\bcharacteristic\b"),
    "revision_index": ("cited", r"\b(?:rev\.?|revision|version|v\d+|index)\b"),
    "cited_documents": ("cited", r"\b\d{4,}_\d{2}_\d{4,}\b|\b[A-Z]{2,}\d{3,}\b|\bSTA\d+\b"),
    "design_file": ("reference_part", r"(?i)\b(?:design\s+file|DC\b|upstream\s+(?:functional\s+)?requirements?|architecture\s+(?:constraints?|file))\b"),
    "figure_refs": ("low", r"(?:see|refer\s+to|per|according\s+to)\s+(?:figure|table|diagram)\s+\d+"),
    "figures": ("low", r"figure\s+<?\d+|table\s+\d+"),
    "state_machine": ("low", r"\b(?:state\s+(?:machine|chart|transition|diagram)|state\s+chart|statemachine|mode\s+diagram)\b"),
    "mission": ("low", r"\bmission\s+profile\b"),
    "noise": ("low", r"\b(?:random\s+noise|bruit\s+(?:aléatoire|parasite)|noise\s+(?:level|requirement|target))\b"),
    "regulatory": ("low", r"\b(?:regulation|regulatory|réglementation|ECER|FMVSS|ISTA|ISO\s*\d+)\b"),
    "process_shall": ("low", r"\b(?:assembly\s+process|packaging\s+process|manufacturing\s+process|development\s+process)\b.*\bshall\b"),
    "internal_analysis": ("low", r"\binternal\s+functional\s+analysis\b"),
    "preconditions": ("low", r"\b(?:if|when|while|during|in\s+case\s+of|upon|precondition|mode)\b.*\bshall\b"),
    "dependability": ("low", r"\b(?:SdF|sûreté\s+de\s+fonctionnement|dependability|safety|reliability|RAMS|ASIL|FTA|FMEA)\b"),
    "network_words": ("low", r"\b(?:CAN|LIN|network\s+interface)\b"),
    "context_diagram": ("low", r"context(?:ual)?\s+diagram"),
    "electrical_words": ("low", r"\b(?:electric(?:al)?|power\s+supply|voltage|current)\b"),
    "electrical_diagram": ("low", r"(?:electric|wiring|power)\s+(?:interface\s+)?diagram|schematic"),
    "power": ("low", r"\b(?:power\s+consumption|current\s+consumption|supply\s+(?:current|voltage)|power\s+dissipation)\b.*\b(?:shall|must|≤|<=|max)\b"),
    "test_words": ("environment_part", r"(?i)\b(?:test\s+procedure|test\s+method|how\s+to\s+test|test\s+setup)\b"),
    "packaging": ("constraint_part", r"(?i)\bpackaging\s+process\b"),
    "recycling": ("constraint_part", r"(?i)\b(?:recycling|development\s+process)\b"),
    "interface_words": ("design_part", r"(?i)\b(?:interface\s+(?:requirement|constraint)|network\s+interface|electrical\s+interface|mechanical\s+interface)\b"),
    "network_shall": ("low", r"\b(?:CAN|LIN|network\s+(?:frame|message|signal|protocol))\b.*\bshall\b"),
    "io_list": ("low", r"\b(?:list\s+of\s+I/O|input\s+/output|I/O\s+list|semantic\s+I/O|physical\s+I/O)\b"),
    "participants": ("low", r"\b(?:participants|secondary\s+(?:writer|editor)|co-?writ(?:er|ten|ed))\b"),
    "simulink": ("low", r"\bSIMULINK\b"),
}
LITERAL = r"\b0[bB][01]+\b|\b0[xX][0-9A-Fa-f]+\b"
ENGLISH = r"\b(the|shall|must|requirement|system|component|document)\b"
FRENCH = r"\b(le|la|les|doit|exigence|système|composant|document)\b"
MARK = r"(?i)\[(STA\d{1,4}|N\d{1,3})\]"

# Rules H and I: (check, rule, section of the finding, severity, when); sec_ columns tell sections, others what was searched.
GUIDE_RULES = (
    ("H", "R09", "HISTORY", "pass", "revision"), ("H", "R09", "HISTORY", "warning", "not revision"),
    ("H", "R05", "TITLE", "pass", "title_id"), ("H", "R05", "TITLE", "warning", "not title_id"),
    ("H", "R07", "APPROVAL", "pass", "writer"), ("H", "R07", "APPROVAL", "warning", "not writer"),
    ("H", "R11", "DIAGRAMS", "info", "diagrams"),
    ("H", "R12", "SCOPE", "warning", "sec_scope and scope_shall > 0"), ("H", "R12", "SCOPE", "pass", "sec_scope and scope_shall = 0"),
    ("H", "WG_ACRONYMS", "ACRONYMS", "pass", "sec_acronyms and acronym_defs"), ("H", "WG_ACRONYMS", "ACRONYMS", "warning", "sec_acronyms and not acronym_defs"),
    ("H", "WG_FIGURES", "FIGURES", "pass", "numbered"), ("H", "WG_FIGURES", "FIGURES", "info", "not numbered"),
    ("I", "R02", "", "pass", "not coloured"), ("I", "R02", "", "warning", "coloured"),
    ("I", "R03", "", "pass", "english > french"), ("I", "R03", "", "info", "french > english * 2"),
    ("I", "R04", "", "info", "generic_spec and unspecified"),
    ("I", "R06", "PAGE FOOTERS", "warning", "all_projects and generic"), ("I", "R06", "PAGE FOOTERS", "info", "not (all_projects and generic)"),
    ("I", "R08", "APPROVAL", "pass", "written_by and checked_by"), ("I", "R08", "APPROVAL", "info", "not (written_by and checked_by)"),
    ("I", "R13", "SYSTEM DIVERSITY", "pass", "(sec_system_diversity or sec_diversity) and variants"),
    ("I", "R13", "SYSTEM DIVERSITY", "warning", "(sec_system_diversity or sec_diversity) and not variants"),
    ("I", "R14", "QUOTED DOCUMENTS", "pass", "cited_documents and revision_index"),
    ("I", "R14", "QUOTED DOCUMENTS", "warning", "cited_documents and not revision_index"), ("I", "R14", "QUOTED DOCUMENTS", "info", "not cited_documents"),
    ("I", "R15", "REFERENCE DOCUMENTS", "pass", "design_file"), ("I", "R15", "REFERENCE DOCUMENTS", "warning", "not design_file and reference_part <> ''"),
    ("I", "R21", "REQUIREMENTS", "pass", "shall > 0"),
    ("I", "R25", "REQUIREMENTS", "pass", "figures and figure_refs"), ("I", "R25", "REQUIREMENTS", "info", "figures and not figure_refs"),
    ("I", "R27", "FUNCTIONAL REQUIREMENTS", "pass", "sec_functional and state_machine"),
    ("I", "R27", "FUNCTIONAL REQUIREMENTS", "info", "sec_functional and not state_machine"),
    ("I", "R33", "REQUIREMENTS", "pass", "literal_lines = 0"), ("I", "R33", "REQUIREMENTS", "warning", "literal_lines > 0"),
    ("I", "R40", "MISSION PROFILE", "pass", "sec_mission_profile or mission"),
    ("I", "R40", "OPERATIONAL REQUIREMENTS", "warning", "not (sec_mission_profile or mission) and sec_operational"),
    ("I", "R41", "ERGONOMICS", "pass", "noise"), ("I", "R41", "ERGONOMICS", "warning", "not noise"),
    ("I", "R45", "CONSTRAINT REQUIREMENTS", "info", "regulatory"),
    ("I", "P01", "REQUIREMENTS", "pass", "not process_shall"), ("I", "P01", "REQUIREMENTS", "warning", "process_shall"),
    ("I", "P02", "FUNCTIONAL REQUIREMENTS", "pass", "not internal_analysis"),
    ("I", "P04", "REQUIREMENTS", "pass", "preconditions"), ("I", "P04", "REQUIREMENTS", "info", "not preconditions"),
    ("I", "P08", "QUOTED DOCUMENTS", "pass", "sec_reference and sec_applicable"),
    ("I", "P08", "QUOTED DOCUMENTS", "warning", "(sec_reference or sec_applicable) and not (sec_reference and sec_applicable)"),
    ("I", "P09", "SYSTEM DIVERSITY", "pass", "sec_system_diversity or sec_diversity"),
    ("I", "P10", "RAMS REQUIREMENTS", "pass", "dependability"), ("I", "P10", "RAMS REQUIREMENTS", "warning", "not dependability and sec_rams"),
    ("I", "R31", "NETWORK INTERFACES", "pass", "(sec_network or network_words) and context_diagram"),
    ("I", "R31", "NETWORK INTERFACES", "info", "not ((sec_network or network_words) and context_diagram)"),
    ("I", "R36", "ELECTRICAL INTERFACES", "pass", "(sec_electrical or electrical_words) and electrical_diagram"),
    ("I", "R37", "ELECTRICAL INTERFACES", "pass", "power"), ("I", "R37", "ELECTRICAL INTERFACES", "info", "not power and (sec_electrical or electrical_words)"),
    ("I", "R51", "ENVIRONMENT CONDITIONS", "pass", "sec_environment and not test_words"), ("I", "R51", "ENVIRONMENT CONDITIONS", "warning", "sec_environment and test_words"),
    ("I", "R49", "CONSTRAINT REQUIREMENTS", "info", "constraint_part = ''"), ("I", "R49", "CONSTRAINT REQUIREMENTS", "warning", "constraint_part <> '' and packaging"),
    ("I", "R49", "CONSTRAINT REQUIREMENTS", "pass", "constraint_part <> '' and not packaging"),
    ("I", "R50", "CONSTRAINT REQUIREMENTS", "info", "constraint_part = ''"), ("I", "R50", "CONSTRAINT REQUIREMENTS", "warning", "constraint_part <> '' and recycling"),
    ("I", "R50", "CONSTRAINT REQUIREMENTS", "pass", "constraint_part <> '' and not recycling"),
    ("I", "R46", "DESIGN AND MANUFACTURING", "pass", "design_part <> '' and not interface_words"), ("I", "R46", "DESIGN AND MANUFACTURING", "warning", "design_part <> '' and interface_words"),
    ("I", "R19", "REQUIREMENTS", "pass", "sec_functional and (sec_external or sec_network)"),
    ("I", "R30", "PERFORMANCE REQUIREMENTS", "pass", "sec_performance"), ("I", "R30", "REQUIREMENTS", "warning", "not sec_performance and sec_requirements"),
    ("I", "R52", "NETWORK INTERFACES", "pass", "(sec_network or network_words) and network_shall"),
    ("I", "R52", "NETWORK INTERFACES", "warning", "(sec_network or network_words) and not network_shall"), ("I", "R52", "NETWORK INTERFACES", "info", "not (sec_network or network_words)"),
    ("I", "R53", "FUNCTIONAL REQUIREMENTS", "pass", "io_list"), ("I", "R53", "FUNCTIONAL REQUIREMENTS", "info", "not io_list"),
    ("I", "R10", "PARTICIPANTS", "pass", "participants"), ("I", "R10", "PARTICIPANTS", "info", "not participants"),
    ("I", "R01", "", "pass", "true"),
    ("I", "R24", "REQUIREMENTS", "pass", "not simulink"), ("I", "R24", "REQUIREMENTS", "info", "simulink"),
)


# ---------------------------------------------------------------- documents
def documents(lines: DataFrame) -> DataFrame:
    """One row per document: text, low, rows, heads (line_no, section in order), names, declared and other text, and the parts."""
    l = declaration_islands(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line", "declared"))).alias("l"))
    heads = detected_sections(lines).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "section"))).alias("heads"))
    d = l.join(heads, "doc_id", "left")
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["line"]), "\n")
    d = d.select(
        "doc_id", joined(F.col("l")).alias("text"), F.transform("l", lambda x: x["line"]).alias("rows"),
        F.coalesce("heads", F.array().cast("array<struct<line_no:int,section:string>>") if dict(lines.dtypes)["line_no"] == "int" else F.array().cast("array<struct<line_no:bigint,section:string>>")).alias("heads"),
        joined(F.filter("l", lambda x: x["declared"])).alias("declared"), joined(F.filter("l", lambda x: ~x["declared"])).alias("body"),
    )
    d = d.withColumns({"low": F.lower("text"), "names": F.transform("heads", lambda h: h["section"])})
    return d.withColumns({name: part(word) for name, word in PARTS.items()})


def between(begin: Column, end: Column) -> Column:
    """Text of the rows from begin (0-based) to before end."""
    return F.array_join(F.slice("rows", (begin + 1).cast("int"), (end - begin).cast("int")), "\n")


def run_of(flags: Column, last: bool) -> Column:
    """Text from the first (or last) head of the first run of heads that `flags` marks to the next head behind it; '' without one."""
    heads, size = F.col("heads"), F.size("heads")

    def cut(f: Column) -> Column:
        first = F.array_position(f, True).cast("int")
        stop = F.array_position(F.slice(f, F.greatest(first, F.lit(1)), F.greatest(F.size(f), F.lit(1))), False).cast("int")
        behind = F.when(stop > 0, first + stop - 1).otherwise(size + 1)  # place of the head behind the run
        begin = F.get(heads, (behind - 2) if last else (first - 1))["line_no"]
        end = F.coalesce(F.get(heads, behind - 1)["line_no"], F.size("rows"))
        return F.when(first > 0, between(begin, end)).otherwise("")

    return bound(flags, cut)


def part(word: str) -> Column:
    return run_of(F.transform("heads", lambda h: F.contains(F.lower(h["section"]), F.lit(word.lower()))), last=True)


def words(c: Column) -> Column:
    return F.array_distinct(F.split(F.lower(strip(c)), r"\s+"))


def fits(required: str, name: Column) -> Column:
    """A section name meets a required one: the same name, a little more than a short one, or 60 % of the words of a long one."""
    want = sorted(set(required.lower().split()))
    low, own = F.lower(strip(name)), words(name)
    if len(want) <= 2:
        more = F.contains(low, F.lit(required.lower())) & (F.size(own) <= len(want) + 1)
    else:
        more = F.size(F.array_intersect(own, F.array(*[F.lit(w) for w in want]))) * 10 >= 6 * len(want)
    return (low == required.lower()) | (~low.isin(*META) & more)


def present(required: str) -> Column:
    return F.exists("names", lambda n: fits(required, n))


def met_by(required: str) -> Column:
    """The section that meets a required one, or null: the first that fits a short name; of a long name the same one, else the one that shares most words."""
    names = F.col("names")
    fitting = F.filter(names, lambda n: fits(required, n))
    want = sorted(set(required.lower().split()))
    if len(want) <= 2:
        return F.get(fitting, F.lit(0))
    same = F.filter(names, lambda n: F.lower(strip(n)) == required.lower())
    graded = F.transform(fitting, lambda n, i: F.struct(F.size(F.array_intersect(words(n), F.array(*[F.lit(w) for w in want]))).alias("g"), (-i).alias("i"), n.alias("n")))
    return F.coalesce(F.get(same, F.lit(0)), F.array_max(graded)["n"])


# ---------------------------------------------------------------- findings
def guide_columns(d: DataFrame) -> DataFrame:
    """documents with every column that GUIDE_RULES name."""
    cited = F.lower(F.concat("reference_part", F.lit("\n"), "applicable_part"))
    where = {"text": F.col("text"), "exact": F.col("text"), "low": F.col("low"), "cited": cited} | {p: F.col(p) for p in PARTS}
    found = {name: where[at].rlike(("(?i)" if at == "text" else "") + p) for name, (at, p) in SEARCHED.items()}
    sections = {f"sec_{name}": present(required) for name, required in ASKED.items()}
    scope = run_of(F.transform("heads", lambda h: fits("SCOPE", h["section"])), last=False)
    count = lambda c, p: F.regexp_count(c, F.lit(p))
    shall = F.filter("rows", lambda x: rules.is_shall(x))
    return d.withColumns(
        found | sections | {
            "shall": count(F.col("text"), rules.SHALL), "scope_shall": count(scope, rules.SHALL), "english": count(F.col("low"), ENGLISH), "french": count(F.col("low"), FRENCH),
            "literal_lines": F.size(F.filter(shall, lambda x: x.rlike(LITERAL))),
        }
    )


def finding(seq: int, severity, section, rule, n) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        F.lit(seq).alias("check_seq"), F.lit(CHECKS[seq - 1]).alias("check_id"), as_column(severity).alias("severity"), as_column(section).alias("section"),
        as_column(rule).alias("rule_id"), as_column(n).cast("long").alias("n"),
    )


def guide_findings() -> Column:
    """Findings of rules H and I as one array."""
    made = [F.when(F.expr(when), finding(8 if check == "H" else 9, severity, section, rule, 1)) for check, rule, section, severity, when in GUIDE_RULES]
    return F.array_compact(F.array(*made))


def coverage(mandatory, recommended) -> Column:
    """Check A: mandatory sections pass or fail, recommended ones are missed with a warning."""

    def one(required: str) -> Column:
        return bound(met_by(required), lambda m: finding(1, F.when(m.isNull(), "error").otherwise("pass"), F.coalesce(m, F.lit(required)), "TEMPLATE", 1))

    missing = [F.when(met_by(r).isNull(), finding(1, "warning", r, "WRITING_GUIDE", 1)) for r in recommended]
    return F.array_compact(F.array(*[one(r) for r in mandatory], *missing))


def places(order) -> Column:
    """array<struct<line_no, section, place>> of the sections that a name of the standard plan is like (Jaccard 0.6): the same name, else the first best one."""
    plan = F.array(*[F.struct(F.lit(n.lower()).alias("name"), F.array(*[F.lit(w) for w in sorted(set(n.lower().split()))]).alias("words"), F.lit(k).alias("place")) for k, n in enumerate(order)])

    def best(h: Column) -> Column:
        low, own = F.lower(h["section"]), words(h["section"])
        like = lambda p: F.size(F.array_intersect(own, p["words"])) / F.size(F.array_union(own, p["words"]))
        graded = F.transform(plan, lambda p: F.struct((p["name"] == low).alias("same"), like(p).alias("like"), (-p["place"]).alias("back")))
        return bound(F.array_max(graded), lambda g: F.struct(h["line_no"].alias("line_no"), h["section"].alias("section"), F.when(g["same"] | (g["like"] >= 0.6), -g["back"]).alias("place")))

    seen = F.filter("heads", lambda h: ~F.lower(h["section"]).isin(*META))
    return F.filter(F.transform(seen, best), lambda x: x["place"].isNotNull())


def disordered(order, slack: int = 3) -> Column:
    """Of these places, those that come `slack` or more after a later one."""
    start = F.struct(F.lit(-1).alias("top"), F.array().cast("array<struct<line_no:bigint,section:string,place:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        late = F.struct(x["line_no"].cast("long").alias("line_no"), x["section"].alias("section"), x["place"].alias("place"))
        out = F.when(a["top"] - x["place"] >= slack, F.concat(a["out"], F.array(late))).otherwise(a["out"])
        return F.struct(F.greatest(a["top"], x["place"]).alias("top"), out.alias("out"))

    return F.aggregate(places(order), start, step, lambda a: a["out"])


def order_findings(order) -> Column:
    late = disordered(order)
    warned = F.transform(F.slice(late, 1, 5), lambda x: finding(2, "warning", x["section"], "P06", 1))
    return F.when(F.size(late) > 0, warned).otherwise(F.array(finding(2, "pass", "", "P06", 1)))


def residue_findings(instructions: Column | None) -> Column:
    """Check C: a warning for every kind of leftover with its count, else a pass."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    kinds = [count(rules.PLACEHOLDER), count(rules.VARIABLE), count(rules.TBD)]
    if instructions is not None:
        plain = F.lower(F.regexp_replace(F.regexp_replace("text", rules.PLACEHOLDER, " "), r"\s+", " "))
        kinds.append(F.size(F.filter(instructions, lambda i: F.contains(plain, i))))
    warned = F.array_compact(F.array(*[F.when(n > 0, finding(3, "warning", "", "TEMPLATE", n)) for n in kinds]))
    return bound(warned, lambda w: F.when(F.size(w) > 0, w).otherwise(F.array(finding(3, "pass", "", "TEMPLATE", 0))))


def requirement_findings() -> Column:
    """Checks D to G over the document's lines."""
    rows = F.col("rows")
    sentences = F.filter(rows, rules.is_shall)
    n_sentences = F.size(sentences)
    tabled = F.size(F.filter(rows, lambda x: F.regexp_count(x, F.lit(r"\|")) >= 2))
    count = lambda p: F.regexp_count("text", F.lit(p))
    subjective = F.size(F.filter(rows, lambda x: x.rlike(rules.SHALL) & x.rlike(rules.SUBJECTIVE)))
    should, may = count(r"(?i)\bshould\b"), count(r"(?i)\bmay\b")
    ids = F.size(F.array_distinct(F.flatten(F.transform(rows, lambda x: F.regexp_extract_all(x, F.lit(f"({rules.REQUIREMENT_ID})"), F.lit(1))))))
    around = lambda i: F.array_join(F.slice(rows, F.greatest(i - 9, F.lit(1)), F.least(i, F.lit(10)) + 11), " ")  # noqa: E731  i counts from 0
    placed = F.filter(F.transform(rows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: rules.is_shall(s["x"]))
    with_id = F.size(F.filter(placed, lambda s: around(s["i"]).rlike(rules.REQUIREMENT_ID)))
    inline = F.size(F.filter(sentences, rules.is_traced))
    near = F.size(F.filter(placed, lambda s: rules.is_traced(around(s["i"]))))
    made = [
        F.when(n_sentences > 0, finding(4, F.when(tabled > 10, "pass").otherwise("warning"), "REQUIREMENTS", "R22", tabled)),
        finding(5, F.when(F.col("shall") > 0, "pass").otherwise("error"), "REQUIREMENTS", "R23", F.col("shall")),
        F.when((F.col("shall") > 0) & (subjective > 0), finding(5, "warning", "REQUIREMENTS", "R23", subjective)),
        F.when((F.col("shall") == 0) & ((should > 5) | (may > 5)), finding(5, "warning", "REQUIREMENTS", "R23", should + may)),
        F.when((n_sentences > 0) & (ids > 0), finding(6, "pass", "REQUIREMENTS", "R20", ids)),
        F.when((n_sentences > 0) & (ids == 0) & (with_id == 0), finding(6, "warning", "REQUIREMENTS", "R20", 0)),
        F.when(n_sentences > 0, bound(F.when(inline > 0, inline).otherwise(near), lambda t: finding(7, F.when(t * 2 >= n_sentences, "pass").otherwise("warning"), "REQUIREMENTS", "R22", t))),
    ]
    return F.array_compact(F.array(*made))


def marks(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(MARK), F.lit(1)), F.upper)))


def standards_findings() -> Column:
    """Check J: standards that are declared and not used, or used and not declared; a note without any, a pass without a problem.

    Declared is what stands in a declaration table or under a heading of applicable documents or standards; if such a part lies
    wholly outside the tables, it isn't body text either.
    """
    applicable, standards = F.col("applicable_part"), F.col("standards_part")
    without = lambda body, p: F.when(p != "", F.replace(body, p, F.lit(""))).otherwise(body)
    declared = marks(F.concat_ws("\n", "declared", applicable, standards))
    used = marks(without(without(F.col("body"), applicable), standards))

    def told(d: Column, u: Column) -> Column:
        unused = F.transform(F.array_except(d, u), lambda s: finding(10, "warning", "APPLICABLE DOCUMENTS", F.concat(F.lit("R17:"), s), 1))
        undeclared = F.transform(F.array_except(u, d), lambda s: finding(10, "warning", "REQUIREMENTS", F.concat(F.lit("R17:"), s), 1))
        every = F.concat(unused, undeclared)
        quiet = F.when((F.size(d) == 0) & (F.size(u) == 0), F.array(finding(10, "info", "APPLICABLE DOCUMENTS", "R17", 0)))
        return F.coalesce(quiet, F.when(F.size(every) > 0, every).otherwise(F.array(finding(10, "pass", "APPLICABLE DOCUMENTS", "R17", F.size(d)))))

    return bound(F.struct(declared.alias("d"), used.alias("u")), lambda s: told(s["d"], s["u"]))


def findings(lines: DataFrame, mandatory=lexicon.MANDATORY_SECTIONS, recommended=lexicon.RECOMMENDED_SECTIONS, instructions: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, check_seq, check_id, severity, section, rule_id, n) of all ten checks; rule_id of a standard's finding ends in its mark.

    instructions: normalised sentences of the template (40 characters or more) that should have been deleted.
    """
    d = guide_columns(documents(lines))
    left = F.array(*[F.lit(i) for i in instructions]) if instructions else None
    order = [order_findings(mandatory)] if len(mandatory) > 1 else []
    every = F.concat(coverage(mandatory, recommended), *order, residue_findings(left), requirement_findings(), guide_findings(), standards_findings())
    return d.select("doc_id", F.explode(every).alias("f")).select("doc_id", "f.*")


# ---------------------------------------------------------------- scores
def summary(found: DataFrame, known_rules: tuple[str, ...] = ()) -> DataFrame:
    """Per document: findings by severity, the rules that were checked, and the known ones that weren't."""
    level = lambda s: F.count_if(F.col("severity") == s)
    rule = F.regexp_extract("rule_id", r"^([RP]\d+)", 1)
    d = found.groupBy("doc_id").agg(level("error").alias("errors"), level("warning").alias("warnings"), level("info").alias("infos"), level("pass").alias("passes"), F.collect_set(F.when(rule != "", rule)).alias("seen"))
    unchecked = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in known_rules]).cast("array<string>"), F.col("seen")))
    return d.select("doc_id", "errors", "warnings", "infos", "passes", F.size("seen").alias("rules_checked"), F.array_join(unchecked, ",").alias("unchecked"))


def scores(found: DataFrame, mandatory: int = len(lexicon.MANDATORY_SECTIONS)) -> DataFrame:
    """Per document the five axes (two decimals), the weighted score and the verdict, from findings in one pass."""
    n = lambda test, level: F.count_if(test & (F.col("severity") == level))
    check, rule = F.col("check_seq"), F.col("rule_id")
    own, guide = check.between(4, 7), check.isin(8, 9, 10) | ((check == 1) & (rule == "WRITING_GUIDE"))
    d = found.groupBy("doc_id").agg(
        n(check == 1, "error").alias("missing"), n(check == 2, "warning").alias("late"), F.count_if(check == 2).alias("ordered"),
        F.sum(F.when((check == 3) & (F.col("severity") == "warning"), F.col("n")).otherwise(0)).alias("residue"),
        n(own, "pass").alias("rp"), n(own, "warning").alias("rw"), n(own, "error").alias("re"),
        n(guide, "pass").alias("gp"), n(guide, "info").alias("gi"), n(guide, "warning").alias("gw"), F.count_if(F.col("severity") == "error").alias("errors"),
    )
    axes = {
        "structure": scoring.structure_curve((mandatory - F.col("missing")) / mandatory), "section_order": scoring.order_v2(F.col("late"), F.col("ordered")),
        "cleanliness": scoring.cleanliness(F.col("residue")), "requirements": scoring.requirements_v2(F.col("rp"), F.col("rw"), F.col("re")),
        "writing_guide": scoring.guide_v2(F.col("gp"), F.col("gi"), F.col("gw"), F.col("gp") + F.col("gi") + F.col("gw")),
    }
    d = d.select("doc_id", "errors", *[scoring.two_decimals(c).alias(a) for a, c in axes.items()])
    overall = sum((F.col(a) * w for a, w in zip(axes, scoring.WEIGHTS_V2, strict=True)), F.lit(0.0))
    return d.withColumn("overall", overall).withColumn("verdict", scoring.verdict(F.col("overall"), F.col("errors"))).withColumn("overall", scoring.two_decimals(F.col("overall")))

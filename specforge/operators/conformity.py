"""Conformity matrices: status classification, items, comments, comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions.text import any_of, bound, normalize, strip

CATEGORIES = ("OK", "NOK", "NA", "EMPTY")


def classify(value: Column) -> Column:
    """OK, NOK, NA or EMPTY of a raw status; negative wording is looked at first, domain and version codes stay EMPTY."""

    def kind(n: Column) -> Column:
        denied = n.contains("nok") | n.contains("not ok") | n.contains("not conform")
        return (
            F.when(n == "", "EMPTY")
            .when(n.isin(*lexicon.NOK_VALUES) | n.startswith("nok"), "NOK")
            .when(n.rlike(r"\b(ok|okay)\b") & ~denied, "OK")
            .when(n.rlike(r":\s*ok") & ~n.contains("nok"), "OK")
            .when(n.isin(*lexicon.OK_VALUES), "OK")
            .when(n.isin(*lexicon.NA_VALUES) | n.startswith("not applicable") | n.startswith("non applic"), "NA")
            .otherwise("EMPTY")
        )

    return bound(strip(normalize(value)), kind)


def items(matrix: DataFrame) -> DataFrame:
    """Rows with their category, review flag and confidence: an EMPTY status with a comment needs a look."""
    d = matrix.withColumn("category", classify(F.col("conformity_raw")))
    d = d.withColumn("needs_review", (F.col("category") == "EMPTY") & (strip(F.coalesce("comment", F.lit(""))) != ""))
    return d.withColumn("classification_confidence", F.when(F.col("needs_review"), "medium").otherwise("high"))


def status_summary(found: DataFrame) -> DataFrame:
    """category, n and pct of the whole; two aggregates, no row of the input is moved."""
    counts = found.groupBy("category").agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(whole)).select("category", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def overview(found: DataFrame, by: str = "file_name") -> DataFrame:
    n = lambda c: F.count_if(F.col("category") == c)
    return found.groupBy(by).agg(
        F.count("*").alias("total"), n("OK").alias("ok"), n("NOK").alias("nok"), n("NA").alias("na"), n("EMPTY").alias("empty"), F.count_if("needs_review").alias("needs_review")
    )


def status_rollup(found: DataFrame) -> DataFrame:
    """Extension: totals by file and category at every level."""
    return found.rollup("file_name", "category").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


# ---------------------------------------------------------------- several status columns
def chosen_status(statuses: list[Column], verdict: Column) -> Column:
    """Status of a row with several columns: a NOK verdict, the first value that isn't an assessment, the worst
    assessment (NOK, then NA, EMPTY, OK), an OK verdict.  Every cell is classified once."""
    graded = lambda s: bound(classify(s), lambda c: F.struct(rank(c).alias("rank"), c.alias("category")))
    filled = F.filter(F.transform(F.array(*statuses[1:]), strip), lambda s: s != "")
    worst = F.reduce(F.transform(filled, graded), F.struct(F.lit(-9).alias("rank"), F.lit("EMPTY").alias("category")), lambda a, x: F.when(x["rank"] > a["rank"], x).otherwise(a))
    other = F.when(strip(statuses[0]) != "", classify(statuses[0])).otherwise(worst["category"])

    def decided(v: Column) -> Column:
        return F.when(v == "NOK", "NOK").otherwise(bound(other, lambda o: F.when((o == "EMPTY") & (v == "OK"), "OK").otherwise(o)))

    return bound(classify(verdict), decided)


def rank(category: Column) -> Column:
    return F.when(category == "NOK", 6).when(category == "NA", 1).when(category == "EMPTY", 0).otherwise(-1)


def two_column_status(ok: Column, nok: Column, na: Column) -> Column:
    """Matrices with an OK and a NOK column: NA over NOK over OK."""
    marked = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return F.when(marked(na), "NA").when(marked(nok), "NOK").when(marked(ok), "OK").otherwise("EMPTY")


def version_of(applicable: Column, version: Column, comment: Column) -> Column:
    """Applicable version, else document version, else a comment that is one (a to i, or v and digits)."""
    kept = lambda c: F.when(strip(F.coalesce(c, F.lit(""))) != "", strip(c))
    like = F.when(strip(F.lower(comment)).rlike(r"^([a-i]|v\d+)$"), strip(comment))
    return F.coalesce(kept(applicable), kept(version), like, F.lit(""))


def merged_comment(comments: list[Column], version: Column) -> Column:
    """Distinct comments in order, without those that repeat the version, joined by ' | '."""
    kept = F.filter(F.transform(F.array(*comments), strip), lambda c: (c != "") & (c != version))
    return F.array_join(F.array_distinct(kept), " | ")


def assessment_columns(cells: DataFrame) -> DataFrame:
    """Of cells (col, value): share of filled cells that look like ok; an assessment column has over a tenth."""
    filled = cells.where(strip(F.col("value")) != "")
    ok = F.count_if(normalize(F.col("value")).rlike(r"\bok(ay)?\b"))
    stats = filled.groupBy("col").agg(F.count("*").alias("filled"), ok.alias("ok_like"))
    return stats.withColumn("is_assessment", F.col("ok_like") * 10 > F.col("filled"))


def reclassified_columns(cells: DataFrame, first_rows: int = 100) -> DataFrame:
    """Of the first rows' cells (row_index, col, value): columns that hold versions, or domain codes and hardly a status."""
    n = normalize(F.col("value"))
    filled = cells.where((F.col("row_index") < first_rows) & (n != ""))
    domain = F.forall(F.filter(F.transform(F.split(n, "/"), lambda c: F.trim(c)), lambda p: p != ""), lambda p: p.isin(*lexicon.DOMAIN_CODES))
    stats = filled.groupBy("col").agg(
        F.count("*").alias("filled"),
        F.count_if(n.rlike(r"^([a-i]|v\d+)$")).alias("version_like"),
        F.count_if(domain).alias("domain_like"),
        F.count_if(classify(F.col("value")) != "EMPTY").alias("status_like"),
    )
    role = (
        F.when(F.col("filled") <= 5, "keep")
        .when(F.col("version_like") * 10 > F.col("filled") * 6, "version")
        .when((F.col("domain_like") * 10 > F.col("filled") * 5) & (F.col("status_like") * 10 < F.col("filled")), "comment")
        .otherwise("keep")
    )
    return stats.withColumn("role", role)


# ---------------------------------------------------------------- header roles
ROLES = {
    "conformity": lexicon.STATUS_HEADERS, "comment": lexicon.COMMENT_HEADERS, "verdict": lexicon.VERDICT_HEADERS,
    "version_applicable": lexicon.APPLICABLE_HEADERS, "version": lexicon.VERSION_HEADERS, "req_id": lexicon.REQUIREMENT_HEADERS,
}


def header_rows(rows: DataFrame, first_rows: int = 50) -> DataFrame:
    """file_name, sheet_idx, header_row: the first row with a status and a comment header, else the first with one of them."""
    has = lambda role: F.exists("cells", lambda c: any_of(normalize(c), ROLES[role]))
    score = has("conformity").cast("int") + has("comment").cast("int")
    found = rows.where(F.col("row_index") < first_rows).withColumn("score", score).where("score > 0")
    best = F.min_by("row_index", F.struct(-F.col("score"), F.col("row_index")))
    return found.groupBy("file_name", "sheet_idx").agg(best.alias("header_row"), F.max("score").alias("score"))


def column_roles(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """file_name, sheet_idx, role, cols: columns by the role that their header names."""
    at = rows.join(headers, ["file_name", "sheet_idx"]).where(F.col("row_index") == F.col("header_row"))
    cells = at.select("file_name", "sheet_idx", F.posexplode("cells").alias("col", "header"))
    n = normalize(F.col("header"))
    named = {role: any_of(n, patterns) for role, patterns in ROLES.items()}
    named["version"] &= ~named["version_applicable"]
    named["comment"] &= ~named["version_applicable"]
    roles = F.array_compact(F.array(*[F.when(test, role) for role, test in named.items()]))
    found = cells.where(n != "").select("file_name", "sheet_idx", "col", F.explode(roles).alias("role"))
    return found.groupBy("file_name", "sheet_idx", "role").agg(F.sort_array(F.collect_list("col")).alias("cols"))


def chosen_sheets(scored: DataFrame) -> DataFrame:
    """The first sheet of a file with both headers, else the first with a status header."""
    order = Window.partitionBy("file_name").orderBy(F.desc("score"), "sheet_idx")
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


# ---------------------------------------------------------------- signals
SIGNALS = "array<struct<label:string,weight:int,matched:string>>"


def signals(comment: Column, table: tuple) -> Column:
    """array<struct<label, weight, matched>>: first match of each pattern that is found in the normalised comment."""
    return bound(normalize(comment), lambda n: signals_in(n, table))


def signals_in(n: Column, table: tuple) -> Column:
    """Signals of a comment that is normalised already; a pattern's match is taken out only where it is found."""
    found = [F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.when(n.rlike(pattern), F.regexp_extract(n, f"({pattern})", 1)).alias("matched")) for pattern, label, weight in table]
    hits = F.filter(F.array(*found), lambda s: s["matched"].isNotNull())
    return F.when(any_of(n, [p for p, _, _ in table]), hits.cast(SIGNALS)).otherwise(F.array().cast(SIGNALS))


def score(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda a, s: a + s["weight"])


def severity(points: Column) -> Column:
    return F.when(points >= 4, "error").when(points >= 2, "warning").otherwise("info")


DOMAIN_OK = r"^(?:(?:" + "|".join(lexicon.DOMAIN_CODES) + r")\s*:\s*ok[\s,;.]*)+$"


def is_domain_only(n: Column) -> Column:
    """Normalised comments that only assign domains, or say ok per domain."""
    parts = F.filter(F.transform(F.split(n, "/"), lambda c: F.trim(c)), lambda p: p != "")
    return bound(parts, lambda own: (F.size(own) > 0) & F.forall(own, lambda p: p.isin(*lexicon.DOMAIN_CODES))) | n.rlike(DOMAIN_OK)


def ok_suspicions(found: DataFrame) -> DataFrame:
    """Findings on OK items whose comment doubts it, worst first when ordered by (severity_rank, -score, row_index).

    A generator of one row or none: the optimiser copies no part of it into filters, so each comment is searched once.
    """

    def weighed(s: Column) -> Column:
        return bound(score(s), lambda p: F.struct(s.alias("signals"), p.alias("score"), severity(p).alias("severity"), F.when(p >= 4, 0).otherwise(1).alias("severity_rank")))

    judged = bound(normalize(F.col("comment")), lambda n: F.when((n != "") & ~is_domain_only(n), bound(signals_in(n, lexicon.SUSPICIONS), weighed)))
    return found.where("category = 'OK'").select("*", F.inline(F.filter(F.array(judged), lambda x: x["score"] >= 2)))


def inconsistencies(found: DataFrame) -> DataFrame:
    """OK items with negative comments, or without a comment and without the word ok in the raw status.

    Comments that are domain codes alone are passed over.  (Comments that say 'not applicable' are negative ones already.)
    """
    ok = found.where("category = 'OK'").withColumn("_told", strip(F.col("comment")) != "")
    ok = ok.withColumn("_looked", F.col("_told") & ~domains_only(F.col("comment")))
    ok = ok.withColumn("signals", F.when(F.col("_looked"), signals(F.col("comment"), lexicon.NEGATIVE_SIGNALS)).otherwise(F.array().cast(SIGNALS)))
    ok = ok.withColumn("score", score(F.col("signals")))
    first = F.col("column_set") == 0 if "column_set" in found.columns else F.lit(True)
    silent = ~F.col("_told") & first & ~normalize(F.col("conformity_raw")).rlike(r"\bok\b")
    kind = F.when(F.size("signals") > 0, "OK_NEGATIVE_COMMENT").when(silent, "OK_NO_COMMENT")
    return ok.withColumns({"kind": kind, "severity": F.when(F.col("score") >= 4, "error").otherwise("warning")}).where("kind is not null").drop("_told", "_looked")


# Comments that only assign domains.
_DOMAIN = "(?:sys|sw|ve|ee|me|od|opt|cg|tp|hw|mech|dq|fusa|ipm|all)"
ASSIGNED = rf"(?i)^{_DOMAIN}(?:\s*/\s*{_DOMAIN})*\s*$"


def domains_only(comment: Column) -> Column:
    return strip(comment).rlike(ASSIGNED)


#: Labels in the order in which they decide the message; one of a pair is enough.
PRIORITIES = (
    (("na_language",), "says not applicable"), (("cannot",), "says it can't be done"), (("not_responsible",), "declines responsibility"), (("rejected",), "refuses"),
    (("pending_confirmation", "in_development"), "not confirmed yet"), (("needs_action", "stla_action"), "needs action"), (("alternative_approach",), "another approach"), (("conflict",), "in conflict"),
    (("partial_limited",), "partial or limited"), (("temporary",), "temporary"), (("remaining",), "something remains"),
)


def comment_label(found: Column, points: Column) -> Column:
    """The message of a finding: by its first label that decides, else by its points."""

    def told(labels: Column) -> Column:
        out = F.when(F.lit(False), "")
        for own, text in PRIORITIES:
            out = out.when(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in own])), text)
        return out.when(points >= 3, "several signals").when(points >= 1, "minor signals").otherwise("")

    return bound(F.transform(found, lambda s: s["label"]), told)


# ---------------------------------------------------------------- comparison
def last_rows(found: DataFrame) -> DataFrame:
    """One row per requirement: the last one wins.  Combined before the exchange, so a blank id with many rows is no hot key."""
    return found.groupBy("req_id").agg(F.max_by("category", "row_index").alias("category"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer comparison of two matrices' categories; absent requirements are MISSING."""
    left, right = last_rows(a).withColumnRenamed("category", "a"), last_rows(b).withColumnRenamed("category", "b")
    joined = left.join(right, "req_id", "full_outer")
    return joined.select("req_id", F.coalesce("a", F.lit("MISSING")).alias("category_a"), F.coalesce("b", F.lit("MISSING")).alias("category_b"))


def merit(category: Column) -> Column:
    return F.when(category == "OK", 3).when(category == "NA", 2).when(category == "EMPTY", 0).when(category == "NOK", -1)


def status_changes(comparison: DataFrame) -> DataFrame:
    both = comparison.where("category_a <> 'MISSING' and category_b <> 'MISSING' and category_a <> category_b")
    return both.withColumn("improved", merit(F.col("category_b")) > merit(F.col("category_a")))


def compared_many(found: DataFrame) -> DataFrame:
    """Long form for any number of matrices (matrix, req_id, row_index, category): category and number of matrices that lack it."""
    last = found.groupBy("req_id", "matrix").agg(F.max_by("category", "row_index").alias("category"))
    n = found.select("matrix").distinct().agg(F.count("*").alias("matrices"))
    per = last.groupBy("req_id").agg(F.count("*").alias("present"), F.count_distinct("category").alias("categories"))
    return per.crossJoin(F.broadcast(n)).select("req_id", "present", "categories", (F.col("matrices") - F.col("present")).alias("missing"))

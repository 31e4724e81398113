"""The matrix path: from the rows of spreadsheets to one item per requirement row.

Header roles make one small row per file; every row of a file then meets that row, and all the rest is expressions over its cells.  Files are
many and rows are more, so the only exchanges are groupings of few sums a file and column: what a file's row holds goes through them as a key,
so that every pass over the rows is made once, and the rows stay where they are unless files are more than FEW.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions.text import any_of, bound, normalize, strip
from specforge.operators.conformity import classify, rank

# Rows that are no requirements, by their first cell; words of rows before the data.
SUMMARY = ("BLOCK", "CONVERGED", "NOT CONVERGED", "NO STELLANTIS ANSWER", "NO SUPPLIER ANSWER", "NB OF REQ. TO CONV.")
NO_ITEMS = (*SUMMARY, "STANDBY", "DEVIATION", "OK", "NOK", "NA", "ATT_RESP@FULL", "ATT_RESP@SW", "ATT_RESP@DEV", "ATT_RESP@NONE", "ATT_RESP@INT", "ATT_RESP@PTF", "ATT_RESP@DEV_INT")
ROLES = {
    "conformity": lexicon.STATUS_HEADERS, "comment": lexicon.COMMENT_HEADERS, "verdict": lexicon.VERDICT_HEADERS, "applicable": lexicon.APPLICABLE_HEADERS,
    "version": lexicon.VERSION_HEADERS, "req": lexicon.REQUIREMENT_HEADERS,
}
VERSION = r"^([a-i]$|v\d+)"
HEAD_ROWS, SAMPLE_ROWS = 50, 100
SET = "struct<raw:string,comment:string,n:string,col:int,set:int>"
#: Files whose header rows (some hundred bytes each) are sent to every executor; the rows of more files are exchanged by file.
FEW = 20_000


def cell(at: Column) -> Column:
    """A cell of a row whose cells are stripped, or ''."""
    return F.coalesce(F.get("cells", at), F.lit(""))


def first_filled(cols: Column) -> Column:
    """The first filled cell of some columns, or ''."""
    return F.coalesce(F.get(F.filter(F.transform(cols, lambda c: cell(c)), lambda v: v != ""), F.lit(0)), F.lit(""))


def header_columns(rows: DataFrame) -> DataFrame:
    """(file_name, sheet_idx, sheet_name, header_row, conformity, comment, verdict, applicable, version, req, ok, nok): of each file the sheet that
    has status and comment columns, else the first with status columns."""
    has = lambda role: F.exists("cells", lambda c: any_of(normalize(c), ROLES[role]))
    scored = rows.where(F.col("row_index") < HEAD_ROWS).withColumn("score", has("conformity").cast("int") + has("comment").cast("int")).where("score > 0")
    best = F.min_by(F.struct("row_index", "cells"), F.struct(-F.col("score"), F.col("row_index"))).alias("h")
    heads = scored.groupBy("file_name", "sheet_idx", "sheet_name").agg(best).select("file_name", "sheet_idx", "sheet_name", F.col("h.row_index").alias("header_row"), "h.cells")

    def places(test) -> Column:
        named = F.transform("cells", lambda c, i: F.struct(normalize(c).alias("n"), i.alias("i")))
        return F.transform(F.filter(named, lambda x: test(x["n"])), lambda x: x["i"])

    of = lambda role: lambda n: any_of(n, ROLES[role])
    plain = places(lambda n: ~n.isin("ok", "nok") & of("conformity")(n))
    ok, nok = places(lambda n: n == "ok"), places(lambda n: n == "nok")
    d = heads.select(
        "file_name", "sheet_idx", "sheet_name", "header_row", F.concat(plain, ok, nok).alias("conformity"), places(lambda n: of("comment")(n) & ~of("applicable")(n)).alias("comment"),
        places(of("verdict")).alias("verdict"), places(of("applicable")).alias("applicable"), places(lambda n: of("version")(n) & ~of("applicable")(n)).alias("version"), places(of("req")).alias("req"),
        ok.alias("ok"), nok.alias("nok"),
    )
    order = Window.partitionBy("file_name").orderBy((F.size("comment") > 0).cast("int").desc(), "sheet_idx")
    return d.where(F.size("conformity") > 0).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def stripped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cells", F.transform("cells", lambda c: strip(F.coalesce(c, F.lit("")))))


def chosen(rows: DataFrame, heads: DataFrame, few: bool) -> DataFrame:
    """Rows of the chosen sheets behind their header, stripped; a row a file is all that is joined."""
    d = rows.drop("sheet_name").join(F.broadcast(heads) if few else heads, ["file_name", "sheet_idx"])
    return stripped(d.where(F.col("row_index") > F.col("head.header_row")))


def data_ranges(d: DataFrame) -> DataFrame:
    """(file_name, sheet_idx, head, data_start, data_end): the first row with a value that counts, the last one with any."""
    looked = F.array_distinct(F.concat(F.array(F.lit(0)), "head.req", "head.conformity", "head.comment"))
    begins = lambda v: (v != "") & ~v.startswith("Template") & ~v.startswith("STOP") & ~F.upper(v).isin(*SUMMARY)
    filled = F.exists("cells", lambda c: c != "")
    ends = d.groupBy("file_name", "sheet_idx", "head").agg(F.min(F.when(bound(first_filled(looked), begins), F.col("row_index"))).alias("_start"), F.max(F.when(filled, F.col("row_index"))).alias("_last"))
    start = F.coalesce("_start", F.col("head.header_row") + 1)
    return ends.select("file_name", "sheet_idx", "head", start.alias("data_start"), F.greatest(start, F.coalesce("_last", start)).alias("data_end"))


def reclassified(d: DataFrame) -> DataFrame:
    """(file_name, sheet_idx, head, data_start, data_end) with columns moved by what their first rows hold: comments that are versions, statuses
    that are domains; and `assessed`, the status columns of which over a tenth says ok.  d: rows with head and data range.

    A file has a status column and a row from its start on, so none gets lost.
    """
    held = d.where(F.col("row_index") >= F.col("data_start"))
    early = F.col("row_index") < F.col("data_start") + SAMPLE_ROWS
    looked = F.array_distinct(F.concat("head.conformity", "head.comment"))
    of_file = ["file_name", "sheet_idx", "head", "data_start", "data_end"]
    cells = held.select(*of_file, early.alias("early"), F.explode(F.transform(looked, lambda c: F.struct(c.alias("col"), normalize(cell(c)).alias("n")))).alias("x"))
    n, code = F.col("x.n"), lambda values: F.col("x.n").isin(*values)
    says_ok = n.contains("ok") & ~n.contains("nok") & (n.rlike(r":\s*ok") | (n.rlike(r"\b(ok|okay)\b") & ~n.contains("not ok")))
    domain = code(lexicon.DOMAIN_CODES)
    status = ~domain & code((*lexicon.OK_VALUES, *lexicon.NOK_VALUES, *lexicon.NA_VALUES))
    filled = n != ""
    first = filled & F.col("early")
    per = cells.groupBy(*of_file, F.col("x.col").alias("col")).agg(
        F.count_if(filled).alias("filled"), F.count_if(says_ok).alias("ok"), F.count_if(first).alias("seen"), F.count_if(first & n.rlike(VERSION)).alias("versions"),
        F.count_if(first & domain).alias("domains"), F.count_if(first & status).alias("statuses"),
    )
    seen = F.col("seen") > 5
    marked = per.groupBy(*of_file).agg(
        F.collect_set(F.when(seen & (F.col("versions") * 10 > F.col("seen") * 6), F.col("col"))).alias("versioned"),
        F.collect_set(F.when(seen & (F.col("domains") * 2 > F.col("seen")) & (F.col("statuses") * 10 < F.col("seen")), F.col("col"))).alias("domained"),
        F.collect_set(F.when(F.col("ok") * 10 > F.col("filled"), F.col("col"))).alias("okayed"),
    )
    none = F.array().cast("array<int>")
    h = marked.select(*of_file, "head.*", "versioned", "domained", "okayed")
    moved = F.filter("comment", lambda c: F.array_contains("versioned", c))
    left = F.filter("comment", lambda c: ~F.array_contains("versioned", c))
    domains = F.when(F.size("conformity") > 1, F.filter("conformity", lambda c: F.array_contains("domained", c))).otherwise(none)
    h = h.withColumns({"_domains": domains, "_left": left, "_moved": F.filter(moved, lambda c: ~F.array_contains("applicable", c))})
    h = h.withColumns({"applicable": F.concat("applicable", "_moved"), "comment": F.concat("_left", F.filter("_domains", lambda c: ~F.array_contains("_left", c))), "conformity": F.filter("conformity", lambda c: ~F.array_contains("_domains", c))})
    h = h.withColumns({"assessed": F.filter("conformity", lambda c: F.array_contains("okayed", c)), "two": F.size(F.concat("ok", "nok")) > 0})
    return h.drop("head", "_domains", "_left", "_moved", "versioned", "domained", "okayed")


# ---------------------------------------------------------------- items
def verdicts(cols: Column) -> Column:
    """struct<nok, ok>: the first customer verdict that says NOK, and the first that says OK (null without)."""
    filled = F.transform(F.filter(F.transform(cols, lambda c: cell(c)), lambda v: v != ""), lambda v: F.struct(v.alias("v"), normalize(v).alias("n")))
    is_nok = lambda x: x["n"].isin(*lexicon.NOK_VALUES) | x["n"].startswith("nok")
    is_ok = lambda x: (x["n"].isin(*lexicon.OK_VALUES) | x["n"].rlike(r"\bok\b")) & ~x["n"].contains("nok") & ~x["n"].contains("not ok")
    first = lambda f, test: F.get(F.filter(f, test), F.lit(0))["v"]
    return bound(filled, lambda f: F.struct(first(f, is_nok).alias("nok"), first(f, is_ok).alias("ok")))


def sets_of() -> Column:
    """array<struct<raw, comment, n, col, set>>: status and comment columns side by side, then comments without a status column; n: the comment normalised.

    A lone comment's set is its place among what was found, which may be that of a status column.
    """
    n = F.when(F.size("comment") > 0, F.least(F.size("conformity"), F.size("comment"))).otherwise(F.size("conformity"))
    said = lambda k: F.when(k < F.size("comment"), cell(F.get("comment", k))).otherwise("")
    pair = lambda k: bound(said(k), lambda c: F.struct(cell(F.get("conformity", k)).alias("raw"), c.alias("comment"), normalize(c).alias("n"), F.get("conformity", k).alias("col"), k.alias("set")))
    every = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), pair)).otherwise(F.array().cast(f"array<{SET}>"))
    paired = F.filter(every, lambda s: (s["raw"] != "") | (s["comment"] != ""))
    lone = F.filter(F.transform(F.slice("comment", n + 1, F.greatest(F.size("comment"), F.lit(1))), lambda c: F.struct(cell(c).alias("v"), c.alias("c"))), lambda x: x["v"] != "")

    def joined(p: Column) -> Column:
        return F.concat(p, F.transform(lone, lambda x, j: F.struct(F.lit("").alias("raw"), x["v"].alias("comment"), normalize(x["v"]).alias("n"), x["c"].alias("col"), (F.size(p) + j).cast("int").alias("set"))))

    return bound(paired, joined)


def status(raw: Column, category: Column | str, at: Column | int = 0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(raw.alias("raw"), as_column(category).alias("category"), as_column(at).cast("int").alias("set"))


def standard_status(b: Column) -> Column:
    """Status of a row with its sets and verdicts: a NOK verdict, the first status that isn't an assessment, the worst assessment, an OK
    verdict; an OK verdict also rescues what is EMPTY."""
    at = lambda s: F.when(s["set"] < F.size("conformity"), F.get("conformity", s["set"]))
    assessed = lambda s: F.coalesce(F.array_contains("assessed", at(s)), F.lit(False))
    plain = F.get(F.filter(b["sets"], lambda s: at(s).isNotNull() & ~assessed(s) & (s["raw"] != "")), F.lit(0))
    graded = F.transform(F.filter(b["sets"], assessed), lambda s, i: bound(classify(s["raw"]), lambda c: F.struct(rank(c).alias("r"), (-i).alias("i"), status(s["raw"], c, s["set"]).alias("s"))))
    found = bound(plain, lambda p: F.when(p.isNotNull(), status(p["raw"], classify(p["raw"]), p["set"])).otherwise(F.coalesce(F.array_max(graded)["s"], status(F.lit(""), "EMPTY"))))
    rescued = bound(found, lambda f: F.when((f["category"] == "EMPTY") & b["verdict"]["ok"].isNotNull(), status(b["verdict"]["ok"], "OK")).otherwise(f))
    return F.when(b["verdict"]["nok"].isNotNull(), status(b["verdict"]["nok"], "NOK")).otherwise(rescued)


def two_column_status(b: Column) -> Column:
    """Status of a row with columns headed OK and NOK: NA over NOK over OK over what else stands there."""
    kinds = lambda v: F.when(v != "", classify(v))
    is_ = lambda c, k: F.coalesce(c == k, F.lit(False))

    def found(k: Column) -> Column:
        ok, nok = k["ok"], k["nok"]
        return (
            F.when(is_(ok, "NA"), status(b["ok"], "NA")).when(is_(nok, "NA"), status(b["nok"], "NA")).when(is_(nok, "NOK"), status(b["nok"], "NOK")).when(is_(ok, "OK"), status(b["ok"], "OK"))
            .when(nok.isNotNull(), status(b["nok"], nok)).when(ok.isNotNull(), status(b["ok"], ok)).otherwise(status(F.lit(""), "EMPTY"))
        )

    return bound(F.struct(kinds(b["ok"]).alias("ok"), kinds(b["nok"]).alias("nok")), found)


def item_of(req_id: Column, reference: Column, description: Column, found: Column, comment: Column, version: Column) -> Column:
    review = (found["category"] == "EMPTY") & (comment != "")
    return F.struct(
        req_id.alias("req_id"), reference.alias("reference"), description.alias("description"), found["raw"].alias("conformity_raw"), found["category"].alias("category"), comment.alias("comment"),
        version.alias("version"), found["set"].alias("column_set"), review.alias("needs_review"), F.when(review, "medium").otherwise("high").alias("classification_confidence"),
    )


def row_items() -> Column:
    """The items of one row: none, or one.  Every part is bound to a name, so it is worked out once."""
    two, none = F.col("two"), F.lit("")

    def built(b: Column) -> Column:
        lone = F.get(F.filter(b["sets"], lambda s: s["n"].rlike(VERSION)), F.lit(0))["comment"]
        return bound(F.when((b["version"] == "") & ~two, F.coalesce(lone, none)).otherwise(b["version"]), lambda v: told(b, v))

    def told(b: Column, v: Column) -> Column:
        other = bound(normalize(v), lambda n: F.filter(b["sets"], lambda s: (s["comment"] != "") & ~((v != "") & ((s["comment"] == v) | (s["n"] == n)))))
        own = F.transform(other, lambda s: s["comment"])
        every = F.filter(F.transform("comment", lambda c: cell(c)), lambda c: c != "")
        comment = F.array_join(F.when(two, every).otherwise(F.array_distinct(own)), " | ")
        return bound(F.struct(comment.alias("comment"), F.when(two, two_column_status(b)).otherwise(standard_status(b)).alias("status")), lambda x: done(b, v, x))

    def done(b: Column, v: Column, x: Column) -> Column:
        described = F.when(cell(F.lit(5)) != "", cell(F.lit(5))).when(two, cell(F.lit(3))).otherwise("")
        item = item_of(b["req_id"], cell(F.lit(1)), F.substring(described, 1, 200), x["status"], x["comment"], v)
        return F.when(two & (x["status"]["raw"] == "") & (x["comment"] == ""), F.slice(F.array(item), 1, 0)).otherwise(F.array(item))

    def told_apart(b: Column) -> Column:
        no_item = F.upper(b["req_id"]).isin(*NO_ITEMS) | b["req_id"].startswith("Template") | b["req_id"].startswith("STOP")
        return F.when(~no_item & (b["req_id"].startswith("REQ-") | (first_filled(F.concat("conformity", "verdict", "comment")) != "")), built(b))

    named = bound(first_filled(F.col("req")), lambda n: F.when(n != "", n).otherwise(cell(F.lit(0))))
    from_sheet = bound(first_filled(F.col("applicable")), lambda n: F.when(n != "", n).otherwise(first_filled(F.col("version"))))
    base = F.struct(named.alias("req_id"), from_sheet.alias("version"), sets_of().alias("sets"), verdicts(F.col("verdict")).alias("verdict"), first_filled(F.col("ok")).alias("ok"), first_filled(F.col("nok")).alias("nok"))
    blank = ~F.exists("cells", lambda c: c != "")
    return F.when(blank, F.array(item_of(none, none, none, status(none, "EMPTY"), none, none))).otherwise(bound(base, told_apart))


def items(rows: DataFrame) -> DataFrame:
    """(file_name, sheet_name, row_index, req_id, reference, description, conformity_raw, category, comment, version, column_set, needs_review, classification_confidence).

    Rows (file_name, sheet_idx, sheet_name, row_index, cells) of spreadsheets; blank rows among the data count as EMPTY items.
    """
    headers = header_columns(rows)
    few = headers.count() <= FEW
    ranges = data_ranges(chosen(rows, headers.select("file_name", "sheet_idx", F.struct(*headers.columns[2:]).alias("head")), few))
    final = reclassified(chosen(rows, ranges, few))
    d = rows.drop("sheet_name").join(F.broadcast(final) if few else final, ["file_name", "sheet_idx"])
    d = stripped(d.where(F.col("row_index").between(F.col("data_start"), F.col("data_end"))))
    return d.select("file_name", "sheet_name", "row_index", F.inline(row_items()))


# ---------------------------------------------------------------- report tables
COLOURS = {"OK": "#28a745", "NOK": "#dc3545", "NA": "#6c757d", "EMPTY": "#e9ecef"}


def status_table(found: DataFrame) -> DataFrame:
    """(file_name, place, status, n, percentage, colour) of each file, in the order OK, NOK, NA, EMPTY; percentages have two decimals."""
    counts = found.groupBy("file_name", F.col("category").alias("status")).agg(F.count("*").alias("n"))
    total = found.groupBy("file_name").agg(F.count("*").alias("_all"))
    names = F.array(*[F.lit(c) for c in COLOURS])
    colour = F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), F.col("status"))
    pct = F.floor(F.col("n") * 10000 / F.col("_all") + 0.5) / 100
    return counts.join(total, "file_name").select("file_name", F.array_position(names, F.col("status")).cast("int").alias("place"), "status", "n", pct.alias("percentage"), colour.alias("colour"))


def status_report(found: DataFrame) -> DataFrame:
    """(file_name, place, status, n): statuses of each file, the most frequent first (ties by name): one small group a file."""
    counts = found.groupBy("file_name", F.col("category").alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("file_name").orderBy(F.desc("n"), "status")))

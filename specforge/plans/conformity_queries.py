"""Queries over conformity matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.fixtures import cte, fixture
from specforge.functions import text as T
from specforge.operators import conformity as C
from specforge.operators import matrices
from specforge.plans.registry import found, listed, norm, quoted, registry

QUERIES, ORACLES, query = registry()


def sql_class(c: str) -> str:
    n = norm(c)
    return f"""CASE WHEN {n} = '' THEN 'EMPTY' WHEN {n} IN {listed(lexicon.NOK_VALUES)} OR starts_with({n}, 'nok') THEN 'NOK'
      WHEN regexp_matches({n}, '\\b(ok|okay)\\b') AND NOT (contains({n}, 'nok') OR contains({n}, 'not ok') OR contains({n}, 'not conform')) THEN 'OK'
      WHEN regexp_matches({n}, ':\\s*ok') AND NOT contains({n}, 'nok') THEN 'OK' WHEN {n} IN {listed(lexicon.OK_VALUES)} THEN 'OK'
      WHEN {n} IN {listed(lexicon.NA_VALUES)} OR starts_with({n}, 'not applicable') OR starts_with({n}, 'non applic') THEN 'NA' ELSE 'EMPTY' END"""


def items_cte(*names: str) -> str:
    sql = cte(*names)
    for n in names:
        sql += f""", {n}_items AS (SELECT *, {sql_class('conformity_raw')} AS category FROM {n})"""
    return sql


A = items_cte("fx_matrix_a")
AB = items_cte("fx_matrix_a", "fx_matrix_b")
LAST = """, last_a AS (SELECT req_id, arg_max(category, row_index) AS category_a FROM fx_matrix_a_items GROUP BY req_id),
  last_b AS (SELECT req_id, arg_max(category, row_index) AS category_b FROM fx_matrix_b_items GROUP BY req_id),
  comparison AS (SELECT coalesce(a.req_id, b.req_id) AS req_id, coalesce(category_a, 'MISSING') AS category_a, coalesce(category_b, 'MISSING') AS category_b
    FROM last_a a FULL OUTER JOIN last_b b ON a.req_id = b.req_id)"""


def items(spark: SparkSession, sf_dir: str, name: str = "fx_matrix_a") -> DataFrame:
    return C.items(fixture(spark, sf_dir, name))


@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(f"{A} SELECT row_index, conformity_raw, category FROM fx_matrix_a_items")
def classify_conformity(spark, sf_dir):
    return items(spark, sf_dir).select("row_index", "conformity_raw", "category")


@query(f"{A} SELECT category, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fx_matrix_a) AS pct FROM fx_matrix_a_items GROUP BY category")
def conformity_status_summary(spark, sf_dir):
    return C.status_summary(items(spark, sf_dir))


@query(f"""{A} SELECT row_index, category, category = 'EMPTY' AND trim(comment) <> '' AS needs_review,
  CASE WHEN category = 'EMPTY' AND trim(comment) <> '' THEN 'medium' ELSE 'high' END AS classification_confidence FROM fx_matrix_a_items""")
def matrix_review_flags(spark, sf_dir):
    return items(spark, sf_dir).select("row_index", "category", "needs_review", "classification_confidence")


@query(f"""{AB}, both_items AS (SELECT 'a' AS file_name, category, comment FROM fx_matrix_a_items UNION ALL SELECT 'b', category, comment FROM fx_matrix_b_items)
  SELECT file_name, count(*) AS total, count(*) FILTER (category = 'OK') AS ok, count(*) FILTER (category = 'NOK') AS nok, count(*) FILTER (category = 'NA') AS na,
    count(*) FILTER (category = 'EMPTY') AS empty, count(*) FILTER (category = 'EMPTY' AND trim(comment) <> '') AS needs_review FROM both_items GROUP BY file_name""")
def batch_overview(spark, sf_dir):
    return C.overview(both(spark, sf_dir))


def both(spark, sf_dir) -> DataFrame:
    named = [items(spark, sf_dir, f"fx_matrix_{k}").withColumn("file_name", F.lit(k)) for k in "ab"]
    return named[0].unionByName(named[1])


@query(f"""{AB}, both_items AS (SELECT 'a' AS file_name, category FROM fx_matrix_a_items UNION ALL SELECT 'b', category FROM fx_matrix_b_items)
  SELECT file_name, category, count(*) AS n, grouping(file_name) * 2 + grouping(category) AS level FROM both_items GROUP BY ROLLUP (file_name, category)""")
def status_rollup(spark, sf_dir):
    return C.status_rollup(both(spark, sf_dir))


@query(f"""{A} SELECT category AS status, n, n * 10000 // sum(n) OVER () AS basis_points, CASE category WHEN 'OK' THEN 0 WHEN 'NOK' THEN 1 WHEN 'NA' THEN 2 ELSE 3 END AS place
  FROM (SELECT category, count(*) AS n FROM fx_matrix_a_items GROUP BY category)""")
def powerbi_status(spark, sf_dir):
    s = C.status_summary(items(spark, sf_dir))
    place = F.when(F.col("category") == "OK", 0).when(F.col("category") == "NOK", 1).when(F.col("category") == "NA", 2).otherwise(3)
    total = s.agg(F.sum("n").alias("total"))
    return s.crossJoin(F.broadcast(total)).select(F.col("category").alias("status"), "n", F.expr("n * 10000 div total").alias("basis_points"), place.alias("place"))


W_ = cte("fx_wide")
RANK = lambda c: f"CASE {c} WHEN 'NOK' THEN 6 WHEN 'NA' THEN 1 WHEN 'EMPTY' THEN 0 ELSE -1 END"


@query(f"""{W_}, k AS (SELECT *, {sql_class('verdict')} AS v, {sql_class('s0')} AS k0, {sql_class('s1')} AS k1, {sql_class('conformity_raw2')} AS k2
    FROM (SELECT *, CASE row_index % 4 WHEN 0 THEN 'EE: ok' WHEN 1 THEN '' ELSE s0 END AS conformity_raw2 FROM fx_wide)),
  b AS (SELECT *, CASE WHEN v = 'NOK' THEN 'NOK' WHEN trim(s0) <> '' THEN k0
    WHEN trim(s1) <> '' AND trim(conformity_raw2) <> '' THEN CASE WHEN {RANK('k2')} > {RANK('k1')} THEN k2 ELSE k1 END
    WHEN trim(s1) <> '' THEN k1 WHEN trim(conformity_raw2) <> '' THEN k2 ELSE 'EMPTY' END AS base FROM k)
  SELECT row_index, CASE WHEN base = 'EMPTY' AND v = 'OK' THEN 'OK' ELSE base END AS category FROM b""")
def matrix_items(spark, sf_dir):
    w = fixture(spark, sf_dir, "fx_wide")
    third = F.when(F.col("row_index") % 4 == 0, "EE: ok").when(F.col("row_index") % 4 == 1, "").otherwise(F.col("s0"))
    return w.select("row_index", C.chosen_status([F.col("s0"), F.col("s1"), third], F.col("verdict")).alias("category"))


@query(f"""{W_} SELECT row_index, CASE WHEN na <> '' THEN 'NA' WHEN nok <> '' THEN 'NOK' WHEN ok <> '' THEN 'OK' ELSE 'EMPTY' END AS category FROM (
  SELECT row_index, CASE WHEN row_index % 3 = 0 THEN 'x' ELSE '' END AS ok, CASE WHEN row_index % 5 = 0 THEN 'x' ELSE '' END AS nok, CASE WHEN row_index % 17 = 0 THEN 'x' ELSE '' END AS na FROM fx_wide)
  WHERE ok <> '' OR nok <> '' OR na <> ''""")
def matrix_two_columns(spark, sf_dir):
    mark = lambda n: F.when(F.col("row_index") % n == 0, "x").otherwise("")
    d = fixture(spark, sf_dir, "fx_wide").select("row_index", mark(3).alias("ok"), mark(5).alias("nok"), mark(17).alias("na")).where("ok <> '' or nok <> '' or na <> ''")
    return d.select("row_index", C.two_column_status(F.col("ok"), F.col("nok"), F.col("na")).alias("category"))


@query(f"""{W_} SELECT row_index, CASE WHEN trim(applicable) <> '' THEN trim(applicable) WHEN trim(version) <> '' THEN trim(version)
  WHEN regexp_matches(trim(lower(c0)), '^([a-i]|v\\d+)$') THEN trim(c0) ELSE '' END AS version FROM fx_wide""")
def version_resolution(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_wide").select("row_index", C.version_of(F.col("applicable"), F.col("version"), F.col("c0")).alias("version"))


@query(f"""{W_}, k AS (SELECT row_index, CASE WHEN trim(c0) <> '' AND trim(c0) <> version THEN trim(c0) END AS a, CASE WHEN trim(c1) <> '' AND trim(c1) <> version THEN trim(c1) END AS b FROM fx_wide)
  SELECT row_index, CASE WHEN a = b THEN a ELSE concat_ws(' | ', a, b) END AS comment FROM k""")
def merged_comments(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_wide").select("row_index", C.merged_comment([F.col("c0"), F.col("c1")], F.col("version")).alias("comment"))


CELLS = f"""{W_}, cells AS (SELECT row_index, 0 AS col, s0 AS value FROM fx_wide UNION ALL SELECT row_index, 1, c0 FROM fx_wide UNION ALL SELECT row_index, 2, s1 FROM fx_wide
  UNION ALL SELECT row_index, 3, c1 FROM fx_wide UNION ALL SELECT row_index, 4, verdict FROM fx_wide UNION ALL SELECT row_index, 5, version FROM fx_wide)"""


def cells(spark, sf_dir) -> DataFrame:
    w = fixture(spark, sf_dir, "fx_wide")
    return w.select("row_index", F.posexplode(F.array("s0", "c0", "s1", "c1", "verdict", "version")).alias("col", "value"))


@query(f"""{CELLS} SELECT col, count(*) AS filled, count(*) FILTER ({found(norm('value'), chr(92) + 'bok(ay)?' + chr(92) + 'b')}) AS ok_like,
  count(*) FILTER ({found(norm('value'), chr(92) + 'bok(ay)?' + chr(92) + 'b')}) * 10 > count(*) AS is_assessment FROM cells WHERE trim(value) <> '' GROUP BY col""")
def assessment_columns(spark, sf_dir):
    return C.assessment_columns(cells(spark, sf_dir))


@query(f"""{CELLS}, k AS (SELECT col, {norm('value')} AS n, {sql_class('value')} AS category FROM cells WHERE row_index < 100 AND {norm('value')} <> ''),
  p AS (SELECT col, n, category, list_filter(list_transform(string_split(n, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM k),
  s AS (SELECT col, count(*) AS filled, count(*) FILTER (regexp_matches(n, '^([a-i]|v\\d+)$')) AS version_like,
    count(*) FILTER (len(list_filter(parts, lambda x: x NOT IN {listed(lexicon.DOMAIN_CODES)})) = 0) AS domain_like, count(*) FILTER (category <> 'EMPTY') AS status_like FROM p GROUP BY col)
  SELECT *, CASE WHEN filled <= 5 THEN 'keep' WHEN version_like * 10 > filled * 6 THEN 'version' WHEN domain_like * 10 > filled * 5 AND status_like * 10 < filled THEN 'comment' ELSE 'keep' END AS role FROM s""")
def column_reclassify(spark, sf_dir):
    return C.reclassified_columns(cells(spark, sf_dir))


@query(f"{AB}{LAST} SELECT * FROM comparison")
def compare_full(spark, sf_dir):
    return C.compared(items(spark, sf_dir), items(spark, sf_dir, "fx_matrix_b"))


@query(f"""{AB}{LAST}, m AS (SELECT *, CASE category_a WHEN 'OK' THEN 3 WHEN 'NA' THEN 2 WHEN 'EMPTY' THEN 0 ELSE -1 END AS ra, CASE category_b WHEN 'OK' THEN 3 WHEN 'NA' THEN 2 WHEN 'EMPTY' THEN 0 ELSE -1 END AS rb
  FROM comparison WHERE category_a <> 'MISSING' AND category_b <> 'MISSING' AND category_a <> category_b) SELECT req_id, category_a, category_b, rb > ra AS improved FROM m""")
def status_changes(spark, sf_dir):
    return C.status_changes(compare_full(spark, sf_dir))


@query(f"""{AB}{LAST} SELECT req_id, CASE WHEN category_a = 'MISSING' THEN 'a' ELSE 'b' END AS missing_in FROM comparison WHERE category_a = 'MISSING' OR category_b = 'MISSING'""")
def missing_requirements(spark, sf_dir):
    a, b = (C.last_rows(items(spark, sf_dir, f"fx_matrix_{k}")) for k in "ab")
    return b.join(a, "req_id", "left_anti").select("req_id", F.lit("a").alias("missing_in")).union(a.join(b, "req_id", "left_anti").select("req_id", F.lit("b").alias("missing_in")))


@query(f"""{AB}{LAST} SELECT count(*) AS compared, count(*) FILTER (category_a <> category_b AND category_a <> 'MISSING' AND category_b <> 'MISSING') AS changes,
  count(*) FILTER (category_a = 'MISSING') AS missing_a, count(*) FILTER (category_b = 'MISSING') AS missing_b FROM comparison""")
def comparison_totals(spark, sf_dir):
    here = (F.col("category_a") != "MISSING") & (F.col("category_b") != "MISSING")
    return compare_full(spark, sf_dir).agg(
        F.count("*").alias("compared"), F.count_if(here & (F.col("category_a") != F.col("category_b"))).alias("changes"),
        F.count_if(F.col("category_a") == "MISSING").alias("missing_a"), F.count_if(F.col("category_b") == "MISSING").alias("missing_b"),
    )


@query("""SELECT l_orderkey AS req_id, l_linenumber AS matrix_row, arg_max(l_returnflag, l_extendedprice) AS category FROM (
  SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem) GROUP BY l_orderkey, l_linenumber""")
def last_row_wins(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return d.groupBy(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("matrix_row")).agg(F.max_by("l_returnflag", "l_extendedprice").alias("category"))


@query(f"""{AB}, every AS (SELECT 'a' AS matrix, req_id, row_index, category FROM fx_matrix_a_items UNION ALL SELECT 'b', req_id, row_index, category FROM fx_matrix_b_items),
  latest AS (SELECT req_id, matrix, arg_max(category, row_index) AS category FROM every GROUP BY ALL)
  SELECT req_id, count(*) AS present, count(DISTINCT category) AS categories, 2 - count(*) AS missing FROM latest GROUP BY req_id""")
def compare_many(spark, sf_dir):
    return C.compared_many(both(spark, sf_dir).select(F.col("file_name").alias("matrix"), "req_id", "row_index", "category"))


def sql_score(table) -> str:
    return " + ".join(f"CASE WHEN {found('n', p)} THEN {w} ELSE 0 END" for p, _, w in table)


DOMAIN_ONLY = f"(len(parts) > 0 AND len(list_filter(parts, lambda x: x NOT IN {listed(lexicon.DOMAIN_CODES)})) = 0 OR {found('n', C.DOMAIN_OK)})"
COMMENTS = f"""{A}, c AS (SELECT *, {norm('comment')} AS n FROM fx_matrix_a_items WHERE category = 'OK'),
  c1 AS (SELECT *, list_filter(list_transform(string_split(n, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM c)"""


@query(f"""{COMMENTS}, s AS (SELECT row_index, comment, {sql_score(lexicon.SUSPICIONS)} AS score FROM c1 WHERE trim(comment) <> '' AND NOT {DOMAIN_ONLY})
  SELECT row_index, comment, score, CASE WHEN score >= 4 THEN 'error' ELSE 'warning' END AS severity FROM s WHERE score >= 2""")
def ok_suspicion(spark, sf_dir):
    return C.ok_suspicions(items(spark, sf_dir)).select("row_index", "comment", "score", "severity")


@query(f"""{COMMENTS}, s AS (SELECT row_index, conformity_raw, comment, CASE WHEN trim(comment) = '' OR {found("trim(comment)", C.ASSIGNED)} THEN 0 ELSE {sql_score(lexicon.NEGATIVE_SIGNALS)} END AS score FROM c1)
  SELECT row_index, CASE WHEN score > 0 THEN 'OK_NEGATIVE_COMMENT' ELSE 'OK_NO_COMMENT' END AS kind, score, CASE WHEN score >= 4 THEN 'error' ELSE 'warning' END AS severity
  FROM s WHERE score > 0 OR (trim(comment) = '' AND NOT regexp_matches({norm('conformity_raw')}, '\\bok\\b'))""")
def negative_signals(spark, sf_dir):
    return C.inconsistencies(items(spark, sf_dir)).select("row_index", "kind", "score", "severity")


def _label_case() -> str:
    own = lambda labels: [p for p, k, _ in lexicon.SUSPICIONS if k in labels]
    tests = [(" OR ".join(found("n", p) for p in own(k)), t) for k, t in C.PRIORITIES if own(k)]
    return "CASE " + " ".join(f"WHEN {w} THEN {quoted(t)}" for w, t in tests) + f" WHEN {sql_score(lexicon.SUSPICIONS)} >= 3 THEN 'several signals' ELSE 'minor signals' END"


@query(f"""{COMMENTS}, s AS (SELECT row_index, {_label_case()} AS message, {sql_score(lexicon.SUSPICIONS)} AS score FROM c1 WHERE trim(comment) <> '' AND NOT {DOMAIN_ONLY})
  SELECT row_index, message FROM s WHERE score >= 2""")
def ai_comment_label(spark, sf_dir):
    return C.ok_suspicions(items(spark, sf_dir)).select("row_index", C.comment_label(F.col("signals"), F.col("score")).alias("message"))


@query(f"""{COMMENTS}, s AS (SELECT row_index, {sql_score(lexicon.SUSPICIONS)} AS score FROM c1 WHERE trim(comment) <> '' AND NOT {DOMAIN_ONLY})
  SELECT row_index, score FROM s WHERE score >= 2 ORDER BY CASE WHEN score >= 4 THEN 0 ELSE 1 END, score DESC, row_index LIMIT 150""")
def worst_findings(spark, sf_dir):
    """Top-k report of the worst findings."""
    return C.ok_suspicions(items(spark, sf_dir)).orderBy("severity_rank", F.desc("score"), "row_index").limit(150).select("row_index", "score")


HEAD = "SELECT * FROM (VALUES (0, 0, 'Title', '', ''), (0, 1, 'Requirement ID', 'Supplier status', 'Supplier comments'), (1, 0, 'Version', 'Statut FNR', ''), (1, 1, 'x', 'ok', 'remark')) AS t(sheet_idx, row_index, c0, c1, c2)"


@query(f"""WITH h AS ({HEAD}), f AS (SELECT sheet_idx, row_index, CAST({' OR '.join('(' + found(norm(c), '|'.join(f'(?:{p})' for p in lexicon.STATUS_HEADERS)) + ')' for c in ('c0', 'c1', 'c2'))} AS INT)
    + CAST({' OR '.join('(' + found(norm(c), '|'.join(f'(?:{p})' for p in lexicon.COMMENT_HEADERS)) + ')' for c in ('c0', 'c1', 'c2'))} AS INT) AS score FROM h)
  SELECT 'm' AS file_name, sheet_idx, arg_min(row_index, -score * 1000 + row_index) AS header_row, max(score) AS score FROM f WHERE score > 0 GROUP BY sheet_idx""")
def header_rows(spark, sf_dir):
    rows = spark.sql(HEAD).select(F.lit("m").alias("file_name"), "sheet_idx", "row_index", F.array("c0", "c1", "c2").alias("cells"))
    return C.header_rows(rows)


# ---------------------------------------------------------------- the whole path
def sheets(spark, sf_dir) -> DataFrame:
    """Three files of cells: two sets of status and comment with a verdict; OK and NOK columns; versions and domains under wrong headers.  Each has
    a title sheet, blank rows, summary rows and rows that are no requirements."""
    w = fixture(spark, sf_dir, "fx_wide").withColumns({"f": F.expr("cast(row_index % 3 as int)"), "k": F.expr("cast(row_index div 3 as int)")})
    i = F.col("row_index")
    name = F.when(i % 97 == 0, "BLOCK").when(i % 89 == 0, "STOP here").when(i % 83 == 0, "3.2 Chapter").otherwise(F.col("req_id"))
    bare = lambda c: F.when(i % 83 == 0, "").otherwise(c)
    version = F.when(i % 4 == 0, "v2").when(i % 4 == 1, "b").otherwise("c")
    domain = F.when(i % 3 == 0, "SW").when(i % 5 == 0, "ee").otherwise("")
    cells = F.when(F.col("f") == 0, F.array(name, F.lit("ref"), F.col("applicable"), bare(F.col("s0")), bare(F.col("c0")), F.lit("about it"), bare(F.col("s1")), bare(F.col("c1")), bare(F.col("verdict")), F.col("version")))
    cells = cells.when(F.col("f") == 1, F.array(name, F.lit("ref"), F.lit(""), F.lit("about it"), bare(F.when(i % 2 == 0, F.col("s0")).otherwise("")), bare(F.when(i % 5 == 0, F.col("s1")).otherwise("")), bare(F.col("c0"))))
    cells = cells.otherwise(F.array(name, F.lit("ref"), bare(F.col("s0")), bare(F.col("c0")), bare(domain), bare(version)))
    cells = F.when(i % 101 == 0, F.transform(cells, lambda c: F.lit(" "))).otherwise(cells)
    own = F.concat(F.lit("file"), F.col("f").cast("string"), F.lit(".xlsx"))
    body = w.select(own.alias("file_name"), F.lit(1).alias("sheet_idx"), F.lit("Matrix").alias("sheet_name"), (F.col("k") + 10).alias("row_index"), cells.alias("cells"))
    heads = [
        ("file0.xlsx", ["Requirement ID", "Link", "Version applicable", "Statut FNR", "Commentaires FNR", "Text", "Supplier status", "Supplier comments", "Statut Stellantis", "Version"]),
        ("file1.xlsx", ["Requirement ID", "Link", "", "Text", "OK", "NOK", "Supplier comments"]), ("file2.xlsx", ["Requirement ID", "Link", "Statut FNR", "Commentaires FNR", "Supplier status", "Supplier comments"]),
    ]
    rows = [(f, 1, "Matrix", 3, h) for f, h in heads] + [(f, 1, "Matrix", 1, ["Title", ""]) for f, _ in heads] + [(f, 0, "Cover", 0, ["Statut FNR", "nothing else"]) for f, _ in heads]
    rows += [(f, 1, "Matrix", 5, ["Template rows", "x"]) for f, _ in heads]
    return body.unionByName(spark.createDataFrame(rows, "file_name string, sheet_idx int, sheet_name string, row_index int, cells array<string>"))


_n = norm
_is_ver = lambda c: f"regexp_matches({_n(c)}, '^([a-i]$|v\\d+)')"
_saysok = lambda c: f"((regexp_matches({_n(c)}, ':\\s*ok') AND NOT contains({_n(c)}, 'nok')) OR (regexp_matches({_n(c)}, '\\b(ok|okay)\\b') AND NOT contains({_n(c)}, 'nok') AND NOT contains({_n(c)}, 'not ok')))"
_vnok = f"({_n('verdict')} IN {listed(lexicon.NOK_VALUES)} OR starts_with({_n('verdict')}, 'nok'))"
_vok = f"(({_n('verdict')} IN {listed(lexicon.OK_VALUES)} OR regexp_matches({_n('verdict')}, '\\bok\\b')) AND NOT contains({_n('verdict')}, 'nok') AND NOT contains({_n('verdict')}, 'not ok'))"
_same = lambda c: f"(ver <> '' AND ({c} = ver OR {_n(c)} = {_n('ver')}))"
_said = lambda c: f"CASE WHEN {c} <> '' AND NOT {_same(c)} THEN {c} END"
_tail = "CASE WHEN category = 'EMPTY' AND comment <> '' THEN 'medium' ELSE 'high' END AS classification_confidence, category = 'EMPTY' AND comment <> '' AS needs_review"
MATRIX = f"""{cte('fx_wide')}, w AS (SELECT row_index AS i, CAST(row_index % 3 AS INT) AS f, CAST(row_index // 3 + 10 AS INT) AS row_index, CASE WHEN row_index % 97 = 0 THEN 'BLOCK' WHEN row_index % 89 = 0 THEN 'STOP here' WHEN row_index % 83 = 0 THEN '3.2 Chapter' ELSE req_id END AS req_id,
    trim(applicable) AS applicable, trim(version) AS version, {', '.join(f"CASE WHEN row_index % 83 = 0 THEN '' ELSE trim({c}) END AS {c}" for c in ('s0', 'c0', 's1', 'c1', 'verdict'))}, row_index % 101 = 0 AS blank FROM fx_wide),
  v AS (SELECT *, CASE WHEN i % 83 = 0 THEN '' WHEN i % 4 = 0 THEN 'v2' WHEN i % 4 = 1 THEN 'b' ELSE 'c' END AS verc, CASE WHEN i % 83 = 0 THEN '' WHEN i % 3 = 0 THEN 'SW' WHEN i % 5 = 0 THEN 'ee' ELSE '' END AS dom FROM w),
  lastrow AS (SELECT f, max(row_index) FILTER (NOT blank) AS z FROM v GROUP BY f), firstrow AS (SELECT f, min(row_index) FILTER (NOT blank AND req_id NOT IN ('BLOCK', 'STOP here')) AS a FROM v GROUP BY f),
  r AS (SELECT v.* FROM v JOIN lastrow l ON l.f = v.f JOIN firstrow t ON t.f = v.f WHERE row_index BETWEEN a AND z AND (blank OR req_id NOT IN ('BLOCK', 'STOP here'))),
  rate AS (SELECT (SELECT avg(CAST({_saysok('s0')} AS INT)) > 0.1 FROM r WHERE f = 0 AND NOT blank AND s0 <> '') AS a0, (SELECT avg(CAST({_saysok('s1')} AS INT)) > 0.1 FROM r WHERE f = 0 AND NOT blank AND s1 <> '') AS a1, (SELECT avg(CAST({_saysok('s0')} AS INT)) > 0.1 FROM r WHERE f = 2 AND NOT blank AND s0 <> '') AS a2),
  b AS (SELECT f, row_index, '' AS req_id, '' AS reference, '' AS description, '' AS conformity_raw, 'EMPTY' AS category, '' AS comment, '' AS version, 0 AS column_set FROM r WHERE blank),
  x0 AS (SELECT *, {sql_class('s0')} AS k0, {sql_class('s1')} AS k1, CASE WHEN applicable <> '' THEN applicable WHEN version <> '' THEN version WHEN {_is_ver('c0')} THEN c0 WHEN {_is_ver('c1')} THEN c1 ELSE '' END AS ver FROM r, rate WHERE f = 0 AND NOT blank AND (starts_with(req_id, 'REQ-') OR s0 || c0 || s1 || c1 || verdict <> '')),
  y0 AS (SELECT *, CASE WHEN NOT a0 AND s0 <> '' THEN 's0' WHEN NOT a1 AND s1 <> '' THEN 's1' WHEN a0 AND s0 || c0 <> '' AND NOT (a1 AND s1 || c1 <> '' AND {RANK('k1')} > {RANK('k0')}) THEN 's0' WHEN a1 AND s1 || c1 <> '' THEN 's1' ELSE '' END AS pick FROM x0),
  z0 AS (SELECT f, row_index, req_id, 'ref' AS reference, 'about it' AS description, CASE WHEN {_vnok} THEN 'NOK' WHEN CASE pick WHEN 's0' THEN k0 WHEN 's1' THEN k1 ELSE 'EMPTY' END = 'EMPTY' AND {_vok} THEN 'OK' ELSE CASE pick WHEN 's0' THEN k0 WHEN 's1' THEN k1 ELSE 'EMPTY' END END AS category,
      CASE WHEN {_vnok} THEN verdict WHEN CASE pick WHEN 's0' THEN k0 WHEN 's1' THEN k1 ELSE 'EMPTY' END = 'EMPTY' AND {_vok} THEN verdict ELSE CASE pick WHEN 's0' THEN s0 WHEN 's1' THEN s1 ELSE '' END END AS conformity_raw,
      CASE WHEN {_said('c0')} = {_said('c1')} THEN c0 ELSE concat_ws(' | ', {_said('c0')}, {_said('c1')}) END AS comment, ver AS version, CASE WHEN {_vnok} OR (CASE pick WHEN 's0' THEN k0 WHEN 's1' THEN k1 ELSE 'EMPTY' END = 'EMPTY' AND {_vok}) THEN 0 WHEN pick = 's1' THEN 1 ELSE 0 END AS column_set FROM y0),
  x1 AS (SELECT *, CASE WHEN i % 2 = 0 THEN s0 ELSE '' END AS o, CASE WHEN i % 5 = 0 THEN s1 ELSE '' END AS n FROM r WHERE f = 1 AND NOT blank),
  y1 AS (SELECT *, CASE WHEN o <> '' THEN {sql_class('o')} END AS ko, CASE WHEN n <> '' THEN {sql_class('n')} END AS kn FROM x1),
  z1 AS (SELECT f, row_index, req_id, 'ref' AS reference, CASE WHEN n <> '' THEN n ELSE 'about it' END AS description, CASE WHEN ko = 'NA' OR kn = 'NA' THEN 'NA' WHEN kn = 'NOK' THEN 'NOK' WHEN ko = 'OK' THEN 'OK' ELSE coalesce(kn, ko, 'EMPTY') END AS category,
      CASE WHEN ko = 'NA' THEN o WHEN kn = 'NA' THEN n WHEN kn = 'NOK' THEN n WHEN ko = 'OK' THEN o WHEN kn IS NOT NULL THEN n WHEN ko IS NOT NULL THEN o ELSE '' END AS conformity_raw, c0 AS comment, '' AS version, 0 AS column_set FROM y1 WHERE o || n || c0 <> ''),
  x2 AS (SELECT *, {sql_class('s0')} AS k0, verc AS ver FROM r, rate WHERE f = 2 AND NOT blank AND (starts_with(req_id, 'REQ-') OR s0 || c0 || dom <> '')),
  z2 AS (SELECT f, row_index, req_id, 'ref' AS reference, verc AS description, CASE WHEN s0 <> '' THEN k0 ELSE 'EMPTY' END AS category, s0 AS conformity_raw, CASE WHEN {_said('c0')} = {_said('dom')} THEN c0 ELSE concat_ws(' | ', {_said('c0')}, {_said('dom')}) END AS comment, ver AS version, 0 AS column_set FROM x2),
  e AS (SELECT * FROM b UNION ALL BY NAME SELECT * FROM z0 UNION ALL BY NAME SELECT * FROM z1 UNION ALL BY NAME SELECT * FROM z2),
  it AS MATERIALIZED (SELECT 'file' || f || '.xlsx' AS file_name, 'Matrix' AS sheet_name, e.* EXCLUDE (f), {_tail} FROM e)"""


@query(f"{MATRIX} SELECT * FROM it")
def matrix_path(spark, sf_dir):
    """From rows of spreadsheets over header roles, data range and moved columns to items."""
    return matrices.items(sheets(spark, sf_dir))


@query(f"""{MATRIX} SELECT file_name, list_position(['OK', 'NOK', 'NA', 'EMPTY'], category)::INT AS place, category AS status, count(*) AS n, floor(count(*) * 10000 / sum(count(*)) OVER (PARTITION BY file_name) + 0.5) / 100 AS percentage,
  CASE category WHEN 'OK' THEN '#28a745' WHEN 'NOK' THEN '#dc3545' WHEN 'NA' THEN '#6c757d' ELSE '#e9ecef' END AS colour FROM it GROUP BY file_name, category""")
def matrix_status_table(spark, sf_dir):
    """Status summary of each file, with percentages, in the order of the report."""
    return matrices.status_table(matrix_path(spark, sf_dir))


@query(f"""{MATRIX}, c AS (SELECT *, {_n('comment')} AS n, list_filter(list_transform(string_split({_n('comment')}, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM it WHERE category = 'OK' AND comment <> ''),
  s AS (SELECT file_name, row_index, req_id, conformity_raw, comment, {sql_score(lexicon.SUSPICIONS)} AS score FROM c WHERE NOT {DOMAIN_ONLY})
  SELECT file_name, row_index, req_id, conformity_raw, comment, score, CASE WHEN score >= 4 THEN 'error' ELSE 'warning' END AS severity FROM s WHERE score >= 2""")
def matrix_findings(spark, sf_dir):
    """Third report table: OK items whose comment doubts it."""
    return C.ok_suspicions(matrix_path(spark, sf_dir)).select("file_name", "row_index", "req_id", "conformity_raw", "comment", "score", "severity")


@query(f"{MATRIX} SELECT file_name, category AS status, count(*) AS n, row_number() OVER (PARTITION BY file_name ORDER BY count(*) DESC, category) AS place FROM it GROUP BY file_name, category")
def matrix_status_report(spark, sf_dir):
    """Statuses of each file by count."""
    return matrices.status_report(matrix_path(spark, sf_dir))

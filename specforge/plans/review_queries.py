"""Queries of the line review, of requirement rows, of lookups, and of the arithmetic of reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge.fixtures import cte, fixture
from specforge.functions import text as T
from specforge.operators import catalogue_rules, review, rules, scoring, standards
from specforge.plans.document_queries import TABLES, requirement_tables, strip_sql
from specforge.plans.evidence_queries import sql_curve, sql_round
from specforge.plans.registry import found, listed, quoted, registry, times
from specforge.operators.requirements import LIKE_REQUIREMENT, table_requirements

QUERIES, ORACLES, query = registry()
G = cte("fx_guide_lines")
GR = G.replace("WITH ", "WITH RECURSIVE ", 1)


def spec(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_guide_lines")


def texts(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return spec(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


# ---------------------------------------------------------------- sections as paths


def _clean(c: str) -> str:
    cut = rf"regexp_split_to_array(regexp_replace({strip_sql(c)}, '\s*:\s*$', ''), '\s*[–—-]\s*')[1]"
    return rf"regexp_replace({strip_sql(cut)}, '\s+', ' ', 'g')"


_ext = lambda c, p: f"regexp_extract({c}, {quoted(p)}, 1)"
HEADS = rf"""hp AS (SELECT doc_id, line_no, regexp_replace({strip_sql('line')}, '^#+\s*', '') AS s FROM fx_guide_lines),
  hc AS (SELECT *, {_clean(_ext('s', review.NUMBERED_CAPS))} AS n1, {_clean(_ext('s', review.PLAIN_CAPS))} AS n2, {strip_sql(_ext('s', review.LEVELLED))} AS w FROM hp WHERE length(s) BETWEEN 4 AND 120),
  hn AS (SELECT *, {_clean("regexp_replace(w, '^[0-9]+([.][0-9]+)*[.]?" + chr(92) + "s*', '')")} AS n3 FROM hc),
  hx AS (SELECT doc_id, line_no, CASE WHEN length(n1) >= 4 THEN n1 WHEN length(n2) >= 4 THEN n2 ELSE n3 END AS name, CASE WHEN length(n1) >= 4 OR length(n2) >= 4 OR regexp_matches(n3, {quoted(review.CAPS_NAME)}) THEN 1 ELSE least(length(w) - length(replace(w, '.', '')) + 1, 4) END AS level
    FROM hn WHERE length(n1) >= 4 OR length(n2) >= 4 OR w <> ''),
  ho AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM hx),
  st AS (SELECT doc_id, k, line_no, [name] AS stack FROM ho WHERE k = 1 UNION ALL SELECT h.doc_id, h.k, h.line_no, list_append(st.stack[1:h.level - 1], h.name) FROM st JOIN ho h ON h.doc_id = st.doc_id AND h.k = st.k + 1),
  pt AS MATERIALIZED (SELECT l.doc_id, l.line_no, l.line, coalesce(last_value(CASE WHEN len(stack) >= 2 THEN '[' || stack[1] || '] > ' || stack[-1] WHEN len(stack) = 1 THEN '[' || stack[1] || ']' END IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.line_no), 'Document Start') AS section
    FROM fx_guide_lines l LEFT JOIN st ON st.doc_id = l.doc_id AND st.line_no = l.line_no)"""


@query(f"{GR}, {HEADS} SELECT doc_id, line_no, section FROM pt")
def line_section_paths(spark, sf_dir):
    return review.paths(spec(spark, sf_dir)).select("doc_id", "line_no", "section")


TOP = r"CASE WHEN regexp_extract(section, '\[([^\]]+)\]', 1) <> '' THEN regexp_extract(section, '\[([^\]]+)\]', 1) ELSE section END"
CONTENTS = rf"""cx AS (SELECT doc_id, {TOP} AS section, line, {strip_sql('line')} AS s FROM pt WHERE section <> 'Document Start'),
  cy AS (SELECT *, s <> '' AND NOT regexp_matches(s, '^[A-Z][A-Z\s/()-]{{5,}}$') AND NOT regexp_matches(s, '(?i)^(N/?A|Not\s+Applicable)\s*$') AS own FROM cx),
  cz AS MATERIALIZED (SELECT doc_id, section, CASE WHEN count(*) FILTER (s <> '') = 0 THEN 'empty' WHEN count(*) FILTER (s <> '' AND NOT regexp_matches(s, {quoted(review.NOT_APPLICABLE)})) = 0 THEN 'na_only'
    WHEN sum({times('line', '<<[^>]*>>')} + {times('line', '(?i)' + chr(92) + 'bTBD' + chr(92) + 'b')} + {times('line', chr(92) + 'bXXX' + chr(92) + 'b')}) > 0 THEN 'has_placeholders' WHEN count(*) FILTER (own) >= 5 OR coalesce(sum(length(s)) FILTER (own), 0) >= 100 THEN 'ok' ELSE 'minimal_content' END AS status,
    count(*) FILTER (own) AS lines, coalesce(sum(length(s)) FILTER (own), 0)::BIGINT AS chars, sum({times('line', '(?i)' + chr(92) + 'b(?:shall|must)' + chr(92) + 'b')})::BIGINT AS statements FROM cy GROUP BY doc_id, section)"""


@query(f"{GR}, {HEADS}, {CONTENTS} SELECT * FROM cz")
def section_contents(spark, sf_dir):
    return review.contents(spec(spark, sf_dir))


_expected = ", ".join(f"({k}, {quoted(n)})" for k, n in enumerate(review.EXPECTED))
_scored = "[" + ", ".join(quoted(n.lower()) for n in review.SCORED) + "]"


@query(rf"""{G}, hp AS (SELECT doc_id, regexp_replace({strip_sql('line')}, '^#+\s*', '') AS s FROM fx_guide_lines), hc AS (SELECT doc_id, {_clean(_ext('s', review.NUMBERED_CAPS))} AS a, {_clean(_ext('s', review.PLAIN_CAPS))} AS b, {_clean(_ext('s', review.LEVELLED_NAME))} AS c FROM hp WHERE length(s) BETWEEN 4 AND 120),
  hn AS (SELECT DISTINCT doc_id, coalesce(nullif(a, ''), nullif(b, ''), nullif(c, '')) AS name FROM hc), hd AS (SELECT * FROM hn WHERE length(name) BETWEEN 5 AND 79), d0 AS (SELECT doc_id, lower(string_agg(line, chr(10) ORDER BY line_no)) AS low FROM fx_guide_lines GROUP BY doc_id),
  ex AS (SELECT * FROM (VALUES {_expected}) AS t(k, name)), m AS (SELECT d0.doc_id, ex.k, ex.name, contains(low, lower(ex.name)) AS named, EXISTS (SELECT 1 FROM hd WHERE hd.doc_id = d0.doc_id AND contains(lower(hd.name), lower(ex.name))) AS headed FROM d0, ex),
  ad AS (SELECT a.* FROM m a WHERE named AND NOT headed AND NOT EXISTS (SELECT 1 FROM m b WHERE b.doc_id = a.doc_id AND b.k < a.k AND b.named AND NOT b.headed AND contains(b.name, a.name))),
  al AS (SELECT doc_id, lower(name) AS name FROM hd UNION ALL SELECT doc_id, lower(name) FROM ad), al2 AS (SELECT doc_id, list(name) AS names FROM al GROUP BY doc_id),
  z AS (SELECT d0.doc_id, (SELECT count(*) FROM hd WHERE hd.doc_id = d0.doc_id)::INT AS found, (SELECT count(*) FROM ad WHERE ad.doc_id = d0.doc_id)::INT AS added, (SELECT count(*) FROM m WHERE m.doc_id = d0.doc_id AND NOT named AND NOT headed)::INT AS missing,
    coalesce((SELECT array_to_string(list_slice(list(name ORDER BY k), 1, 5), ', ') FROM m WHERE m.doc_id = d0.doc_id AND NOT named AND NOT headed AND name IN {listed(review.KEY_SECTIONS)}), '') AS missing_keys,
    len(list_filter({_scored}, lambda x: len(list_filter(coalesce(names, []), lambda h: contains(h, x))) > 0)) / {len(review.SCORED)}::DOUBLE AS r FROM d0 LEFT JOIN al2 ON al2.doc_id = d0.doc_id)
  SELECT doc_id, found, added, missing, missing_keys, round({sql_curve('r')}, 9) AS structure FROM z""")
def expected_sections(spark, sf_dir):
    """Headings found, sections that only the text names, and those that nothing names."""
    return review.scan(spec(spark, sf_dir))


LEFT = "lo AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{label}' AS label, unnest(regexp_extract_all({strip_sql('line')}, {quoted(p)})) AS text, generate_subscripts(regexp_extract_all({strip_sql('line')}, {quoted(p)}), 1) AS i FROM fx_guide_lines" for p, label in review.LEFTOVERS) + ")"


@query(f"""{GR}, {HEADS}, {LEFT}, o AS (SELECT lo.*, section, row_number() OVER (PARTITION BY lo.doc_id, label ORDER BY lo.line_no, i) AS k FROM lo JOIN pt ON pt.doc_id = lo.doc_id AND pt.line_no = lo.line_no)
  SELECT doc_id, label, count(*) AS n, string_agg('line ' || (line_no + 1), ', ' ORDER BY k) FILTER (k <= 5) AS places, left(max(text) FILTER (k = 1), 120) AS example, array_to_string(list_sort(list_distinct(list(section) FILTER (k <= 5))), ' | ') AS sections FROM o GROUP BY doc_id, label""")
def placeholder_findings(spark, sf_dir):
    """A finding per kind of leftover, with its first places and the sections that they stand in."""
    return review.leftover_findings(spec(spark, sf_dir))


@query(f"{G}, {LEFT} SELECT doc_id, count(DISTINCT label) AS kinds, count(*) AS n, CASE WHEN count(DISTINCT label) > 1 THEN 'template_artifacts' ELSE 'placeholder_detected' END AS type FROM lo GROUP BY doc_id")
def placeholder_merge(spark, sf_dir):
    return review.merged_leftovers(review.leftover_findings(spec(spark, sf_dir)))


# ---------------------------------------------------------------- rows of requirements
ROWS = rf"""{TABLES}, s3 AS (SELECT doc_id, table_index, count(*) FILTER (row_index <= 3 AND length(line) > 10) AS sampled, count(*) FILTER (row_index <= 3 AND length(line) > 10 AND {found('line', LIKE_REQUIREMENT)}) AS alike FROM tr WHERE row_index > 0 GROUP BY doc_id, table_index),
  rw AS MATERIALIZED (SELECT t.doc_id, t.table_index, t.row_index, t.section, CASE WHEN form = 0 AND row_index % 2 = 1 THEN 'REF-A-' || (t.table_index * 6 + row_index) ELSE '' END AS own, {strip_sql('line')} AS d, line AS raw, CASE WHEN form = 0 THEN 'N/A' ELSE 'UP-1' END AS up
    FROM tr t JOIN s3 ON s3.doc_id = t.doc_id AND s3.table_index = t.table_index WHERE row_index > 0 AND (form = 0 OR (form = 3 AND NOT (sampled > 0 AND alike = 0))) AND (line <> '' OR (form = 0 AND row_index % 2 = 1)))"""


def rows(spark, sf_dir):
    return table_requirements(requirement_tables(spark, sf_dir))


@query(rf"""{ROWS}, k AS (SELECT doc_id, count(*) AS total, count(*) FILTER (own = '') AS no_id, count(*) FILTER (up = 'N/A') AS not_applicable, count(*) FILTER (d <> '' AND length(d) < 30) AS weak, count(*) FILTER (up <> 'N/A') AS traced,
    count(*) FILTER (regexp_matches(raw, '(?i)(?:when|if|during|upon|after)\s+') AND regexp_matches(raw, '(?i)\b(?:shall|must|will)\b')) AS structured, count(*) FILTER (NOT regexp_matches(raw, '(?i)(?:when|if|during|upon|after)\s+') AND regexp_matches(raw, '(?i)\b(?:shall|must|will)\b')) AS unconditioned FROM rw GROUP BY doc_id)
  SELECT doc_id, total, no_id, not_applicable, weak, CASE WHEN no_id > 0 THEN 'warning' ELSE 'none' END AS id_finding, CASE WHEN weak * 5 > total THEN 'warning' ELSE 'none' END AS weak_finding,
    CASE WHEN traced / total >= 0.9 THEN 0.9 WHEN traced / total >= 0.7 THEN 0.7 WHEN traced / total >= 0.5 THEN 0.5 WHEN traced / total >= 0.25 THEN 0.3 ELSE 0.1 END::DOUBLE AS traceability, structured, unconditioned, CASE WHEN structured * 2 < total THEN 'warning' ELSE 'none' END AS pattern_finding FROM k""")
def requirement_row_findings(spark, sf_dir):
    return review.row_findings(rows(spark, sf_dir))


ISSUES = rf"""{ROWS}, iss AS MATERIALIZED (SELECT doc_id, table_index, row_index, section, CASE WHEN own = '' THEN '[MISSING]' ELSE own END AS req_id, left(d, 150) AS description, unnest(list_filter([CASE WHEN own = '' THEN 'missing_id' END, CASE WHEN {found('d', rules.PLACEHOLDER)} OR regexp_matches(d, '\bXXX\b') THEN 'placeholder_in_desc' END,
    CASE WHEN up = 'N/A' THEN 'missing_input_ref' END, CASE WHEN d <> '' AND length(d) < 40 THEN 'weak_description' END, CASE WHEN own <> '' AND {found('d', review.EXTERNAL)} AND {found('d', review.INDIRECT)} AND length({strip_sql(f"regexp_replace(d, {quoted(review.EXTERNAL)}, '', 'g')")}) < 60 THEN 'indirect_requirement' END], lambda x: x IS NOT NULL)) AS type FROM rw)"""


@query(f"{ISSUES} SELECT * FROM iss")
def requirement_row_issues(spark, sf_dir):
    return review.row_issues(rows(spark, sf_dir))


@query(rf"""{ISSUES}, g0 AS (SELECT *, list_slice(list_filter(regexp_split_to_array(description, '\s+'), lambda w: length(w) > 2), 1, 3) AS w FROM iss), g1 AS (SELECT *, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE '[empty]' END AS key FROM g0),
  g2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, type, key) AS n, row_number() OVER (PARTITION BY doc_id, type, key ORDER BY description = '', table_index, row_index) AS k FROM g1)
  SELECT doc_id, type, CASE WHEN type IN ('missing_id', 'placeholder_in_desc') THEN 'error' ELSE 'warning' END AS severity, req_id, description, 1::BIGINT AS n FROM g2 WHERE n <= 2 AND description <> ''
  UNION ALL SELECT doc_id, type, CASE WHEN type IN ('missing_id', 'placeholder_in_desc') THEN 'error' ELSE 'warning' END, '[' || n || ' requirements]', CASE WHEN description = '' THEN '[empty description]' ELSE left(description, 80) END, n FROM g2 WHERE n > 2 AND k = 1""")
def requirement_issue_groups(spark, sf_dir):
    """Issues by type and first three words: few are shown one by one, many as a pattern."""
    return review.issue_groups(review.row_issues(rows(spark, sf_dir)))


@query(rf"""{ROWS}, h AS (SELECT doc_id, table_index, regexp_replace(lower(left(d, 80)), '\s+', ' ', 'g') AS head FROM rw WHERE length(lower(left(d, 80))) >= 15) SELECT doc_id, left(head, 100) AS description, count(DISTINCT table_index) AS tables, count(*) AS n FROM h GROUP BY doc_id, head HAVING count(DISTINCT table_index) >= 2""")
def repeated_requirements(spark, sf_dir):
    return review.repeated_descriptions(rows(spark, sf_dir))


@query(f"""{GR}, {HEADS}, {CONTENTS}, {LEFT}, ev AS (SELECT lo.doc_id, {TOP} AS section, 'p' AS what FROM lo JOIN pt ON pt.doc_id = lo.doc_id AND pt.line_no = lo.line_no UNION ALL SELECT doc_id, section, 'i' FROM cz WHERE status <> 'ok'),
  nm AS (SELECT * FROM ev WHERE length(trim(section)) BETWEEN 4 AND 100 AND NOT {found('trim(section)', review.NO_SECTION)} AND regexp_matches(section, '[A-Za-z]'))
  SELECT n.doc_id, n.section, coalesce(any_value(cz.status), 'checked_with_issues') AS status, count(*) FILTER (what = 'i') AS issues, 0::BIGINT AS requirements, count(*) FILTER (what = 'p') AS placeholders FROM nm n LEFT JOIN cz ON cz.doc_id = n.doc_id AND cz.section = n.section GROUP BY n.doc_id, n.section""")
def section_issue_counts(spark, sf_dir):
    """Issues and leftovers by section (the tables of this fixture stand in sections whose names are too short to show)."""
    return review.section_counts(spec(spark, sf_dir), rows(spark, sf_dir))


@query(f"""{G}, t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM fx_guide_lines GROUP BY doc_id),
  x AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, {quoted(review.STATE)}, 1), lambda s: {strip_sql('s')}), lambda s: regexp_matches(s, {quoted(review.STATE_NAME)}))) AS s, list_transform(regexp_extract_all(text, {quoted(review.TRANSITION)}, 1), lambda v: {strip_sql('v')}) AS a,
    list_transform(regexp_extract_all(text, {quoted(review.TRANSITION)}, 2), lambda v: {strip_sql('v')}) AS b FROM t),
  y AS (SELECT doc_id, s, list_filter(list_zip(a, b), lambda m: regexp_matches(m[1], {quoted(review.STATE_NAME)}) AND regexp_matches(m[2], {quoted(review.STATE_NAME)})) AS m FROM x),
  z AS (SELECT doc_id, s, m, list_distinct(list_transform(m, lambda q: q[1])) AS f, list_distinct(list_transform(m, lambda q: q[2])) AS t FROM y),
  k AS (SELECT doc_id, len(s)::INT AS states, len(m)::INT AS transitions, CASE WHEN len(s) > 0 AND len(m) > 0 THEN len(list_filter(f, lambda q: NOT list_contains(t, q))) ELSE 0 END::INT AS no_way_in, CASE WHEN len(s) > 0 AND len(m) > 0 THEN len(list_filter(t, lambda q: NOT list_contains(f, q))) ELSE 0 END::INT AS no_way_out FROM z)
  SELECT *, CAST(no_way_in > 2 AS INT) + CAST(no_way_out > 1 AS INT) AS findings FROM k""")
def state_completeness(spark, sf_dir):
    return review.states(texts(spark, sf_dir))


# ---------------------------------------------------------------- a model's findings
EVIDENCE = f"""{G}, t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM fx_guide_lines GROUP BY doc_id),
  ev AS (SELECT doc_id, CAST(line_no % 7 AS INT) AS finding_id, line_no, CASE WHEN line_no % 3 = 0 THEN 'CTS Writing guide' ELSE 'Component template' END AS source_document, CASE line_no % 4 WHEN 0 THEN line WHEN 1 THEN 'a sentence that nobody wrote' WHEN 2 THEN 'short' ELSE '' END AS excerpt, CASE WHEN line_no % 2 = 0 THEN line ELSE 'some other support text' END AS support FROM fx_guide_lines)"""


@query(f"""{EVIDENCE}, l AS (SELECT ev.*, text, CASE WHEN length(excerpt) < 10 THEN support ELSE excerpt END AS looked FROM ev JOIN t ON t.doc_id = ev.doc_id),
  k AS (SELECT doc_id, finding_id, count(*) AS n, count(*) FILTER (NOT (length(looked) >= 10 AND (contains(text, looked) OR contains(text, left(looked, 40)))) AND source_document = 'Component template') AS template_only FROM l GROUP BY doc_id, finding_id)
  SELECT doc_id, finding_id, CASE WHEN n = template_only THEN 'hypothesis' ELSE 'verified' END AS verdict, n, template_only FROM k""")
def evidence_verification(spark, sf_dir):
    """Findings whose evidence only cites the template are hypotheses."""
    n = F.col("line_no")
    ev = spec(spark, sf_dir).select(
        "doc_id", (n % 7).cast("int").alias("finding_id"), F.when(n % 3 == 0, "CTS Writing guide").otherwise("Component template").alias("source_document"),
        F.when(n % 4 == 0, F.col("line")).when(n % 4 == 1, "a sentence that nobody wrote").when(n % 4 == 2, "short").otherwise("").alias("excerpt"), F.when(n % 2 == 0, F.col("line")).otherwise("some other support text").alias("support"),
    )
    return review.verified(ev, texts(spark, sf_dir))


@query(f"""{ISSUES}, m AS (SELECT DISTINCT doc_id, type, 'model' AS severity FROM iss WHERE doc_id % 2 = 0 AND type <> 'missing_id'), o AS (SELECT DISTINCT doc_id, type, 'warning' AS severity FROM iss)
  SELECT doc_id, type, severity, 'model' AS origin FROM m UNION ALL SELECT o.doc_id, o.type, o.severity, 'rules' FROM o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = o.doc_id AND m.type = o.type)""")
def finding_completion(spark, sf_dir):
    """Findings of rules are added where the model names none of their type."""
    own = review.row_issues(rows(spark, sf_dir)).select("doc_id", "type").distinct()
    model = own.where("doc_id % 2 = 0 and type <> 'missing_id'").withColumn("severity", F.lit("model"))
    return review.completed(model, own.withColumn("severity", F.lit("warning")))


@query("""WITH f AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'warning' ELSE 'error' END AS severity FROM orders WHERE o_orderkey % 5 < 3), a AS (SELECT o_orderkey AS key, 'info' AS severity FROM orders WHERE o_orderkey % 4 = 0)
  SELECT f.key, coalesce(a.severity, f.severity) AS severity, CASE WHEN a.key IS NULL THEN 'motifs' ELSE 'ia' END AS method FROM f LEFT JOIN a ON a.key = f.key""")
def model_verdict_join(spark, sf_dir):
    """A model's verdicts by item, with the rules' own where it gave none."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("key"))
    f = o.where("key % 5 < 3").withColumn("severity", F.when(F.col("key") % 2 == 0, "warning").otherwise("error"))
    return review.model_verdicts(f, o.where("key % 4 = 0").withColumn("severity", F.lit("info")))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE CAST(o_orderkey % 10 AS INT) END AS score, CASE WHEN o_orderkey % 3 = 0 THEN 'CANNOT_VERIFY' ELSE 'v' || (o_orderkey % 7) END AS verdict FROM orders""")
def model_answers(spark, sf_dir):
    """Answers as JSON, within code fences or not; what isn't JSON can't be verified."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"score": '), (k % 10).cast("string"), F.lit(', "verdict": "v'), (k % 7).cast("string"), F.lit('"}'))
    answer = F.when(k % 3 == 0, "I can't say").when(k % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("key"), review.parsed(answer, "score int, verdict string").alias("p"))
    return d.select("key", F.coalesce("p.score", F.lit(-1)).alias("score"), F.coalesce("p.verdict", F.lit("CANNOT_VERIFY")).alias("verdict"))


# ---------------------------------------------------------------- lookups
BOOK = (("PURPOSE", "Must tell the goal"), ("PURPOSE", "Must locate the part"), ("SCOPE", "Must define the scope"), ("SYSTEM ROLES", "Must tell the role"), ("FUNCTIONAL REQUIREMENTS", "Must use shall"), ("REQUIREMENTS", "Must be numbered"))
DEFAULTS = ("Must conform to the plan", "Must be final")
_book = ", ".join(f"({list(dict.fromkeys(n for n, _ in BOOK)).index(n)}, {k}, {quoted(n)}, {quoted(r)})" for k, (n, r) in enumerate(BOOK))


@query(f"""{G}, s AS (SELECT DISTINCT line AS section FROM fx_guide_lines), b AS (SELECT * FROM (VALUES {_book}) AS t(place, k, name, rule)), n AS (SELECT DISTINCT place, name FROM b),
  h AS (SELECT section, name FROM s, n WHERE contains(upper(trim(section)), name) OR contains(name, upper(trim(section))) QUALIFY row_number() OVER (PARTITION BY section ORDER BY name <> upper(trim(section)), place) = 1)
  SELECT s.section, CASE WHEN h.name IS NULL THEN {quoted(' / '.join(DEFAULTS))} ELSE (SELECT string_agg(rule, ' / ' ORDER BY k) FROM b WHERE b.name = h.name) END AS rules FROM s LEFT JOIN h ON h.section = s.section""")
def section_rule_lookup(spark, sf_dir):
    order = list(dict.fromkeys(n for n, _ in BOOK))
    book = spark.createDataFrame([(n, order.index(n) * 100 + k, r) for k, (n, r) in enumerate(BOOK)], "name string, place int, rule string")
    d = review.section_rules(spec(spark, sf_dir).select(F.col("line").alias("section")).distinct(), book, DEFAULTS)
    return d.withColumn("rules", F.array_join("rules", " / "))


KNOWN = ("PURPOSE", "System roles & duties", "External-Interfaces requirements", "Design, manufacturing", "RAMS", "Quoted documents")
_plain = lambda c: rf"trim(regexp_replace(regexp_replace(upper(trim({c})), '[^A-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_long = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda w: length(w) > 2))"


@query(rf"""{G}, s AS (SELECT DISTINCT line AS target FROM fx_guide_lines WHERE line <> ''), k AS (SELECT * FROM (VALUES {', '.join(f'({n}, {quoted(x)})' for n, x in enumerate(KNOWN))}) AS t(place, name)),
  p AS (SELECT target, place, name, upper(trim(target)) AS u, upper(name) AS ku, {_plain('target')} AS pl, {_plain('name')} AS kp FROM s, k),
  g AS (SELECT target, name, CASE WHEN contains(ku, u) OR contains(u, ku) THEN 1 WHEN contains(kp, pl) OR contains(pl, kp) THEN 2 WHEN len(list_intersect({_long('pl')}, {_long('kp')})) >= 2 AND len(list_intersect({_long('pl')}, {_long('kp')})) * 2 >= len({_long('pl')}) THEN 3 END AS way, len(list_intersect({_long('pl')}, {_long('kp')})) AS shared, place FROM p),
  b AS (SELECT target, name FROM g WHERE way IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY way, CASE WHEN way = 3 THEN -shared ELSE 0 END, place) = 1) SELECT s.target, b.name AS section FROM s LEFT JOIN b ON b.target = s.target""")
def nearest_sections(spark, sf_dir):
    """Four ways to find a report's section: held, held without signs, most words shared, none."""
    known = spark.createDataFrame(list(enumerate(KNOWN)), "place int, name string")
    return review.nearest_section(spec(spark, sf_dir).where("line <> ''").select(F.col("line").alias("target")).distinct(), known)


# ---------------------------------------------------------------- rules of template and guide
TEMPLATE = (
    "WARNING", "PURPOSE", "<<Tell the goal of the part in a few words here>>", "The <component name> opens.", "SCOPE", "Figure 3 shows it", "USE CASE XXX", "REF-PSP-AIRBAG-001", "STANDARDS", "<<List the standards that apply>>", "scope of it", "SCOPE",
    "FUNCTIONAL REQUIREMENTS", "GEN-XXX", "ARCHITECTURES", "RAMS (v1)", "TABLE (1)", "12 PARTS", "REFERENCE DOCUMENTS", "<<first>> and <<second part>>",
)
GUIDE = (
    "1 GENERAL RULES", "R01: les exigences sont rédigées en français ici", "R01: the requirement shall be written in this very document", "R02 : couleurs interdites dans le document", "R02: no colors", "2. CONTENT", "R03 short", "P01: chaque service est décrit",
    "P01: each service is described by the system that must give it", "R22\tTable of rules\t12", "R22: the requirements are presented as a table of three columns", "MISSION PROFILE", "Lifetime and safety are told", "R05: Titel",
)
_lines = lambda xs: ", ".join(f"({k}, {quoted(x)})" for k, x in enumerate(xs))


def lines_of(spark, xs):
    return spark.createDataFrame([(0, k, x) for k, x in enumerate(xs)], "doc_id int, line_no int, line string")


_sub, _meta = listed(catalogue_rules.SUBSECTIONS), listed(catalogue_rules.META_LINES)
PLAN = rf"""WITH l AS (SELECT * FROM (VALUES {_lines(TEMPLATE)}) AS t(line_no, line)), c AS (SELECT *, regexp_replace(trim(regexp_extract(trim(line), {quoted(catalogue_rules.CAPS)}, 1)), ':+$', '') AS name FROM l),
  s AS (SELECT name, min(line_no) AS line_no FROM c WHERE length(name) >= 3 AND length(trim(line)) <= 120 AND trim(line) NOT IN {_meta} AND name NOT IN {_meta} AND NOT starts_with(lower(line), 'figure') AND NOT {found('name', catalogue_rules.EXAMPLE)} GROUP BY name),
  o AS (SELECT name, line_no, CASE WHEN name IN {_sub} THEN 2 ELSE 1 END AS level FROM s)"""


@query(f"{PLAN} SELECT name, line_no, level, (sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (ORDER BY line_no) - CASE WHEN level = 1 THEN 1 ELSE 0 END)::INT AS place FROM o")
def template_sections(spark, sf_dir):
    """The standard plan of a template: sections with level and place."""
    return catalogue_rules.template_sections(lines_of(spark, TEMPLATE)).select("name", "line_no", "level", "place")


@query(rf"""{PLAN}, m AS (SELECT l.line_no, l.line, last_value(o.name IGNORE NULLS) OVER (ORDER BY l.line_no) AS section FROM l LEFT JOIN o ON o.name = trim(l.line) AND length(trim(l.line)) < 100)
  SELECT line_no, coalesce(section, '') AS section, unnest(list_concat(regexp_extract_all(line, '<<[^>]*>>'), regexp_extract_all(line, {quoted(rules.VARIABLE)}))) AS placeholder, left(trim(line), 200) AS instruction FROM m""")
def template_instructions(spark, sf_dir):
    d = lines_of(spark, TEMPLATE)
    return catalogue_rules.template_instructions(d, catalogue_rules.template_sections(d)).select("line_no", "section", "placeholder", "instruction")


_count = lambda words, c: " + ".join(f"CAST(contains(lower({c}), {quoted(w)}) AS INT)" for w in words)


def _better(kind: str) -> str:
    en, fr = catalogue_rules.LANGUAGES[kind]
    return f"({_count(en, 'x.text')}) > ({_count(fr, 'x.text')}) AND length(x.text) >= length(acc.text)"


@query(rf"""WITH l AS (SELECT line_no, trim(line, ' ') AS s FROM (VALUES {_lines(GUIDE)}) AS t(line_no, line)), h AS (SELECT *, CASE WHEN length(s) < 100 THEN coalesce(nullif(regexp_extract(s, {quoted(catalogue_rules.GUIDE_NUMBERED)}, 1), ''), nullif(regexp_extract(s, {quoted(catalogue_rules.GUIDE_CAPS)}, 1), '')) END AS head FROM l),
  r AS (SELECT line_no, s, regexp_replace(trim(coalesce(last_value(head IGNORE NULLS) OVER (ORDER BY line_no), '')), ':+$', '') AS section, regexp_extract(s, {quoted(catalogue_rules.RULE)}, 1) AS rule_id, trim(regexp_extract(s, {quoted(catalogue_rules.RULE)}, 2)) AS text FROM h),
  k AS (SELECT * FROM r WHERE rule_id <> '' AND length(text) >= 10 AND NOT regexp_matches(s, '\t\d+$')),
  g AS (SELECT rule_id, list({{'line_no': line_no, 'section': section, 'text': text}} ORDER BY line_no) AS xs FROM k GROUP BY rule_id),
  f AS (SELECT rule_id, list_reduce(xs, lambda acc, x: CASE WHEN starts_with(rule_id, 'R') THEN CASE WHEN {_better('R')} THEN x ELSE acc END ELSE CASE WHEN {_better('P')} THEN x ELSE acc END END) AS b FROM g)
  SELECT rule_id, CASE WHEN starts_with(rule_id, 'R') THEN 'rule' ELSE 'principle' END AS category, b.section AS section, b.text AS text, b.line_no AS line_no FROM f""")
def guide_rules(spark, sf_dir):
    """Rules of a bilingual guide: the first of each number, or a later English one that is no shorter."""
    return catalogue_rules.guide_rules(lines_of(spark, GUIDE)).select("rule_id", "category", "section", "text", "line_no")


@query(f"SELECT name FROM (VALUES {_lines(catalogue_rules.RECOMMENDED)}) AS t(k, name) WHERE contains({quoted(chr(10).join(GUIDE).lower())}, lower(name))")
def recommended_sections(spark, sf_dir):
    return catalogue_rules.recommended(lines_of(spark, GUIDE)).select("name")


# ---------------------------------------------------------------- standards and images
STANDARDS = [("STA20", "Doors", "PUBLISHED", False), ("STA201", "More doors", "DRAFT", False), ("N41", "Noise", "Approved", True), ("N4", "Old noise", "ARCHIVED", False), ("ISO_26262", "Safety", "in_review", False)]
WANTED = ("sta20", "N4", "N41", "STA2", "XYZ", "ISO_26262", "N")


@query(f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{c}', '{t}', '{st}', {x})" for k, (c, t, st, x) in enumerate(STANDARDS))}) AS t(k, code, title, state, cancelled)), w AS (SELECT * FROM (VALUES {', '.join(f"('{c}')" for c in WANTED)}) AS t(code)),
  b AS (SELECT w.code, s.title, s.state, s.cancelled FROM w JOIN s ON starts_with(upper(s.code), upper(w.code)) QUALIFY row_number() OVER (PARTITION BY w.code ORDER BY upper(s.code) <> upper(w.code), s.k) = 1),
  z AS (SELECT w.code, b.title IS NOT NULL AS found, CASE WHEN b.title IS NULL THEN 'unknown' WHEN cancelled THEN 'cancelled' WHEN upper(state) IN ('DRAFT', 'DRAFTING', 'IN_REVIEW') THEN 'draft' WHEN upper(state) IN ('PUBLISHED', 'PUBLIÉ', 'APPROVED') THEN 'active' ELSE 'unknown_status' END AS status, b.title FROM w LEFT JOIN b ON b.code = w.code)
  SELECT *, row_number() OVER (ORDER BY NOT found, code)::INT AS place FROM z""")
def resolved_standards(spark, sf_dir):
    """Codes against the catalogue of standards: the exact one first, found ones before others."""
    known = spark.createDataFrame([(k, *x) for k, x in enumerate(STANDARDS)], "k int, code string, title string, state string, cancelled boolean")
    return standards.resolved(spark.createDataFrame([(c,) for c in WANTED], "code string"), known)


IMAGES = [("a", "SCOPE", "Contextual overview diagram", 900), ("a", "STATES", "mode diagram", 500), ("a", "STATES", "the physical connection diagram", 700), ("a", "X", "functional block diagram", 100), ("a", "X", "input signal diagram", 50), ("a", "X", "Fig. 3", 60), ("b", "Y", "flowchart", 10), ("b", "Y", "nothing", 20)]


@query(f"""WITH i AS (SELECT * FROM (VALUES {', '.join(f"('{d}', '{s}', '{n}', {b})" for d, s, n, b in IMAGES)}) AS t(doc_id, section, nearby, n_bytes)),
  k AS (SELECT *, {standards.sql_kind('nearby')} AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY n_bytes DESC) AS k FROM i)
  SELECT doc_id, count(*) AS images, array_to_string(list_sort(list_distinct(list(section))), ', ') AS sections, array_to_string(list_sort(list_distinct(list(kind))), ', ') AS kinds FROM k WHERE k <= 5 GROUP BY doc_id""")
def image_summary(spark, sf_dir):
    """The five largest images of a document by kind and section."""
    d = spark.createDataFrame(IMAGES, "doc_id string, section string, nearby string, n_bytes long")
    s = standards.image_summary(standards.largest_images(standards.image_kinds(d)))
    return s.select("doc_id", "images", F.array_join("sections", ", ").alias("sections"), F.array_join("kinds", ", ").alias("kinds"))


# ---------------------------------------------------------------- arithmetic and names
NUMBERS = "SELECT o_orderkey AS key, CAST(o_orderkey % 5 AS INT) AS errors, CAST(o_custkey % 7 AS INT) AS warnings, CAST(o_orderkey % 60 AS INT) AS no_id, (o_custkey % 101) / 100.0::DOUBLE AS rubric, (o_orderkey % 97) / 96.0::DOUBLE AS model FROM orders"
_axis = "CASE WHEN abs(model - rubric) < 0.15::DOUBLE THEN {r} ELSE 0.4::DOUBLE * rubric + 0.6::DOUBLE * model END"


@query(f"""WITH n AS ({NUMBERS}), a AS (SELECT *, CASE WHEN errors + warnings = 0 THEN 0.5::DOUBLE ELSE greatest(0.1::DOUBLE, 0.7::DOUBLE - 0.15::DOUBLE * errors - 0.05::DOUBLE * warnings) END AS fitness, {_axis.format(r='rubric')} AS blend FROM n),
  b AS (SELECT *, {sql_round('(rubric * 0.15::DOUBLE + blend * 0.25::DOUBLE + model * 0.40::DOUBLE + rubric * 0.10::DOUBLE + fitness * 0.10::DOUBLE) / (0.15::DOUBLE + 0.25::DOUBLE + 0.40::DOUBLE + 0.10::DOUBLE + 0.10::DOUBLE)')} AS raw FROM a)
  SELECT key, CAST(floor(fitness * 1e6 + 0.5) AS BIGINT) AS fitness, CAST(floor(blend * 1e6 + 0.5) AS BIGINT) AS blend, CASE WHEN no_id > 50 AND raw > 0.20 THEN 0.20::DOUBLE ELSE raw END AS overall,
    CASE WHEN no_id > 50 THEN 'NON_COMPLIANT' WHEN no_id > 30 THEN 'NOT_RELIABLE' WHEN no_id > 15 THEN 'ACCEPTABLE_WITH_FIXES' ELSE 'GOOD' END AS verdict, CASE WHEN errors = 4 THEN 'not_found' WHEN model >= 0.78::DOUBLE THEN 'high' WHEN model >= 0.60::DOUBLE THEN 'medium' ELSE 'low' END AS confidence FROM b""")
def review_arithmetic(spark, sf_dir):
    """Fitness, blend with a model's score, capped overall score, verdict by missing identifiers, confidence of an answer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("key"), (k % 5).alias("errors"), (c % 7).alias("warnings"), (k % 60).alias("no_id"), ((c % 101) / 100.0).alias("rubric"), ((k % 97) / 96.0).alias("model"))
    d = n.withColumns({"fitness": scoring.fitness(F.col("errors"), F.col("warnings"), F.col("errors") + F.col("warnings")), "blend": scoring.blended(F.col("model"), F.col("rubric"))})
    overall = scoring.review_overall([F.col(x) for x in ("rubric", "blend", "model", "rubric", "fitness")], F.col("no_id"))
    millionths = lambda x: F.floor(F.col(x) * 1e6 + 0.5).alias(x)
    return d.select("key", millionths("fitness"), millionths("blend"), overall.alias("overall"), scoring.verdict_override(F.col("no_id"), F.lit("GOOD")).alias("verdict"), scoring.ask_confidence(F.col("model"), F.col("errors") == 4).alias("confidence"))


@query(rf"""WITH n AS (SELECT s_suppkey AS key, s_name || ' > ' || s_nationkey || ' > ' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN ':' ELSE '' END AS x FROM supplier)
  SELECT key, regexp_replace(x, '[^A-Za-z0-9._\- ]', '_', 'g') AS safe_name, regexp_replace(x, '[^A-Za-z0-9_\-=]', '_', 'g') AS document_key, CASE WHEN regexp_matches(lower(x), 'template|guide|writing') THEN 'reference' ELSE 'uploaded' END AS source_type,
    '[' || regexp_split_to_array(x, '\s*>\s*')[1] || '] > ' || regexp_split_to_array(x, '\s*>\s*')[3] AS compact, {_plain('x')} AS plain, regexp_matches(x, '\.{{3,}}\s*\d+\s*$') OR regexp_matches(x, '^\s*\d+\s*$') AS contents_line, least((key % 30) / 10.0::DOUBLE, 1.0::DOUBLE) AS score,
    CASE WHEN regexp_replace(x, '[\[\]:*?/\\]', '', 'g') = '' THEN 'Sheet' ELSE left(regexp_replace(x, '[\[\]:*?/\\]', '', 'g'), 31) END AS sheet_name FROM n""")
def name_functions(spark, sf_dir):
    """Names of files, keys, sheets and sections, and scores of a remote search within 0 and 1."""
    d = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x = F.concat(F.concat_ws(" > ", "s_name", F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")), F.when(F.col("s_suppkey") % 3 == 0, ":").otherwise(""))
    d = d.select(F.col("s_suppkey").alias("key"), x.alias("x"))
    c = F.col("x")
    return d.select("key", T.safe_name(c).alias("safe_name"), T.document_key(c).alias("document_key"), T.source_type(c).alias("source_type"), T.compact_section(c).alias("compact"), review.plain_name(c).alias("plain"),
        T.is_toc_line(c).alias("contents_line"), T.search_score((F.col("key") % 30).cast("double")).alias("score"), T.sheet_name(c).alias("sheet_name"))

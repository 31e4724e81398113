"""Queries of the evidence checks; their oracles take documents apart with joins and windows instead of arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import lexicon
from specforge.fixtures import cte, fixture
from specforge.operators import evidence, lines, reports, rules
from specforge.plans.document_queries import SQL_HEADING, strip_sql
from specforge.plans.registry import found, listed, quoted, registry, times

QUERIES, ORACLES, query = registry()
#: Of the template: a sentence that should have been deleted.
INSTRUCTIONS = ("delete this sentence of the template before you submit the document",)
KNOWN = ("P01", "P02", "P03", "P05", "R01", "R02", "R05", "R16", "R17", "R18", "R28", "R52")
G = cte("fx_guide_lines")
LOW_META = listed(evidence.META)
SPLIT = lambda c: f"list_distinct(string_split(lower(trim({c})), ' '))"


def values(name: str, columns: str, rows) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(rows)}) AS t({columns}))"


def fitting(required: str, section: str, n_words: str = "rn") -> str:
    """SQL of: a section meets a required one; rw and fw are their words."""
    low = f"lower(trim({section}))"
    return f"""({low} = lower({required}) OR ({low} NOT IN {LOW_META} AND CASE WHEN {n_words} <= 2 THEN contains({low}, lower({required})) AND len({SPLIT(section)}) <= {n_words} + 1
    ELSE len(list_intersect({SPLIT(section)}, {SPLIT(required)})) * 10 >= 6 * {n_words} END))"""


_parts = values("parts", "part, word", [f"({quoted(k)}, {quoted(w.lower())})" for k, w in evidence.PARTS.items()])
_asked = values("asked", "col, required", [f"({quoted(k)}, {quoted(w)})" for k, w in evidence.ASKED.items()])
SUM = lambda test: f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"
BASE = rf"""{G}, hd AS (SELECT *, {SQL_HEADING} AS heading FROM (SELECT *, {strip_sql('line')} AS s FROM fx_guide_lines)),
  sec AS (SELECT doc_id, heading AS section, min(line_no) AS line_no FROM hd WHERE heading IS NOT NULL GROUP BY doc_id, heading),
  ord AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM sec),
  ln AS (SELECT *, contains(line, '|') AS bar, CAST(regexp_matches(line, '^\s*\[[A-Z0-9_]{{1,15}}\]\s*\|[^|\n]*\|') AS INT) AS decl, {found('line', rules.SHALL)} AND length({strip_sql('line')}) > 20 AS own FROM fx_guide_lines),
  lr AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, bar ORDER BY line_no) AS run FROM ln),
  ld AS (SELECT *, bar AND sum(decl) OVER (PARTITION BY doc_id, bar, run) >= 2 AS declared FROM lr),
  d0 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, max(line_no) + 1 AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (declared), '') AS declared,
    coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT declared), '') AS body FROM ld GROUP BY doc_id),
  {_parts}, hit AS (SELECT o.doc_id, part, k, line_no, nxt, contains(lower(section), word) AS hit FROM ord o, parts),
  run1 AS (SELECT doc_id, part, min(k) FILTER (hit) AS a FROM hit GROUP BY doc_id, part),
  run2 AS (SELECT h.doc_id, h.part, a, coalesce(min(k) FILTER (k > a AND NOT hit), max(k) + 1) AS b FROM hit h JOIN run1 r ON h.doc_id = r.doc_id AND h.part = r.part WHERE a IS NOT NULL GROUP BY h.doc_id, h.part, a),
  cut AS (SELECT r.doc_id, r.part, o.line_no AS t0, coalesce(o.nxt, d0.n_lines) AS t1 FROM run2 r JOIN ord o ON o.doc_id = r.doc_id AND o.k = r.b - 1 JOIN d0 ON d0.doc_id = r.doc_id),
  ptext AS (SELECT c.doc_id, c.part, string_agg(line, chr(10) ORDER BY line_no) AS x FROM cut c JOIN fx_guide_lines l ON l.doc_id = c.doc_id AND line_no >= t0 AND line_no < t1 GROUP BY c.doc_id, c.part),
  pv AS (SELECT doc_id, {', '.join(f"coalesce(max(x) FILTER (part = '{k}'), '') AS {k}" for k in evidence.PARTS)} FROM ptext GROUP BY doc_id),
  sc0 AS (SELECT o.*, {fitting("'SCOPE'", 'section', '1')} AS hit FROM ord o), sc1 AS (SELECT doc_id, min(k) FILTER (hit) AS a FROM sc0 GROUP BY doc_id),
  sc2 AS (SELECT s.doc_id, min(line_no) FILTER (k = a) AS t0, min(line_no) FILTER (k > a AND NOT hit) AS t1 FROM sc0 s JOIN sc1 ON sc1.doc_id = s.doc_id WHERE a IS NOT NULL GROUP BY s.doc_id),
  scope AS (SELECT s.doc_id, sum({times('line', rules.SHALL)}) AS scope_shall FROM sc2 s JOIN fx_guide_lines l ON l.doc_id = s.doc_id AND line_no >= t0 AND (t1 IS NULL OR line_no < t1) GROUP BY s.doc_id),
  {_asked}, av AS (SELECT doc_id, {', '.join(f"bool_or(col = '{k}' AND ok) AS sec_{k}" for k in evidence.ASKED)} FROM (SELECT o.doc_id, col, {fitting('required', 'section')} AS ok FROM ord o, (SELECT *, len({SPLIT('required')}) AS rn FROM asked)) GROUP BY doc_id),
  dd AS (SELECT d0.*, lower(text) AS low, {', '.join(f"coalesce({k}, '') AS {k}" for k in evidence.PARTS)}, {', '.join(f"coalesce(sec_{k}, false) AS sec_{k}" for k in evidence.ASKED)}, coalesce(scope_shall, 0) AS scope_shall
    FROM d0 LEFT JOIN pv ON pv.doc_id = d0.doc_id LEFT JOIN av ON av.doc_id = d0.doc_id LEFT JOIN scope ON scope.doc_id = d0.doc_id)"""


def _searched(name: str) -> str:
    at, p = evidence.SEARCHED[name]
    where = {"text": "text", "exact": "text", "low": "low", "cited": "lower(reference_part || chr(10) || applicable_part)"}.get(at, at)
    return f"{found(where, ('(?i)' if at == 'text' else '') + p)} AS {name}"


FLAGS = f"""{BASE}, lit AS (SELECT doc_id, count(*) AS literal_lines FROM ln WHERE own AND {found('line', evidence.LITERAL)} GROUP BY doc_id),
  fl AS MATERIALIZED (SELECT dd.*, {', '.join(_searched(k) for k in evidence.SEARCHED)}, {times('text', rules.SHALL)} AS shall, {times('low', evidence.ENGLISH)} AS english, {times('low', evidence.FRENCH)} AS french, coalesce(literal_lines, 0) AS literal_lines
    FROM dd LEFT JOIN lit ON lit.doc_id = dd.doc_id),
  gf AS ({' UNION ALL '.join(f"SELECT doc_id, {8 if c == 'H' else 9} AS check_seq, '{evidence.CHECKS[7 if c == 'H' else 8]}' AS check_id, '{s}' AS severity, '{sec}' AS section, '{r}' AS rule_id, 1::BIGINT AS n FROM fl WHERE {when}" for c, r, sec, s, when in evidence.GUIDE_RULES)})"""

_need = values("need", "required, place, mandatory", [f"({quoted(r)}, {k}, true)" for k, r in enumerate(lexicon.MANDATORY_SECTIONS)] + [f"({quoted(r)}, {k}, false)" for k, r in enumerate(lexicon.RECOMMENDED_SECTIONS)])
_mark = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, {quoted(evidence.MARK)}, 1), lambda x: upper(x)))"
_near = lambda test, src: f"(SELECT doc_id, count(*) AS n FROM (SELECT *, string_agg(line, ' ') OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS ctx FROM ln) WHERE own AND {test('ctx')} GROUP BY doc_id) {src}"
_traced = lambda c: f"({found(c, rules.TRACE[0])} OR {found(c, rules.TRACE[1])})"
_sev = lambda seq, sev, sec, rule, n, src: f"SELECT doc_id, {seq} AS check_seq, '{evidence.CHECKS[seq - 1]}' AS check_id, {sev} AS severity, {sec} AS section, {rule} AS rule_id, ({n})::BIGINT AS n FROM {src}"
ALL = rf"""{FLAGS}, {_need}, pr AS (SELECT o.doc_id, required, mandatory, section, k, lower(trim(section)) = lower(required) AS same, rn, len(list_intersect({SPLIT('section')}, {SPLIT('required')})) AS g
    FROM ord o, (SELECT *, len({SPLIT('required')}) AS rn FROM need) WHERE {fitting('required', 'section')}),
  best AS (SELECT doc_id, required, mandatory, section FROM pr QUALIFY row_number() OVER (PARTITION BY doc_id, required, mandatory ORDER BY CASE WHEN rn > 2 THEN NOT same ELSE false END, CASE WHEN rn > 2 THEN -g ELSE 0 END, k) = 1),
  cover AS (SELECT d0.doc_id, n.required, n.mandatory, b.section FROM d0 CROSS JOIN need n LEFT JOIN best b ON b.doc_id = d0.doc_id AND b.required = n.required AND b.mandatory = n.mandatory),
  lk AS (SELECT o.doc_id, section, line_no, place, lower(section) = lower(required) AS same, len(list_intersect({SPLIT('section')}, {SPLIT('required')})) / len(list_distinct(list_concat({SPLIT('section')}, {SPLIT('required')}))) AS likeness
    FROM ord o, need WHERE mandatory AND lower(section) NOT IN {LOW_META}),
  pl AS (SELECT * FROM lk WHERE same OR likeness >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY same DESC, likeness DESC, place) = 1),
  late AS (SELECT *, max(place) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pl),
  late5 AS (SELECT * FROM late WHERE top - place >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 5),
  residue AS (SELECT doc_id, {times('text', rules.PLACEHOLDER)} AS a, {times('text', rules.VARIABLE)} AS b, {times('text', rules.TBD)} AS c,
    {' + '.join(f"CASE WHEN contains(lower(regexp_replace(regexp_replace(text, '<<[^>]*>>', ' ', 'g'), '{chr(92)}s+', ' ', 'g')), {quoted(i)}) THEN 1 ELSE 0 END" for i in INSTRUCTIONS)} AS e FROM d0),
  res AS (SELECT doc_id, unnest([a, b, c, e]) AS n FROM residue),
  rq AS (SELECT doc_id, count(*) FILTER (own) AS n_own, count(*) FILTER (len(regexp_extract_all(line, '\|')) >= 2) AS tabled, count(*) FILTER ({found('line', rules.SHALL)} AND {found('line', rules.SUBJECTIVE)}) AS subjective,
    count(*) FILTER (own AND {_traced('line')}) AS inline, sum({times('line', r'(?i)' + chr(92) + 'bshould' + chr(92) + 'b')}) AS should, sum({times('line', r'(?i)' + chr(92) + 'bmay' + chr(92) + 'b')}) AS may FROM ln GROUP BY doc_id),
  ids AS (SELECT doc_id, count(DISTINCT id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(line, {quoted(rules.REQUIREMENT_ID)})) AS id FROM ln) GROUP BY doc_id),
  rr AS (SELECT rq.*, fl.shall, coalesce(ids.n, 0) AS ids, coalesce(w.n, 0) AS with_id, CASE WHEN inline > 0 THEN inline ELSE coalesce(t.n, 0) END AS traced FROM rq JOIN fl ON fl.doc_id = rq.doc_id LEFT JOIN ids ON ids.doc_id = rq.doc_id
    LEFT JOIN {_near(lambda c: found(c, rules.REQUIREMENT_ID), 'w')} ON w.doc_id = rq.doc_id LEFT JOIN {_near(_traced, 't')} ON t.doc_id = rq.doc_id),
  std0 AS (SELECT doc_id, declared || chr(10) || applicable_part || chr(10) || standards_part AS dt, CASE WHEN applicable_part <> '' THEN replace(body, applicable_part, '') ELSE body END AS b1, standards_part FROM dd),
  std AS (SELECT doc_id, {_mark('dt')} AS d, {_mark("CASE WHEN standards_part <> '' THEN replace(b1, standards_part, '') ELSE b1 END")} AS u FROM std0),
  stdp AS (SELECT doc_id, unnest(list_filter(d, lambda x: NOT list_contains(u, x))) AS m, 'APPLICABLE DOCUMENTS' AS section FROM std UNION ALL SELECT doc_id, unnest(list_filter(u, lambda x: NOT list_contains(d, x))), 'REQUIREMENTS' FROM std),
  ef AS MATERIALIZED ({_sev(1, "CASE WHEN section IS NULL THEN 'error' ELSE 'pass' END", 'coalesce(section, required)', "'TEMPLATE'", '1', 'cover WHERE mandatory')}
    UNION ALL {_sev(1, "'warning'", 'required', "'WRITING_GUIDE'", '1', 'cover WHERE NOT mandatory AND section IS NULL')}
    UNION ALL {_sev(2, "'warning'", 'section', "'P06'", '1', 'late5')} UNION ALL {_sev(2, "'pass'", "''", "'P06'", '1', 'd0 WHERE doc_id NOT IN (SELECT doc_id FROM late5)')}
    UNION ALL {_sev(3, "'warning'", "''", "'TEMPLATE'", 'n', 'res WHERE n > 0')} UNION ALL {_sev(3, "'pass'", "''", "'TEMPLATE'", '0', 'residue WHERE a + b + c + e = 0')}
    UNION ALL {_sev(4, "CASE WHEN tabled > 10 THEN 'pass' ELSE 'warning' END", "'REQUIREMENTS'", "'R22'", 'tabled', 'rr WHERE n_own > 0')}
    UNION ALL {_sev(5, "CASE WHEN shall > 0 THEN 'pass' ELSE 'error' END", "'REQUIREMENTS'", "'R23'", 'shall', 'rr')}
    UNION ALL {_sev(5, "'warning'", "'REQUIREMENTS'", "'R23'", 'subjective', 'rr WHERE shall > 0 AND subjective > 0')}
    UNION ALL {_sev(5, "'warning'", "'REQUIREMENTS'", "'R23'", 'should + may', 'rr WHERE shall = 0 AND (should > 5 OR may > 5)')}
    UNION ALL {_sev(6, "'pass'", "'REQUIREMENTS'", "'R20'", 'ids', 'rr WHERE n_own > 0 AND ids > 0')} UNION ALL {_sev(6, "'warning'", "'REQUIREMENTS'", "'R20'", '0', 'rr WHERE n_own > 0 AND ids = 0 AND with_id = 0')}
    UNION ALL {_sev(7, "CASE WHEN traced * 2 >= n_own THEN 'pass' ELSE 'warning' END", "'REQUIREMENTS'", "'R22'", 'traced', 'rr WHERE n_own > 0')}
    UNION ALL SELECT * FROM gf
    UNION ALL {_sev(10, "'warning'", 'section', "'R17:' || m", '1', 'stdp')} UNION ALL {_sev(10, "'info'", "'APPLICABLE DOCUMENTS'", "'R17'", '0', 'std WHERE len(d) = 0 AND len(u) = 0')}
    UNION ALL {_sev(10, "'pass'", "'APPLICABLE DOCUMENTS'", "'R17'", 'len(d)', 'std WHERE len(d) + len(u) > 0 AND doc_id NOT IN (SELECT doc_id FROM stdp)')})"""


def spec(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_guide_lines")


def all_findings(spark, sf_dir):
    return evidence.findings(spec(spark, sf_dir), instructions=INSTRUCTIONS)


@query(f"{FLAGS} SELECT doc_id, rule_id, severity, section FROM gf")
def guide_findings(spark, sf_dir):
    """Rules H and I: 42 rules with their outcome."""
    d = all_findings(spark, sf_dir).where("check_seq in (8, 9)")
    return d.select("doc_id", "rule_id", "severity", "section")


@query(f"{ALL} SELECT * FROM ef")
def evidence_findings(spark, sf_dir):
    return all_findings(spark, sf_dir)


@query(f"{ALL} SELECT doc_id, section, line_no, place::INT AS place FROM late WHERE top - place >= 3")
def section_order(spark, sf_dir):
    """Sections that come three places or more after a later one of the plan."""
    d = evidence.documents(spec(spark, sf_dir))
    return d.select("doc_id", F.inline(evidence.disordered(lexicon.MANDATORY_SECTIONS))).select("doc_id", "section", "line_no", "place")


@query(f"{ALL} SELECT doc_id, severity, section, rule_id, n FROM ef WHERE check_seq = 10")
def standards_consistency(spark, sf_dir):
    """Standards that are declared and not used, or used and not declared."""
    return all_findings(spark, sf_dir).where("check_seq = 10").select("doc_id", "severity", "section", "rule_id", "n")


_rule = "regexp_extract(rule_id, '^([RP][0-9]+)', 1)"


@query(f"""{ALL}, s AS (SELECT doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'pass') AS passes,
    list_distinct(list({_rule}) FILTER ({_rule} <> '')) AS seen FROM ef GROUP BY doc_id)
  SELECT doc_id, errors, warnings, infos, passes, len(seen)::INT AS rules_checked, array_to_string(list_filter({'[' + ', '.join(map(quoted, KNOWN)) + ']'}, lambda r: NOT list_contains(seen, r)), ',') AS unchecked FROM s""")
def evidence_summary(spark, sf_dir):
    """Findings by severity, and the known rules that no finding names."""
    return evidence.summary(all_findings(spark, sf_dir), KNOWN)


def sql_round(x: str) -> str:
    y = f"(({x}) * 100)"
    return f"(CASE WHEN {y} - floor{y} > 0.5 + 1e-9 THEN floor{y} + 1 WHEN {y} - floor{y} < 0.5 - 1e-9 THEN floor{y} ELSE floor{y} + CAST(floor{y} AS BIGINT) % 2 END / 100.0::DOUBLE)"


def sql_curve(r: str) -> str:
    return f"least(1.0::DOUBLE, CASE WHEN {r} >= 0.95::DOUBLE THEN 0.9::DOUBLE + ({r} - 0.95::DOUBLE) * 2 WHEN {r} >= 0.80::DOUBLE THEN 0.6::DOUBLE + ({r} - 0.80::DOUBLE) * 2 WHEN {r} >= 0.60::DOUBLE THEN 0.3::DOUBLE + ({r} - 0.60::DOUBLE) * 1.5::DOUBLE ELSE {r} * 0.5::DOUBLE END)"


def sql_tiers(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 1.0 WHEN {n} <= 2 THEN 0.85 WHEN {n} <= 5 THEN 0.70 WHEN {n} <= 15 THEN 0.50 WHEN {n} <= 40 THEN 0.35 ELSE 0.20 END::DOUBLE"


def sql_verdict(o: str, errors: str) -> str:
    return f"CASE WHEN {o} >= 0.80::DOUBLE AND {errors} = 0 THEN 'GOOD' WHEN {o} >= 0.60::DOUBLE AND {errors} <= 2 THEN 'ACCEPTABLE_WITH_FIXES' WHEN {o} >= 0.35::DOUBLE THEN 'NOT_RELIABLE' ELSE 'NON_COMPLIANT' END"


_c = lambda test, sev: f"count(*) FILTER ({test} AND severity = '{sev}')"
_own, _guide, _all = "check_seq BETWEEN 4 AND 7", "(check_seq IN (8, 9, 10) OR (check_seq = 1 AND rule_id = 'WRITING_GUIDE'))", len(lexicon.MANDATORY_SECTIONS)


@query(f"""{ALL}, k AS (SELECT doc_id, {_c('check_seq = 1', 'error')} AS missing, {_c('check_seq = 2', 'warning')} AS late, coalesce(sum(n) FILTER (check_seq = 3 AND severity = 'warning'), 0) AS residue,
    {_c(_own, 'pass')} AS rp, {_c(_own, 'warning')} AS rw, {_c(_own, 'error')} AS re, {_c(_guide, 'pass')} AS gp, {_c(_guide, 'info')} AS gi, {_c(_guide, 'warning')} AS gw, count(*) FILTER (severity = 'error') AS errors FROM ef GROUP BY doc_id),
  x AS (SELECT doc_id, errors, {sql_round(sql_curve(f'(({_all} - missing) / {_all}::DOUBLE)'))} AS structure, {sql_round('greatest(0.3::DOUBLE, 1 - 0.1::DOUBLE * late)')} AS section_order, {sql_round(sql_tiers('residue'))} AS cleanliness,
    {sql_round('CASE WHEN rp + rw + re = 0 THEN 0.1::DOUBLE ELSE (rp + 0.5::DOUBLE * rw) / (rp + rw + re) * CASE WHEN re > 0 THEN greatest(0.3::DOUBLE, 1 - 0.2::DOUBLE * re) ELSE 1.0::DOUBLE END END')} AS requirements,
    {sql_round('CASE WHEN gp + gi + gw = 0 THEN 0.5::DOUBLE ELSE (gp + 0.8::DOUBLE * gi + 0.4::DOUBLE * gw) / (gp + gi + gw) END')} AS writing_guide FROM k),
  o AS (SELECT *, structure * 0.25::DOUBLE + section_order * 0.05::DOUBLE + cleanliness * 0.10::DOUBLE + requirements * 0.35::DOUBLE + writing_guide * 0.25::DOUBLE AS raw FROM x)
  SELECT doc_id, errors, structure, section_order, cleanliness, requirements, writing_guide, {sql_round('raw')} AS overall, {sql_verdict('raw', 'errors')} AS verdict FROM o""")
def v2_scores(spark, sf_dir):
    """Five axes, the weighted score and the verdict of the evidence checks."""
    return evidence.scores(all_findings(spark, sf_dir))


# ---------------------------------------------------------------- first review
_worded = "(" + "|".join(lines.SECTION_WORDS_V1) + ")"
V1 = rf"""{G}, hd AS (SELECT *, CASE WHEN s = '' OR length(s) > 100 OR regexp_matches(s, '^\d+\.\s+[A-Z][a-z]') THEN NULL WHEN regexp_matches(s, {quoted(lines.CAPS_V1)}) THEN regexp_replace(s, ':+$', '')
    WHEN regexp_matches(s, '{lines.TITLE}') AND length(s) >= 3 AND regexp_matches(' ' || lower(s) || ' ', '\s{_worded}\s') THEN s
    WHEN regexp_matches(s, {quoted(lines.NUMBERED)}) THEN regexp_replace(s, '^\d+(\.\d+)*\.?\s+', '') WHEN regexp_matches(s, {quoted(lines.CONTENTS)}) THEN trim(regexp_extract(s, {quoted(lines.CONTENTS)}, 1)) END AS heading
    FROM (SELECT *, {strip_sql('line')} AS s FROM fx_guide_lines)),
  sec AS (SELECT doc_id, heading AS section, min(line_no) AS line_no FROM hd WHERE heading IS NOT NULL GROUP BY doc_id, heading)"""


@query(f"{V1} SELECT doc_id, section, line_no FROM sec")
def first_review_sections(spark, sf_dir):
    return lines.detected_sections(spec(spark, sf_dir), lines.first_review_heading)


_met = lambda req, sec: f"(contains(lower({sec}), lower({req})) OR contains(lower({req}), lower({sec})) OR len(list_intersect({SPLIT(sec)}, {SPLIT(req)})) * 10 >= 6 * len({SPLIT(req)}))"
_traced1 = lambda c: f"({found(c, reports.TRACE_V1[0])} OR {found(c, reports.TRACE_V1[1])})"
_n = len(lexicon.MANDATORY_SECTIONS)


@query(rf"""{V1}, {_need}, ln AS (SELECT *, {found('line', rules.SHALL)} AND length({strip_sql('line')}) > 20 AS own FROM fx_guide_lines),
  d0 AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text, count(*) FILTER (own) AS total, count(*) FILTER (own AND {found('line', rules.REQUIREMENT_ID)}) AS inline, count(*) FILTER (own AND {_traced1('line')}) AS traced FROM ln GROUP BY doc_id),
  cv AS (SELECT d0.doc_id, n.required, n.mandatory, bool_or({_met('n.required', 'sec.section')}) AS met FROM d0 CROSS JOIN need n LEFT JOIN sec ON sec.doc_id = d0.doc_id GROUP BY ALL),
  ms AS (SELECT doc_id, count(*) FILTER (mandatory AND NOT coalesce(met, false)) AS missing, count(*) FILTER (NOT mandatory AND NOT coalesce(met, false)) AS unrec FROM cv GROUP BY doc_id),
  ids AS (SELECT doc_id, count(DISTINCT id) AS ids FROM (SELECT doc_id, unnest(regexp_extract_all(line, {quoted(rules.REQUIREMENT_ID)})) AS id FROM ln) GROUP BY doc_id),
  sx AS (SELECT doc_id, bool_or(regexp_matches(lower(section), 'update|revision|history')) AS hist, bool_or({_met("'ACRONYMS'", 'section')}) AS acr FROM sec GROUP BY doc_id),
  x AS (SELECT d0.*, missing, unrec, coalesce(ids, 0) AS ids, coalesce(w.n, 0) AS nearby, {times('text', rules.PLACEHOLDER)} AS ph, {times('text', rules.TBD)} AS tb, {times('text', reports.VARIABLE_V1)} AS vr,
      NOT (coalesce(hist, false) OR regexp_matches(text, '(?i)table\s+of\s+updates|revision\s+history|update\s+history')) AS f0, NOT regexp_matches(text, '(?i)author|identification|RSP-\d+') AS f1,
      {times('text', rules.SHALL)} = 0 AND ({times('text', '(?i)' + chr(92) + 'bshould' + chr(92) + 'b')} > 5 OR {times('text', '(?i)' + chr(92) + 'bmay' + chr(92) + 'b')} > 5) AS f2,
      NOT regexp_matches(text, '(?i)figure\s+<?\d+|picture\s+\d+|table\s+\d+') AS f3, coalesce(acr, false) AND NOT regexp_matches(text, '[A-Z]{{2,}}\s*[:\-—]\s*[A-Z]') AS f4
    FROM d0 JOIN ms ON ms.doc_id = d0.doc_id LEFT JOIN ids ON ids.doc_id = d0.doc_id LEFT JOIN sx ON sx.doc_id = d0.doc_id LEFT JOIN {_near(lambda c: found(c, rules.REQUIREMENT_ID), 'w')} ON w.doc_id = d0.doc_id),
  y AS (SELECT *, CASE WHEN inline > 0 THEN inline WHEN ids > 0 AND nearby > 0 THEN nearby ELSE least(ids, total) END AS with_id, CAST(f0 AS INT) + CAST(f1 AS INT) + CAST(f2 AS INT) + CAST(f3 AS INT) + CAST(f4 AS INT) AS faults FROM x),
  z AS (SELECT doc_id, missing + CASE WHEN total = 0 THEN 1 ELSE 0 END AS errors, unrec + CAST(ph > 0 AS INT) + CAST(tb > 0 AS INT) + CAST(vr > 0 AS INT) + faults + CAST(total > 0 AND with_id = 0 AS INT) + CAST(total > 0 AND traced = 0 AS INT) AS warnings,
      CAST(total > 0 AS INT) AS infos, total, with_id, traced, {sql_round(sql_curve(f'(({_n} - missing) / {_n}::DOUBLE)'))} AS structure, {sql_round(sql_tiers('(ph + tb + vr)'))} AS cleanliness,
      {sql_round('CASE WHEN total = 0 THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, least(total / 20.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE + with_id / total * 0.3::DOUBLE + traced / total * 0.2::DOUBLE) END')} AS requirements,
      {sql_round('1.0::DOUBLE - (CASE WHEN f0 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN f1 THEN 0.1::DOUBLE ELSE 0::DOUBLE END + CASE WHEN f2 THEN 0.15::DOUBLE ELSE 0::DOUBLE END + CASE WHEN f3 THEN 0.05::DOUBLE ELSE 0::DOUBLE END + CASE WHEN f4 THEN 0.05::DOUBLE ELSE 0::DOUBLE END)')} AS writing_guide FROM y),
  o AS (SELECT *, {sql_round('structure * 0.35::DOUBLE + cleanliness * 0.15::DOUBLE + requirements * 0.30::DOUBLE + writing_guide * 0.20::DOUBLE')} AS overall FROM z)
  SELECT *, {sql_verdict('overall', 'errors')} AS verdict FROM o""")
def v1_report(spark, sf_dir):
    """First review: axes, score, verdict and counts of findings."""
    return reports.v1_report(spec(spark, sf_dir))

"""Queries over document lines, sections, rules, scores and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specforge import lexicon
from specforge.fixtures import cte, fixture
from specforge.functions import text as T
from specforge.operators import chunking, lines, reports, requirements, rules, scoring
from specforge.plans.registry import found, quoted, registry, times

QUERIES, ORACLES, query = registry()
S = cte("fx_spec_lines")


def documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spec(spark, sf_dir) -> DataFrame:
    return fixture(spark, sf_dir, "fx_spec_lines")


def strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


# ---------------------------------------------------------------- lines and sections
@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(translate(text, '''’', '  ')), '[a-zàâäéèêëïîôöùûüçñ0-9]+'))) AS n_tokens, len(regexp_extract_all(lower(translate(text, '''’', '  ')), '[a-zàâäéèêëïîôöùûüçñ0-9]+')) AS n_words FROM documents")
def tokenize_counts(spark, sf_dir):
    low = F.lower(F.translate(F.col("text"), "'’", "  "))
    words = F.regexp_extract_all(low, F.lit("([a-zàâäéèêëïîôöùûüçñ0-9]+)"), F.lit(1))
    return documents(spark, sf_dir).select("doc_id", F.size(T.tokenize(F.col("text"))).alias("n_tokens"), F.size(words).alias("n_words"))


DOC_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(f"{DOC_LINES} SELECT doc_id, line_no, line FROM l")
def document_lines(spark, sf_dir):
    return lines.document_lines(documents(spark, sf_dir))


@query(rf"""{DOC_LINES}, h AS (SELECT doc_id, lower(left({strip_sql('line')}, 80)) AS head FROM l)
  SELECT head, count(DISTINCT doc_id) AS documents, count(*) AS n FROM h WHERE length(head) >= 15 GROUP BY head HAVING count(DISTINCT doc_id) >= 2""")
def duplicate_lines(spark, sf_dir):
    return lines.duplicate_lines(lines.document_lines(documents(spark, sf_dir)))


WORDED = "(" + "|".join(lines.SECTION_WORDS) + ")"
SQL_HEADING = rf"""CASE WHEN s = '' OR length(s) > 120 OR regexp_matches(s, '^\d+\.\s+[A-Z][a-z]') THEN NULL
  WHEN regexp_matches(s, '^[A-Z][A-Z0-9\s/()\-&,:;.–—]{{2,}}$') THEN regexp_replace(s, ':+$', '')
  WHEN regexp_matches(s, '^[A-Z][A-Za-z]+(\s+([A-Z][A-Za-z]+|[a-z]+)){{0,5}}$') AND length(s) >= 3 AND regexp_matches(' ' || lower(s) || ' ', '\s{WORDED}\s') THEN s
  WHEN regexp_matches(s, '^\d+(\.\d+)*\.?\s+[A-Z][A-Za-z\s/()\-&,:;.]{{2,}}$') THEN regexp_replace(s, '^\d+(\.\d+)*\.?\s+', '') END"""
H = f"{S}, h AS (SELECT *, {SQL_HEADING} AS heading FROM (SELECT *, {strip_sql('line')} AS s FROM fx_spec_lines))"
SECTIONS = f"{H}, sec AS (SELECT doc_id, heading AS section, min(line_no) AS line_no FROM h WHERE heading IS NOT NULL GROUP BY doc_id, heading)"


@query(f"{SECTIONS} SELECT * FROM sec")
def detect_sections(spark, sf_dir):
    return lines.detected_sections(spec(spark, sf_dir))


@query(f"{H} SELECT doc_id, line_no, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h")
def section_carry_forward(spark, sf_dir):
    return lines.with_section(spec(spark, sf_dir)).select("doc_id", "line_no", "section")


@query(f"""{H}, f AS (SELECT * FROM (SELECT *, lag(heading) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM h WHERE heading IS NOT NULL) WHERE prev IS NULL OR prev <> heading),
  n AS (SELECT doc_id, max(line_no) + 1 AS n FROM fx_spec_lines GROUP BY doc_id)
  SELECT f.doc_id, heading AS section, line_no AS slice_begin, coalesce(lead(line_no) OVER (PARTITION BY f.doc_id ORDER BY line_no), n) AS slice_end FROM f JOIN n ON f.doc_id = n.doc_id""")
def section_slice_counts(spark, sf_dir):
    return lines.section_slices(spec(spark, sf_dir)).withColumnsRenamed({"begin": "slice_begin", "end": "slice_end"})


@query(rf"SELECT doc_id, CAST(greatest(1, length(text) // 2) AS INT) AS tokens, {found('text', '<<[^>]*>>')} OR ({found('text', '(?i)' + chr(92) + 'b(TBD|XXX|TODO)' + chr(92) + 'b')} AND length({strip_sql('text')}) < 50) AS instruction FROM documents")
def text_flags(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", T.estimated_tokens(t).alias("tokens"), T.is_template_instruction(t).alias("instruction"))


# ---------------------------------------------------------------- rules
TBD, XXX, PLACE, VAR = r"(?i)\b(TBD|TBC|TODO|XXX)\b", r"\bXXX\b", r"<<[^>]*>>", rules.VARIABLE


@query(f"{S} SELECT doc_id, sum({times('line', PLACE)})::BIGINT AS placeholders, sum({times('line', VAR)})::BIGINT AS variables, sum({times('line', TBD)})::BIGINT AS tbd, sum({times('line', XXX)})::BIGINT AS xxx FROM fx_spec_lines GROUP BY doc_id")
def placeholder_counts(spark, sf_dir):
    return rules.placeholder_counts(spec(spark, sf_dir))


SH, SUBJ = rules.SHALL, rules.SUBJECTIVE
IS_SHALL = f"({found('line', SH)} AND length({strip_sql('line')}) > 20)"
TRACED = f"({found('line', rules.TRACE[0])} OR {found('line', rules.TRACE[1])})"
SHOULD, MAY = r"(?i)\bshould\b", r"(?i)\bmay\b"


@query(f"""{S} SELECT doc_id, sum({times('line', SH)})::BIGINT AS shall, sum({times('line', SHOULD)})::BIGINT AS should, sum({times('line', MAY)})::BIGINT AS may,
  count(*) FILTER ({found('line', SH)} AND {found('line', SUBJ)}) AS subjective FROM fx_spec_lines GROUP BY doc_id""")
def req_language(spark, sf_dir):
    return rules.requirement_language(spec(spark, sf_dir))


@query(f"{S} SELECT doc_id, count(*) FILTER ({IS_SHALL}) AS shall_lines, count(*) FILTER (len(regexp_extract_all(line, '\\|')) >= 2) AS table_rows FROM fx_spec_lines GROUP BY doc_id")
def req_format(spark, sf_dir):
    return rules.requirement_format(spec(spark, sf_dir))


@query(f"""{S}, w AS (SELECT *, {IS_SHALL} AS own, max(CAST({found('line', rules.REQUIREMENT_ID)} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM fx_spec_lines),
  ids AS (SELECT doc_id, count(DISTINCT id) AS distinct_ids FROM (SELECT doc_id, unnest(regexp_extract_all(line, {quoted(rules.REQUIREMENT_ID)})) AS id FROM fx_spec_lines) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS shall_lines, count(*) FILTER (near = 1) AS with_id FROM w WHERE own GROUP BY doc_id)
  SELECT n.doc_id, shall_lines, with_id, distinct_ids FROM n LEFT JOIN ids ON n.doc_id = ids.doc_id""")
def req_id_context(spark, sf_dir):
    return rules.requirement_ids(spec(spark, sf_dir))


TRACE_SQL = f"""{S}, w AS (SELECT *, {IS_SHALL} AS own, {TRACED} AS hit, max(CAST({TRACED} AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS near FROM fx_spec_lines),
  n AS (SELECT doc_id, count(*) AS shall_lines, count(*) FILTER (hit) AS inline, count(*) FILTER (near = 1) AS near FROM w WHERE own GROUP BY doc_id),
  tr AS (SELECT *, CASE WHEN inline > 0 THEN inline ELSE near END AS traced, CASE WHEN inline > 0 THEN inline ELSE near END / shall_lines AS ratio FROM n)"""


@query(f"{TRACE_SQL} SELECT * FROM tr")
def traceability(spark, sf_dir):
    return rules.traceability(spec(spark, sf_dir))


WANTED = "wanted AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(n)}, {k})" for k, n in enumerate(lexicon.MANDATORY_SECTIONS)) + ") AS t(required, place))"
SPLIT = lambda c: f"list_distinct(string_split(lower(trim({c})), ' '))"
COVER = f"""{SECTIONS}, {WANTED}, p AS (SELECT doc_id, required, section, line_no, {SPLIT('required')} AS rw, {SPLIT('section')} AS fw, lower(required) AS rl, lower(trim(section)) AS fl FROM sec, wanted),
  g AS (SELECT *, CASE WHEN rl = fl THEN 2.0 WHEN len(rw) <= 2 AND contains(fl, rl) AND len(fw) <= len(rw) + 1 THEN 1.5
    WHEN len(rw) > 2 AND len(list_intersect(rw, fw)) / len(rw) >= 0.6 THEN len(list_intersect(rw, fw)) / len(rw) END AS grade FROM p),
  best AS (SELECT doc_id, required, section FROM g WHERE grade IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, required ORDER BY grade DESC, line_no) = 1),
  cover AS (SELECT d.doc_id, w.required, w.place, b.section FROM (SELECT DISTINCT doc_id FROM fx_spec_lines) d CROSS JOIN wanted w LEFT JOIN best b ON b.doc_id = d.doc_id AND b.required = w.required)"""


@query(f"{COVER} SELECT * FROM cover")
def section_coverage(spark, sf_dir):
    return rules.matched_sections(spec(spark, sf_dir), rules.catalogue(spark))


@query(f"{S}, v AS (" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{u}' AS unit, CAST(unnest(regexp_extract_all(line, {quoted(p)}, 1)) AS DOUBLE) AS value FROM fx_spec_lines" for u, p in rules.UNITS) + """)
  SELECT *, (unit = 'sound_level_db' AND value > 130) OR (unit = 'voltage_v' AND (value < 1 OR value > 48)) OR (unit = 'percentage' AND value > 100) AS suspicious FROM v""")
def physical_params(spark, sf_dir):
    return rules.physical_parameters(spec(spark, sf_dir))


@query(rf"{S} SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '\[([A-Z][A-Z0-9_-]+)\]', 1)) AS code FROM fx_spec_lines")
def standard_codes(spark, sf_dir):
    return rules.standard_codes(spec(spark, sf_dir))


@query(rf"{S} SELECT doc_id, count(*) FILTER ({IS_SHALL}) AS shall_lines, count(*) FILTER ({IS_SHALL} AND regexp_matches(lower(line), '\b(when|if|while|during|upon)\b')) AS conditioned FROM fx_spec_lines GROUP BY doc_id")
def req_patterns(spark, sf_dir):
    return rules.requirement_patterns(spec(spark, sf_dir))


# ---------------------------------------------------------------- scores
def tiers(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 1.0 WHEN {n} <= 2 THEN 0.85 WHEN {n} <= 5 THEN 0.70 WHEN {n} <= 15 THEN 0.50 WHEN {n} <= 40 THEN 0.35 ELSE 0.20 END::DOUBLE"


@query(f"{S}, c AS (SELECT doc_id, sum({times('line', PLACE)} + {times('line', TBD)})::BIGINT AS residue FROM fx_spec_lines GROUP BY doc_id) SELECT doc_id, residue, {tiers('residue')} AS score FROM c")
def cleanliness_tier(spark, sf_dir):
    c = rules.placeholder_counts(spec(spark, sf_dir)).withColumn("residue", F.col("placeholders") + F.col("tbd"))
    return c.select("doc_id", "residue", scoring.cleanliness(F.col("residue")).alias("score"))


@query(f"""{COVER}, r AS (SELECT doc_id, count(section) AS met, count(*) AS sections, count(section)::DOUBLE / count(*) AS ratio FROM cover GROUP BY doc_id)
  SELECT doc_id, met, sections, least(1.0::DOUBLE, CASE WHEN ratio >= 0.95::DOUBLE THEN 0.9::DOUBLE + (ratio - 0.95::DOUBLE) * 2 WHEN ratio >= 0.80::DOUBLE THEN 0.6::DOUBLE + (ratio - 0.80::DOUBLE) * 2
    WHEN ratio >= 0.60::DOUBLE THEN 0.3::DOUBLE + (ratio - 0.60::DOUBLE) * 1.5::DOUBLE ELSE ratio * 0.5::DOUBLE END) AS score FROM r""")
def structure_curve(spark, sf_dir):
    m = rules.matched_sections(spec(spark, sf_dir), rules.catalogue(spark)).groupBy("doc_id").agg(F.count("section").alias("met"), F.count("*").alias("sections"))
    return m.withColumn("score", scoring.structure_curve(F.col("met") / F.col("sections")))


@query(f"""{TRACE_SQL} SELECT doc_id, shall_lines, traced, CASE WHEN shall_lines = 0 THEN 0.5 WHEN ratio >= 0.9 THEN 0.9 WHEN ratio >= 0.7 THEN 0.7 WHEN ratio >= 0.5 THEN 0.5 WHEN ratio >= 0.25 THEN 0.3 ELSE 0.1 END::DOUBLE AS score FROM tr""")
def rubric_traceability(spark, sf_dir):
    t = rules.traceability(spec(spark, sf_dir))
    return t.select("doc_id", "shall_lines", "traced", scoring.traceability_rubric(F.col("ratio"), F.col("shall_lines")).alias("score"))


# ---------------------------------------------------------------- chunks
BLOCKS = rf"""WITH RECURSIVE bl AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS b FROM documents),
  b AS (SELECT doc_id, unnest(b) AS text, generate_subscripts(b, 1) - 1 AS i FROM bl)"""
TOK = lambda c: f"greatest(1, length({c}) // 2)"


def folded(blocks: str, flush: str, first: str, weight, size: str = "text") -> str:
    """Recursive fold over blocks b (doc_id, i, text): `flush` tells, of state f and block b, whether b begins a chunk."""
    w = weight(f"b.{size}")
    return f"""{blocks}, f AS (SELECT doc_id, i, 0 AS chunk_id, 1 AS n, {weight(size)} AS size FROM b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.i, f.chunk_id + CASE WHEN {flush} THEN 1 ELSE 0 END, CASE WHEN {flush} THEN 1 ELSE f.n + 1 END, CASE WHEN {flush} THEN {w} ELSE f.size + {w} END
  FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1)
  SELECT f.doc_id, f.chunk_id, string_agg(b.{first}, ' ' ORDER BY b.i) AS text FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i GROUP BY f.doc_id, f.chunk_id"""


@query(folded(BLOCKS, f"(f.n >= 5 OR f.size + {TOK('b.text')} > 6000)", "text", TOK))
def chunk_paragraphs(spark, sf_dir):
    """Both flush rules: five paragraphs, or 6000 tokens."""
    return chunking.by_paragraphs(documents(spark, sf_dir)).select("doc_id", "chunk_id", "text")


@query(folded(BLOCKS, f"(f.n >= 5 OR f.size + {TOK('b.text')} > 400)", "text", TOK))
def chunk_paragraphs_capped(spark, sf_dir):
    """As above with a limit that binds often."""
    return chunking.by_paragraphs(documents(spark, sf_dir), max_tokens=400).select("doc_id", "chunk_id", "text")


UPPER = r"length(regexp_replace(b.text, '[^\p{Lu}]', '', 'g')) / greatest(1, length(regexp_replace(b.text, '[^\p{L}]', '', 'g')))"
HEADED = f"(regexp_matches(b.text, {quoted(chunking.HEADINGS)}) OR (length(b.text) BETWEEN 4 AND 80 AND {UPPER} > 0.7))"


@query(folded(BLOCKS, f"({HEADED} OR f.size + {TOK('b.text')} > 6000)", "text", TOK))
def chunk_sections(spark, sf_dir):
    return chunking.by_sections(documents(spark, sf_dir)).select("doc_id", "chunk_id", "text")


GL = cte("fx_guide_lines").replace("WITH ", "WITH RECURSIVE ", 1)
MARKED = rf"""{GL}, m0 AS (SELECT doc_id, line_no, {strip_sql('line')} AS t, CASE WHEN regexp_matches({strip_sql('line')}, '^[A-Z][A-Z\s]{{2,}}$') THEN 1 WHEN regexp_matches({strip_sql('line')}, '^\d+\.\d+\s+[A-Z]') THEN 2
    WHEN regexp_matches({strip_sql('line')}, '^\d+\s+[A-Z]') THEN 3 END AS level FROM fx_guide_lines),
  m1 AS (SELECT * FROM m0 WHERE t <> '' AND NOT regexp_matches(t, '<<[^>]*>>') AND NOT (regexp_matches(t, '(?i)\b(TBD|XXX|TODO)\b') AND length(t) < 50)),
  b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, t, level, CASE WHEN contains(t, '|') THEN '[Number | Description | Upstream] ' || t ELSE t END AS text FROM m1)"""
LEN = lambda c: f"length({c})"


@query(folded(MARKED, "(f.size >= 150 AND (coalesce(b.level <= 3, false) OR f.size + length(b.t) > 8000))", "text", LEN, "t"))
def chunk_section_aware(spark, sf_dir):
    """Blocks with levels, tables and template text, with the limits of a writing guide."""
    blocks = chunking.marked_blocks(fixture(spark, sf_dir, "fx_guide_lines"))
    return chunking.by_section_aware(blocks, source_file="Writing_guide.docx").select("doc_id", "chunk_id", "text")


@query(folded(MARKED, "(f.size >= 150 AND (coalesce(b.level <= 2, false) OR f.size + length(b.t) > 400))", "text", LEN, "t"))
def chunk_section_aware_capped(spark, sf_dir):
    """As above for other files, with a cap that binds."""
    blocks = chunking.marked_blocks(fixture(spark, sf_dir, "fx_guide_lines"))
    return chunking.by_section_aware(blocks, max_tokens=200).select("doc_id", "chunk_id", "text")


def overlap_ctes(source: str) -> str:
    """CTEs that chunk a table (doc_id, text) with overlap; the last, chunks, has (doc_id, chunk_id, section, text)."""
    return rf"""sl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {source}),
  st AS (SELECT doc_id, k, {strip_sql('line')} AS s FROM sl), hs AS (SELECT *, CASE WHEN length(s) < 80 THEN regexp_replace({strip_sql(f"regexp_extract(s, {quoted(chunking.PASSAGE_HEADING)}, 1)")}, ':+$', '') ELSE '' END AS h FROM st),
  gs AS (SELECT *, sum(CASE WHEN h <> '' OR s = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS g, last_value(nullif(h, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS sec FROM hs),
  pa AS (SELECT doc_id, g, coalesce(any_value(sec), '') AS sec, string_agg(s, ' ' ORDER BY k) AS text FROM gs WHERE h = '' AND s <> '' GROUP BY doc_id, g),
  p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS i, sec, text, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY g) AS upto FROM pa),
  back AS (SELECT a.doc_id, a.i, coalesce(min(b.i), a.i) AS first FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND b.i < a.i AND a.upto - a.n - b.upto + b.n <= 180 GROUP BY a.doc_id, a.i),
  f AS (SELECT doc_id, i, 0 AS chunk_id, i AS first, sec AS section, n::BIGINT AS size FROM p WHERE i = 1
    UNION ALL SELECT p.doc_id, p.i, f.chunk_id + CASE WHEN f.size + p.n > 900 THEN 1 ELSE 0 END, CASE WHEN f.size + p.n > 900 THEN greatest(f.first, k.first) ELSE f.first END, CASE WHEN f.size + p.n > 900 THEN p.sec ELSE f.section END,
      (p.upto - (SELECT q.upto - q.n FROM p q WHERE q.doc_id = p.doc_id AND q.i = CASE WHEN f.size + p.n > 900 THEN greatest(f.first, k.first) ELSE f.first END))::BIGINT
    FROM f JOIN p ON p.doc_id = f.doc_id AND p.i = f.i + 1 JOIN back k ON k.doc_id = p.doc_id AND k.i = p.i),
  c AS (SELECT doc_id, chunk_id, any_value(first) AS first, any_value(section) AS section, max(i) AS last FROM f GROUP BY doc_id, chunk_id),
  chunks AS (SELECT c.doc_id, c.chunk_id, c.section, string_agg(p.text, ' ' ORDER BY p.i) AS text FROM c JOIN p ON p.doc_id = c.doc_id AND p.i BETWEEN c.first AND c.last GROUP BY c.doc_id, c.chunk_id, c.section)"""


@query(f"WITH RECURSIVE {overlap_ctes('documents')} SELECT * FROM chunks")
def chunk_overlap(spark, sf_dir):
    return chunking.with_overlap(documents(spark, sf_dir))


@query(rf"""{BLOCKS}, s AS (SELECT *, regexp_extract(text, '{chunking.STANDARD_SECTION}', 1) AS num FROM b),
  g AS (SELECT *, 'STA' || doc_id || CASE WHEN max(CASE WHEN num <> '' THEN i END) OVER w IS NULL THEN '' ELSE ' §' || last_value(nullif(num, '') IGNORE NULLS) OVER w END AS sec FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  f AS (SELECT doc_id, i, 0 AS chunk_id, length(text) AS size FROM g WHERE i = 0
    UNION ALL SELECT g.doc_id, g.i, f.chunk_id + CASE WHEN (g.num <> '' AND f.size * 2 > 800) OR f.size + length(g.text) > 800 THEN 1 ELSE 0 END,
      CASE WHEN (g.num <> '' AND f.size * 2 > 800) OR f.size + length(g.text) > 800 THEN length(g.text) ELSE f.size + length(g.text) END FROM f JOIN g ON g.doc_id = f.doc_id AND g.i = f.i + 1),
  c AS (SELECT f.doc_id, chunk_id, string_agg(text, ' ' ORDER BY g.i) AS text, min(g.i) AS a, max(g.i) AS z FROM f JOIN g ON g.doc_id = f.doc_id AND g.i = f.i GROUP BY f.doc_id, chunk_id)
  SELECT c.doc_id, c.chunk_id, coalesce(n.sec, l.sec) AS section, c.text FROM c LEFT JOIN g n ON n.doc_id = c.doc_id AND n.i = c.z + 1 JOIN g l ON l.doc_id = c.doc_id AND l.i = c.z""")
def chunk_standard(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("code", F.concat(F.lit("STA"), F.col("doc_id")))
    return chunking.chunk_standard(d)


# ---------------------------------------------------------------- requirements
@query(rf"""{S}, r AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda x: trim(x)) AS c FROM fx_spec_lines)
  SELECT doc_id, c[1] AS req_id, arg_min(c[2], line_no) AS text, min(line_no) AS line_no FROM r WHERE regexp_matches(c[1], '^(?:REQ|REF|APP|GEN)(?:-[A-Z0-9_]+)*-\d+$') AND len(c) >= 2 GROUP BY doc_id, c[1]""")
def extract_requirements_inline(spark, sf_dir):
    return requirements.inline_requirements(spec(spark, sf_dir))


ROWS = rf"""{S}, r AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda x: trim(x)) AS c FROM fx_spec_lines),
  q AS (SELECT doc_id, c[1] AS req_id, c[2] AS text, line_no FROM r WHERE regexp_matches(c[1], '^(REF|APP|GEN)-[A-Z0-9][A-Z0-9_.-]+$') AND len(c) = 3 QUALIFY row_number() OVER (PARTITION BY doc_id, c[1] ORDER BY line_no) = 1)"""


def spec_texts(spark, sf_dir) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return spec(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


@query(f"{ROWS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::INT AS seq, req_id, text, (line_no + 1)::INT AS line_no FROM q")
def extract_requirements(spark, sf_dir):
    """The whole scan.  In these documents every requirement is one closed row, which SQL can tell; golden cases hold the rest."""
    return requirements.extract_requirements(spec_texts(spark, sf_dir))


@query(f'{ROWS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) + 9)::INT AS "row", text AS col_a, req_id AS col_c FROM q')
def matrix_template_rows(spark, sf_dir):
    """Rows that fill the matrix template: description in column A, identifier in column C, from row 10 on."""
    return requirements.matrix_rows(extract_requirements(spark, sf_dir))


TABLES = rf"""{cte('fx_guide_lines')}, tb AS (SELECT doc_id, line_no, line_no // 6 AS table_index, line_no % 6 AS row_index, (doc_id + line_no // 6) % 5 AS form, line FROM fx_guide_lines),
  tr AS (SELECT doc_id, CAST(table_index AS INT) AS table_index, CAST(row_index AS INT) AS row_index, CASE WHEN table_index % 2 = 0 THEN 'A' ELSE 'B' END AS section, form, line FROM tb)"""


def requirement_tables(spark, sf_dir) -> DataFrame:
    """Six lines are a table: its header in one of five forms, then rows."""
    d = fixture(spark, sf_dir, "fx_guide_lines").withColumns({"table_index": F.expr("cast(line_no div 6 as int)"), "row_index": F.expr("cast(line_no % 6 as int)")})
    form = (F.col("doc_id") + F.col("table_index")) % 5
    words = [["Requirement number", "Description", "Input requirement"], ["Mark", "Reference", "Title"], ["Parameter", "Value"], ["Description", "Upstream requirement", "Remark"], ["Parameter", "Description", "Unit"]]
    header = F.when(form == 0, F.array(*map(F.lit, words[0])))
    for k in range(1, 5):
        header = header.when(form == k, F.array(*map(F.lit, words[k])))
    own = F.when(F.col("row_index") % 2 == 1, F.concat(F.lit("REF-A-"), F.col("line_no").cast("string"), F.lit("@x\nAtt"))).otherwise("")
    row = F.when(form == 0, F.array(own, F.col("line"), F.lit("N/A"))).when(form == 3, F.array(F.col("line"), F.lit("UP-1"), F.lit(""))).otherwise(F.array(F.col("line"), F.lit("1"), F.lit("V")))
    section = F.when(F.col("table_index") % 2 == 0, "A").otherwise("B")
    return d.select("doc_id", "table_index", "row_index", section.alias("section"), F.when(F.col("row_index") == 0, header).otherwise(row).alias("cells"))


@query(rf"""{TABLES}, s3 AS (SELECT doc_id, table_index, count(*) FILTER (row_index <= 3 AND length(line) > 10) AS sampled, count(*) FILTER (row_index <= 3 AND length(line) > 10 AND {found('line', requirements.LIKE_REQUIREMENT)}) AS alike
    FROM tr WHERE row_index > 0 GROUP BY doc_id, table_index)
  SELECT t.doc_id, t.table_index, t.row_index, t.section, CASE WHEN form = 0 THEN CASE WHEN row_index % 2 = 1 THEN 'REF-A-' || (t.table_index * 6 + row_index) ELSE '' END END AS req_id, line AS description, CASE WHEN form = 0 THEN 'N/A' ELSE 'UP-1' END AS input_requirement
  FROM tr t JOIN s3 ON s3.doc_id = t.doc_id AND s3.table_index = t.table_index WHERE row_index > 0 AND (form = 0 OR (form = 3 AND NOT (sampled > 0 AND alike = 0))) AND (line <> '' OR (form = 0 AND row_index % 2 = 1))""")
def requirement_table_rows(spark, sf_dir):
    """Rows of the tables that are requirement tables, with cleaned identifiers."""
    return requirements.table_requirements(requirement_tables(spark, sf_dir))


# ---------------------------------------------------------------- reports
@query(rf"""{S}, h AS (SELECT doc_id, line_no, 'template_placeholder' AS label FROM fx_spec_lines WHERE {found('line', PLACE)} UNION ALL SELECT doc_id, line_no, 'tbd_placeholder' FROM fx_spec_lines WHERE regexp_matches(line, '(?i)\bTBD\b')
  UNION ALL SELECT doc_id, line_no, 'xxx_placeholder' FROM fx_spec_lines WHERE {found('line', XXX)})
  SELECT doc_id, label, count(*) AS n, array_to_string(list_slice(list(line_no ORDER BY line_no), 1, 5), ',') AS first_lines FROM h GROUP BY doc_id, label""")
def placeholder_places(spark, sf_dir):
    d = reports.placeholder_places(spec(spark, sf_dir))
    return d.withColumn("first_lines", F.array_join(F.col("first_lines").cast("array<string>"), ","))


@query(f"""{S}, r AS (SELECT doc_id, list_transform(string_split(line, '|'), lambda x: trim(x)) AS c FROM fx_spec_lines WHERE len(string_split(line, '|')) >= 3 AND {found('line', SH)}),
  q AS (SELECT doc_id, count(*) AS total, count(*) FILTER ({found('c[1]', rules.REQUIREMENT_ID)}) AS with_id, count(*) FILTER (c[3] NOT IN ('', 'N/A')) AS with_input, count(*) FILTER (length(c[2]) < 40) AS weak FROM r GROUP BY doc_id)
  SELECT *, with_id / total AS id_share, with_input / total AS input_share FROM q""")
def req_quality(spark, sf_dir):
    return reports.requirement_quality(spec(spark, sf_dir))


@query(f"""{H}, c AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM h)
  SELECT doc_id, section, count(*) FILTER ({IS_SHALL}) AS requirements, sum({times('line', PLACE)} + {times('line', TBD)})::BIGINT AS placeholders,
    count(*) FILTER ({found('line', SH)} AND {found('line', SUBJ)}) AS issues FROM c WHERE section IS NOT NULL GROUP BY doc_id, section""")
def section_summary(spark, sf_dir):
    return reports.section_summary(spec(spark, sf_dir))


@query(rf"""{S}, r AS (SELECT doc_id, line_no, list_transform(string_split(line, '|'), lambda x: trim(x)) AS c FROM fx_spec_lines),
  i AS (SELECT doc_id, c[1] AS req_id, min(line_no) AS line_no FROM r WHERE regexp_matches(c[1], '^(?:REQ|REF|APP|GEN)(?:-[A-Z0-9_]+)*-\d+$') AND len(c) >= 2 GROUP BY doc_id, c[1])
  SELECT doc_id, count(*) AS total, count(*) AS with_id, 0 AS without_id, array_to_string(list_slice(list(req_id ORDER BY line_no), 1, 10), ',') AS first_ids FROM i GROUP BY doc_id""")
def matrix_stats(spark, sf_dir):
    d = reports.matrix_stats(requirements.inline_requirements(spec(spark, sf_dir)))
    return d.withColumn("first_ids", F.array_join("first_ids", ","))

"""Queries over questions, retrieval scores and quality events."""

from __future__ import annotations

from pyspark.sql import functions as F

from specforge import lexicon
from specforge.fixtures import cte, fixture
from specforge.functions import text as T
from specforge.operators import chunking, qa, retrieval
from specforge.plans import document_queries
from specforge.plans.registry import found, listed, quoted, registry

QUERIES, ORACLES, query = registry()
E, Q = cte("fx_qa_events"), cte("fx_questions")
OK = "NOT was_not_found AND NOT was_refusal"


def _metrics(group: str, name: str) -> str:
    return f"""SELECT {group} total, answered, not_found, refusals, sourced, high, CASE WHEN total > 0 THEN answered / total END AS answer_rate, CASE WHEN total > 0 THEN not_found / total END AS not_found_rate,
  CASE WHEN answered > 0 THEN sourced / answered END AS source_rate, CASE WHEN answered > 0 THEN high / answered END AS high_rate FROM {name}"""


COUNTS = f"count(*) AS total, count(*) FILTER ({OK}) AS answered, count(*) FILTER (was_not_found) AS not_found, count(*) FILTER (was_refusal) AS refusals, count(*) FILTER ({OK} AND had_sources) AS sourced, count(*) FILTER ({OK} AND confidence = 'HIGH') AS high"


@query(f"{E}, m AS (SELECT {COUNTS} FROM fx_qa_events) {_metrics('', 'm')}")
def qa_metrics(spark, sf_dir):
    return qa.metrics(fixture(spark, sf_dir, "fx_qa_events"))


@query(f"{E}, m AS (SELECT {COUNTS} FROM (SELECT * FROM fx_qa_events ORDER BY ts DESC, event_id DESC LIMIT 1000)) {_metrics('', 'm')}")
def qa_metrics_last1000(spark, sf_dir):
    """The reference keeps the last thousand records: the limit is the feature."""
    return qa.metrics(qa.last_events(fixture(spark, sf_dir, "fx_qa_events")))


@query(f"{E}, m AS (SELECT date_trunc('hour', ts) AS hour, {COUNTS} FROM fx_qa_events GROUP BY 1) {_metrics('hour,', 'm')}")
def qa_metrics_hourly(spark, sf_dir):
    """Batch equivalent of the streaming metrics by hour."""
    return qa.metrics(fixture(spark, sf_dir, "fx_qa_events").withColumn("hour", F.date_trunc("hour", "ts")), "hour")


@query(f"{E} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM fx_qa_events QUALIFY rank <= 3")
def latest_per_user(spark, sf_dir):
    return qa.latest_per_user(fixture(spark, sf_dir, "fx_qa_events")).select("event_id", "user_id", "rank")


@query(f"""{E}, s AS (SELECT event_id, top_score / 500.0::DOUBLE AS a, CASE WHEN source_count > 2 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS b FROM fx_qa_events)
  SELECT event_id, CASE WHEN greatest(a, b) >= 0.5 AND CAST(a >= 0.2 AS INT) + CAST(b >= 0.2 AS INT) >= 2 THEN 'HIGH' WHEN greatest(a, b) >= 0.25 OR a >= 0.2 OR b >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s""")
def confidence_from_scores(spark, sf_dir):
    scores = F.array(F.col("top_score") / 500.0, F.when(F.col("source_count") > 2, 0.3).otherwise(0.1))
    return fixture(spark, sf_dir, "fx_qa_events").select("event_id", T.confidence_from_scores(scores).alias("level"))


def asks(c: str, patterns) -> str:
    return found(c, "(?i)" + "|".join(patterns))


TOKENS = "list_distinct(regexp_extract_all(lower(translate({c}, '''’', '  ')), '[a-zàâäéèêëïîôöùûüçñ0-9]+'))"
STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_longest = "CASE " + " ".join(f"WHEN contains(low, {quoted(a)}) THEN {quoted(n)}" for a, n in qa.section_aliases()) + " END"
_worded = ", ".join(f"({k}, {quoted(n)}, [{', '.join(map(quoted, w))}])" for k, (n, w) in enumerate(qa.worded_aliases()))


def questioned(source: str, key: str) -> str:
    """CTEs up to qq (key, question, section, what is asked)."""
    first = key.split(",")[0]
    return f"""q0 AS (SELECT {key}, question, {STRIP.format(c='lower(question)')} AS low, regexp_replace({STRIP.format(c='lower(question)')}, '[?!.]+$', '') AS q, {STRIP.format(c='question')} AS s FROM {source}),
  qw AS (SELECT *, list_filter(list_distinct(regexp_extract_all(low, '[a-zàâäéèêëîïôöùûüçñ]+')), lambda w: w NOT IN {listed(sorted(lexicon.GUIDANCE_STOP_WORDS))}) AS words, row_number() OVER () AS qk FROM q0),
  al AS (SELECT * FROM (VALUES {_worded}) AS t(k, name, w)),
  ov AS (SELECT qk, name FROM qw, al WHERE len(list_intersect(words, w)) / len(w) >= 0.4 QUALIFY row_number() OVER (PARTITION BY qk ORDER BY len(list_intersect(words, w)) / len(w) DESC, k) = 1),
  qs AS (SELECT qw.*, coalesce({_longest}, ov.name) AS section FROM qw LEFT JOIN ov ON ov.qk = qw.qk),
  qq AS (SELECT *, {asks('question', qa.STANDARDS)} AS standards, q = '' OR q IN {listed(qa.VAGUE)} OR (NOT {asks('q', qa.OVERVIEW)} AND len(list_filter({TOKENS.format(c='q')}, lambda t: t NOT IN {listed(sorted(lexicon.STOP_WORDS))})) <= 1) AS vague,
    len(regexp_extract_all(lower(question), '[a-zA-Zàâäéèêëîïôöùûüçñ]{{2,}}')) <= 1 AS brief, low IN ('validate', 'validate!', 'validate.', 'validate?') OR {asks('s', qa.VALIDATION)} AS validation, {asks('question', qa.OVERVIEW)} AS overview,
    length(s) >= 5 AND (upper(regexp_replace(s, '[? !.]+$', '')) IN {listed(lexicon.SECTION_ALIASES)} OR (NOT {asks('s', qa.FACTUAL)} AND ({asks('s', qa.GUIDANCE)} OR ({asks('s', qa.LOOSE_GUIDANCE)} AND section IS NOT NULL)))) AS guided,
    CASE WHEN regexp_matches(low, {quoted(qa.FACTUAL_START)}) AND len(regexp_split_to_array(low, '\\s+')) >= 3 THEN 'factual' ELSE 'overview' END AS class FROM qs),
  qi AS (SELECT *, CASE WHEN standards THEN 'standards' WHEN vague THEN 'clarify' WHEN validation THEN 'validate' WHEN overview THEN 'overview' ELSE 'search' END AS intent,
    CASE WHEN standards THEN 'standards' WHEN brief THEN 'clarify' WHEN validation THEN 'validate' WHEN guided THEN 'guidance' WHEN overview THEN 'overview' ELSE 'search' END AS handler_intent FROM qq)"""


def asked_columns():
    q = F.col("question")
    return [qa.section_of(q).alias("section"), qa.intent(q).alias("intent"), qa.intent(q, True).alias("handler_intent"), qa.is_guidance(q).alias("guided"), qa.question_class(q).alias("class")]


@query(f"{Q}, {questioned('fx_questions', 'q_id')} SELECT q_id, section, intent, handler_intent, guided, class FROM qi")
def question_intent(spark, sf_dir):
    """Section, intent of the router and of the handler, whether it asks for guidance, and its class on one document."""
    return fixture(spark, sf_dir, "fx_questions").select("q_id", *asked_columns())


@query("WITH c AS (SELECT conv_id, turn, text AS question FROM conversations), " + questioned("c", "conv_id, turn") + " SELECT conv_id, turn, section, intent, handler_intent, guided, class FROM qi")
def conversation_intent(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumnRenamed("text", "question")
    return d.select("conv_id", "turn", *asked_columns())


# ---------------------------------------------------------------- retrieval
def keyed(chunks, name):
    key = F.concat_ws("-", F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lpad(F.col("chunk_id").cast("string"), 6, "0"))
    return chunks.select(key.alias("chunk_key"), name.alias("file_name"), "chunk_id", "section", "text")


def passages(spark, sf_dir):
    """The index of all documents: chunks with overlap and their sections."""
    return keyed(chunking.with_overlap(spark.read.parquet(f"{sf_dir}/documents.parquet")), F.col("doc_id").cast("string"))


def specifications(spark, sf_dir):
    """The index of the specifications: files that questions can name."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    d = fixture(spark, sf_dir, "fx_guide_lines").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    n = F.col("doc_id").cast("string")
    return keyed(chunking.with_overlap(d), F.when(F.col("doc_id") == 0, "spec_extracted.txt").otherwise(F.concat(F.lit("unit_"), n, F.lit("_door_part-"), n, F.lit(".docx"))))


KEY = "lpad(CAST(doc_id AS VARCHAR), 12, '0') || '-' || lpad(CAST(chunk_id AS VARCHAR), 6, '0') AS chunk_key"
SPECS = f"""{cte('fx_guide_lines', 'fx_questions').replace('WITH ', 'WITH RECURSIVE ', 1)}, specs AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM fx_guide_lines GROUP BY doc_id), {document_queries.overlap_ctes('specs')},
  ck AS MATERIALIZED (SELECT {KEY}, CASE WHEN doc_id = 0 THEN 'spec_extracted.txt' ELSE 'unit_' || doc_id || '_door_part-' || doc_id || '.docx' END AS file_name, chunk_id, section, text FROM chunks)"""
DOCS = f"""{Q.replace('WITH ', 'WITH RECURSIVE ', 1)}, {document_queries.overlap_ctes('documents')}, ck AS MATERIALIZED (SELECT {KEY}, CAST(doc_id AS VARCHAR) AS file_name, chunk_id, section, text FROM chunks)"""

FR = " ".join(f"WHEN {quoted(k)} THEN {'[' + ', '.join(quoted(w) for w in v.split()) + ']'}" for k, v in lexicon.FRENCH_ENGLISH.items())
CONTENT = lambda c: f"list_distinct(list_concat(list_filter({TOKENS.format(c=c)}, lambda t: t NOT IN {listed(sorted(lexicon.STOP_WORDS))}), flatten(list_transform(list_filter({TOKENS.format(c=c)}, lambda t: t NOT IN {listed(sorted(lexicon.STOP_WORDS))}), lambda t: CASE t {FR} ELSE [] END))))"
_close = "strpos(low, ql[i]) > 0 AND strpos(low, ql[i + 1]) > 0 AND abs(strpos(low, ql[i]) - strpos(low, ql[i + 1])) <= 40"
WORDS = f"""ct AS MATERIALIZED (SELECT *, {CONTENT('text')} AS toks, {TOKENS.format(c="lower(coalesce(section, ''))")} AS sec FROM ck), qt AS (SELECT q_id, question, {CONTENT('question')} AS qt FROM fx_questions),
  nn AS (SELECT count(*) AS n FROM ct), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(toks) AS token FROM ct) GROUP BY token), idf AS (SELECT map(list(token), list(ln(1 + n / df))) AS m FROM df, nn),
  pr AS (SELECT q_id, chunk_key, file_name, qt, list_sort(qt) AS ql, toks, lower(text) AS low, list_filter(qt, lambda t: list_contains(toks, t)) AS hit, list_filter(qt, lambda t: list_contains(sec, t)) AS ins FROM qt, ct WHERE len(qt) > 0 AND (list_has_any(qt, toks) OR list_has_any(qt, sec))),
  kw AS (SELECT q_id, chunk_key, round((coalesce(list_sum(list_transform(hit, lambda t: m[t])), 0) / (1.0 + len(qt)) + 0.3 * len(hit) / (1.0 + ln(1 + len(toks)))
      + 0.15 * coalesce(list_sum(list_transform(range(1, len(ql)), lambda i: CASE WHEN {_close} THEN 1 ELSE 0 END)), 0) + 2.0 * len(ins) / len(qt)) * CASE WHEN file_name IN ('spec_extracted.txt', 'template_extracted.txt') THEN 1.0 ELSE 1.15 END, 10) AS score FROM pr, idf),
  kt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_key) AS rank FROM kw WHERE score >= 0.10)"""


@query(f"SELECT token, count(*) AS df FROM (SELECT doc_id, unnest({CONTENT('text')}) AS token FROM documents) GROUP BY token")
def document_frequency(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return retrieval.document_frequency(d.select(T.content_tokens(F.col("text")).alias("tokens")))


@query(f"{DOCS}, {WORDS} SELECT q_id, chunk_key, rank, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS micros FROM kt WHERE rank <= 5")
def keyword_topk(spark, sf_dir):
    """Five best passages of all documents for each question; scores in millionths."""
    d = retrieval.keyword_topk(fixture(spark, sf_dir, "fx_questions"), passages(spark, sf_dir))
    return d.select("q_id", "chunk_key", "rank", F.floor(F.col("score") * 1e6 + 0.5).alias("micros"))


_embed = lambda toks: f"list_transform(range(0, 64), lambda i: coalesce(list_sum(list_transform(list_filter({toks}, lambda t: CAST('0x' || substr(md5(t), 1, 2) AS INT) % 64 = i), lambda t: CASE WHEN CAST('0x' || substr(md5(t), 3, 1) AS INT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)), 0.0::DOUBLE))"
VECTORS = f"""ev AS MATERIALIZED (SELECT chunk_key, {_embed('toks')} AS e FROM ct), qv AS MATERIALIZED (SELECT q_id, {_embed('qt')} AS e FROM qt),
  cs AS (SELECT q_id, chunk_key, round(coalesce(CASE WHEN isnan(list_cosine_similarity(qv.e, ev.e)) THEN 0 ELSE list_cosine_similarity(qv.e, ev.e) END, 0), 12) AS score FROM qv, ev),
  cr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_key) AS rank FROM cs)"""


@query(f"{SPECS}, {WORDS}, {VECTORS} SELECT q_id, chunk_key, rank FROM cr WHERE rank <= 5 AND score >= 0.3")
def semantic_topk(spark, sf_dir):
    """Passages of the specifications whose vectors (of a stand-in for a model) are nearest to the question's."""
    q = fixture(spark, sf_dir, "fx_questions").select("q_id", retrieval.embedded(F.col("question")).alias("embedding"))
    return retrieval.cosine_topk(q, retrieval.index_of(specifications(spark, sf_dir)), threshold=0.3).select("q_id", "chunk_key", "rank")


@query(f"""{SPECS}, {WORDS}, {VECTORS}, both_ AS (SELECT q_id, chunk_key, rank FROM kt WHERE rank <= 10 UNION ALL SELECT q_id, chunk_key, rank FROM cr WHERE rank <= 10),
  rf AS (SELECT q_id, chunk_key, sum(1.0::DOUBLE / (rank + 60)) AS score FROM both_ GROUP BY q_id, chunk_key) SELECT q_id, chunk_key, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_key) AS rank FROM rf QUALIFY rank <= 5""")
def hybrid_rrf(spark, sf_dir):
    """Fusion of the rankings by keywords and by vectors."""
    q, index = fixture(spark, sf_dir, "fx_questions"), retrieval.index_of(specifications(spark, sf_dir))
    near = retrieval.cosine_topk(q.select("q_id", retrieval.embedded(F.col("question")).alias("embedding")), index, k=10, threshold=-2.0)
    return retrieval.reciprocal_rank_fusion(near, retrieval.keyword_topk(q, index.drop("embedding"), k=10)).select("q_id", "chunk_key", "rank")


_spelled = "'(?i)(?:\\b' || acronym || '\\s*[\\(—\\-:]\\s*([A-Z][^\\)]{3,60})|\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,5})\\s*\\(\\s*' || acronym || '\\s*\\))'"
ACRONYMS = f"""aq AS (SELECT q_id, upper(regexp_extract(question, {quoted('(?i)' + qa.ACRONYM)}, 1)) AS acronym FROM fx_questions),
  ah AS MATERIALIZED (SELECT q_id, chunk_key, row_number() OVER (PARTITION BY q_id ORDER BY chunk_key) AS rank FROM aq, ck WHERE acronym <> '' AND regexp_matches(text, {_spelled}))"""


@query(f"{SPECS}, {ACRONYMS} SELECT q_id, chunk_key, rank FROM ah WHERE rank <= 5")
def acronym_lookup(spark, sf_dir):
    return retrieval.acronym_hits(fixture(spark, sf_dir, "fx_questions"), specifications(spark, sf_dir)).select("q_id", "chunk_key", "rank")


FILES = r"""fn AS (SELECT DISTINCT file_name FROM ck), fs AS (SELECT file_name, list_filter(regexp_split_to_array(trim(regexp_replace(lower(regexp_replace(file_name, '\.[^.]*$', '')), '[_\-]+', ' ', 'g')), '\s+'), lambda t: length(t) > 2) AS stem FROM fn),
  fq AS MATERIALIZED (SELECT q_id, file_name FROM fx_questions, fs WHERE len(stem) > 0 AND len(list_filter(stem, lambda t: contains(lower(question), t))) >= CASE WHEN len(stem) > 2 THEN 2 ELSE 1 END
    QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY length(file_name) DESC, file_name) = 1)"""


@query(f"{SPECS}, {FILES} SELECT * FROM fq")
def referenced_files(spark, sf_dir):
    """The file that a question names."""
    return retrieval.file_questions(fixture(spark, sf_dir, "fx_questions"), specifications(spark, sf_dir).select("file_name").distinct())


@query(f"""{SPECS}, {WORDS}, {ACRONYMS}, {FILES}, {questioned('fx_questions', 'q_id')}, o1 AS (SELECT q_id, intent FROM qi WHERE intent IN ('overview', 'search')),
  r1 AS (SELECT o1.q_id, chunk_key, 1.0::DOUBLE AS score, 'overview' AS strategy FROM o1 JOIN fq ON fq.q_id = o1.q_id JOIN ck ON ck.file_name = fq.file_name WHERE intent = 'overview' AND chunk_id < 7),
  r2 AS (SELECT o1.q_id, chunk_key, 2.0::DOUBLE, 'acronym' FROM o1 JOIN ah ON ah.q_id = o1.q_id WHERE rank <= 5 AND o1.q_id NOT IN (SELECT q_id FROM r1)),
  r3 AS (SELECT o1.q_id, chunk_key, score::DOUBLE, 'keywords' FROM o1 JOIN kt ON kt.q_id = o1.q_id WHERE rank <= 5 AND o1.q_id NOT IN (SELECT q_id FROM r1 UNION ALL SELECT q_id FROM r2)),
  r AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3),
  g AS (SELECT q_id, strategy, max(score) AS best, count(*) AS n, count(*) FILTER (score >= 0.2) AS support, arg_min(chunk_key, -score * 1e9 + 0) AS any_key FROM r GROUP BY q_id, strategy),
  g1 AS (SELECT q_id, chunk_key FROM r QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_key) = 1),
  l AS (SELECT g.*, g1.chunk_key AS first_source, CASE WHEN best >= 0.5 AND support >= 2 THEN 'HIGH' WHEN best >= 0.25 OR support >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM g JOIN g1 ON g1.q_id = g.q_id)
  SELECT qi.q_id, CASE WHEN qi.intent = 'standards' THEN 'refusal' WHEN qi.intent = 'clarify' THEN 'clarify' WHEN qi.intent = 'validate' THEN 'validate' WHEN l.q_id IS NULL THEN CASE WHEN guided AND qi.section IS NOT NULL THEN 'guidance' ELSE 'not_found' END
    WHEN level = 'LOW' THEN 'partial' ELSE 'answered' END AS status, coalesce(strategy, '') AS strategy, coalesce(level, '') AS confidence, coalesce(n, 0)::INT AS n_sources, first_source,
    CASE WHEN length(trim(ck.text)) > 500 THEN left(trim(ck.text), 497) || '...' ELSE trim(ck.text) END AS excerpt FROM qi LEFT JOIN l ON l.q_id = qi.q_id LEFT JOIN ck ON ck.chunk_key = first_source""")
def ask_pipeline(spark, sf_dir):
    """The whole way of a question: refusal, clarification, validation, overview, acronym, keywords, guidance or nothing."""
    return retrieval.answers(fixture(spark, sf_dir, "fx_questions"), specifications(spark, sf_dir))


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_key"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")


def query_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).where("chunk_key % 20 = 0").select(F.col("chunk_key").alias("q_id"), "embedding")


COS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS q_id, c.vec_id AS chunk_key, round(list_cosine_similarity(q.e, c.e), 12) AS raw FROM v q, v c WHERE q.vec_id % 20 = 0)"""


@query(f"{COS} SELECT q_id, chunk_key, row_number() OVER (PARTITION BY q_id ORDER BY raw DESC, chunk_key) AS rank FROM s QUALIFY rank <= 5")
def cosine_topk(spark, sf_dir):
    """Top five of a stated query set: every vector whose number is divisible by 20, against all."""
    return retrieval.cosine_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir), threshold=-2.0).select("q_id", "chunk_key", "rank")


@query(f"{COS} SELECT q_id, count(*) AS n, count(*) FILTER (raw >= 0.99) AS equal FROM s WHERE raw >= 0.2 GROUP BY q_id")
def cosine_threshold(spark, sf_dir):
    s = retrieval.cosine_scores(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 0.2)
    return s.groupBy("q_id").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 0.99).alias("equal"))


@query(f"""{COS}, l AS (SELECT *, CASE WHEN m >= 0.58 THEN 0.50 WHEN m >= 0.43 THEN 0.35 ELSE 0.25 END AS lim FROM (SELECT *, max(raw) OVER (PARTITION BY q_id) AS m FROM s WHERE q_id <> chunk_key))
  SELECT q_id, chunk_key, row_number() OVER (PARTITION BY q_id ORDER BY raw DESC, chunk_key) AS rank FROM l WHERE raw >= lim QUALIFY rank <= 5""")
def progressive_threshold(spark, sf_dir):
    s = retrieval.cosine_scores(query_vectors(spark, sf_dir), vectors(spark, sf_dir), 0.25).where("q_id <> chunk_key")
    return retrieval.progressive(s).select("q_id", "chunk_key", "rank")


@query(f"""{COS}, t AS (SELECT q_id, chunk_key, raw, row_number() OVER (PARTITION BY q_id ORDER BY raw DESC, chunk_key) AS rank FROM s WHERE raw >= 0.2 QUALIFY rank <= 5)
  SELECT chunk_key, q_id, CAST(floor(raw * 1e6 + 0.5) AS BIGINT) AS micros FROM t QUALIFY row_number() OVER (PARTITION BY chunk_key ORDER BY q_id, rank) = 1""")
def matched_references(spark, sf_dir):
    """References that chunks of a document match, each once, with the match that was met first; scores in millionths."""
    d = retrieval.first_matches(retrieval.cosine_topk(query_vectors(spark, sf_dir), vectors(spark, sf_dir), threshold=0.2))
    return d.select("chunk_key", "q_id", F.floor(F.col("score") * 1e6 + 0.5).alias("micros"))

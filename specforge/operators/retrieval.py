"""Retrieval: keyword and vector scores, top-k by window, fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from specforge.functions.text import bound, confidence_from_scores, content_tokens, tokenize
from specforge.operators import qa
from specforge.tables import written

BUILT_IN = ("spec_extracted.txt", "template_extracted.txt")


def document_frequency(chunks: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, df: chunks that hold it."""
    return chunks.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def top(scored: DataFrame, k: int, by: str = "q_id", ties: str = "chunk_key") -> DataFrame:
    """Rank by score, then by order of input; Spark cuts each group to k before the exchange."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), ties)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def phrase_bonus(tokens: Column, text: Column) -> Column:
    """0.15 for every two neighbours among the sorted query tokens that first occur within 40 characters of one another."""
    first = lambda low: F.transform(F.array_sort(tokens), lambda t: F.call_function("instr", low, t))
    close = lambda at: F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda x, y: F.when((x > 0) & (y > 0) & (F.abs(x - y) <= 40), 1))
    return bound(bound(text, first), lambda at: F.size(F.array_compact(close(at)))) * 0.15


def tokenized(chunks: DataFrame) -> DataFrame:
    """chunks with tokens of text and section, unless they have them."""
    if "tokens" in chunks.columns:
        return chunks
    return chunks.withColumns({"tokens": content_tokens(F.col("text")), "sec": tokenize(F.lower(F.coalesce("section", F.lit(""))))})


def keyword_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, chunk_key, score) of questions (q_id, question) against chunks (chunk_key, file_name, section, text).

    Candidates come from an equi-join on tokens (text and section), so no question meets every chunk; document frequencies are
    looked up for the questions' tokens only.
    """
    q = questions.select("q_id", content_tokens(F.col("question")).alias("q_tokens")).where(F.size("q_tokens") > 0)
    c = tokenized(chunks).select("chunk_key", "file_name", "text", "tokens", "sec")
    n = c.agg(F.count("*").alias("n_chunks"))
    asked = q.select("q_id", "q_tokens", F.explode("q_tokens").alias("token"))
    words = asked.select("token").distinct()
    postings = c.select("chunk_key", F.explode(F.array_distinct(F.concat("tokens", "sec"))).alias("token")).join(F.broadcast(words), "token", "left_semi")
    candidates = asked.join(postings, "token").select("q_id", "q_tokens", "chunk_key").distinct()
    df = document_frequency(c).join(F.broadcast(words), "token", "left_semi").crossJoin(F.broadcast(n))
    idf = df.agg(F.map_from_entries(F.collect_list(F.struct("token", F.log1p(F.col("n_chunks") / F.col("df")).alias("w")))).alias("idf"))
    d = candidates.join(c, "chunk_key").crossJoin(F.broadcast(idf))
    both, in_section = F.array_intersect("q_tokens", "tokens"), F.array_intersect("q_tokens", "sec")
    size = F.size("q_tokens")
    coverage = F.aggregate(both, F.lit(0.0), lambda s, t: s + F.element_at("idf", t)) / (size + 1.0)
    specific = F.size(both) / (F.log1p(F.size("tokens").cast("double")) + 1.0)
    points = coverage + specific * 0.3 + phrase_bonus(F.col("q_tokens"), F.lower("text")) + F.size(in_section) * 2.0 / size
    boost = F.when(F.col("file_name").isin(*BUILT_IN), 1.0).otherwise(1.15)
    return d.select("q_id", "chunk_key", F.round(points * boost, 10).alias("score"))  # equal passages tie


def keyword_topk(questions: DataFrame, chunks: DataFrame, k: int = 5, least: float = 0.10) -> DataFrame:
    """The k best of at least `least`; what is below ranks behind, so it goes after the ranking and scores are worked out once."""
    return top(keyword_scores(questions, chunks), k).where(F.col("score") >= least)


#: Query vectors that are held at once.
QUERIES = 4096


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a stated set of queries, some thousands at a time, so that neither driver nor task holds them all."""
    kept = queries.where(F.col("embedding").isNotNull()).select("q_id", "embedding")
    blocks = max(1, -(-kept.count() // QUERIES))
    for k in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == k).collect()
        if rows:
            yield np.array([r.q_id for r in rows]), unit([list(r.embedding) for r in rows])


def unit(rows: list, width: int = 0) -> np.ndarray:
    """Vectors of length 1 (zero ones stay zero), padded with zeros to one width: so a product runs over the shared length."""
    width = max([width, *map(len, rows)])
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def products(batch: pa.RecordBatch, vectors: np.ndarray) -> np.ndarray:
    """Cosines of a batch's vectors (column 1) and the queries, rounded so that equal vectors tie."""
    own = unit(batch.column(1).to_pylist(), vectors.shape[1])
    return np.round(own @ np.pad(vectors, ((0, 0), (0, own.shape[1] - vectors.shape[1]))).T, 12)


def _compared(queries: DataFrame, vectors: DataFrame, make: Callable) -> DataFrame:
    """Union over blocks of queries of what `make(ids, unit vectors)` yields over batches (chunk_key, embedding)."""
    kept = vectors.where(F.col("embedding").isNotNull()).select("chunk_key", F.col("embedding").cast("array<double>").alias("embedding"))
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    out = f"q_id {kind(queries, 'q_id')}, chunk_key {kind(vectors, 'chunk_key')}, score double"
    kinds = [to_arrow_type(queries.schema["q_id"].dataType), to_arrow_type(vectors.schema["chunk_key"].dataType), pa.float64()]

    def typed(compare: Callable) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in compare(batches):
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(batch.columns, kinds, strict=True)], batch.schema.names)

        return run

    parts = [kept.mapInArrow(typed(make(ids, own)), out) for ids, own in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else kept.sparkSession.createDataFrame([], out)


def cosine_scores(queries: DataFrame, vectors: DataFrame, least: float = -2.0) -> DataFrame:
    """(q_id, chunk_key, score) of a stated set of query vectors against all vectors, from `least` on: matrix products over Arrow batches."""

    def make(ids: np.ndarray, own: np.ndarray):
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = products(batch, own)
                row, col = np.nonzero(got >= least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[col]), batch.column(0).take(pa.array(row)), pa.array(got[row, col])], ["q_id", "chunk_key", "score"])

        return compare

    return _compared(queries, vectors, make)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """The k best vectors of each query; a task hands on k of each query, whatever it has read."""

    def make(ids: np.ndarray, own: np.ndarray):
        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for batch in batches:
                got = products(batch, own)
                key = np.array(batch.column(0).to_pylist())
                order = np.argsort(key, kind="stable")
                best = order[np.argsort(-got[order], axis=0, kind="stable")[:k]]
                for col in range(len(ids)):
                    rows = best[:, col]
                    rows = rows[got[rows, col] >= threshold]
                    held += [(got[r, col], key[r], col) for r in rows]
                if len(held) > 2 * k * len(ids):
                    held = kept(held)
            if held:
                held = kept(held)
                yield pa.RecordBatch.from_arrays([pa.array(ids[[x[2] for x in held]]), pa.array([x[1] for x in held]), pa.array([float(x[0]) for x in held])], ["q_id", "chunk_key", "score"])

        def kept(held: list[tuple]) -> list[tuple]:
            held.sort(key=lambda x: (x[2], -x[0], x[1]))
            out, run, last = [], 0, None
            for x in held:
                run = run + 1 if x[2] == last else 1
                last = x[2]
                if run <= k:
                    out.append(x)
            return out

        return compare

    return top(_compared(queries, vectors, make), k)


def progressive(scored: DataFrame, k: int = 5, threshold: float = 0.50) -> DataFrame:
    """Scores are computed once; per query the threshold steps down by 0.15 and 0.25 until the best passes it by 0.08."""
    best = F.max("score").over(Window.partitionBy("q_id"))
    limit = F.when(best >= threshold + 0.08, threshold).when(best >= threshold - 0.15 + 0.08, threshold - 0.15).otherwise(threshold - 0.25)
    return top(scored.withColumn("_limit", limit).where(F.col("score") >= F.col("_limit")).drop("_limit"), k)


def first_matches(ranked: DataFrame) -> DataFrame:
    """(chunk_key, q_id, score): of chunks that several queries match, the match of the first query, so that a reference is shown once."""
    best = F.min_by(F.struct("q_id", "score"), F.struct("q_id", "rank")).alias("m")
    return ranked.groupBy("chunk_key").agg(best).select("chunk_key", "m.q_id", "m.score")


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = 5, constant: int = 60) -> DataFrame:
    """Extension for hybrid search: sum of 1 / (constant + rank) over both rankings."""
    every = first.select("q_id", "chunk_key", "rank").unionByName(second.select("q_id", "chunk_key", "rank"))
    return top(every.groupBy("q_id", "chunk_key").agg(F.sum(F.lit(1.0) / (F.col("rank") + constant)).alias("score")), k)


def acronym_hits(questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """First chunks that spell out the acronym a question asks for: 'X (Full Name)', 'X - Full' or 'Full Name (X)'.

    Only chunks that hold the acronym as a word meet a question (an equi-join on words), whatever the number of questions; and only those with
    a bracket, dash or colon at it, which is quickly seen, are searched for names, as that goes back over six words at each word.
    """
    asked = questions.withColumn("acronym", F.upper(F.regexp_extract("question", "(?i)" + qa.ACRONYM, 1))).where("acronym <> ''").select("q_id", "acronym")
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z0-9_]{1,10})"), F.lit(1)), F.upper))
    held = chunks.select("chunk_key", "text", F.explode(words).alias("acronym")).join(asked, "acronym")
    spelled = F.concat(F.lit(r"(?i)(?:\b"), "acronym", F.lit(r"\s*[\(—\-:]\s*([A-Z][^\)]{3,60})|\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5})\s*\(\s*"), "acronym", F.lit(r"\s*\))"))
    marked = F.concat(F.lit(r"(?i)\b"), "acronym", F.lit(r"\s*[\(—\-:]|\(\s*"), "acronym", F.lit(r"\s*\)"))
    hits = held.where(F.call_function("rlike", F.col("text"), marked) & F.call_function("rlike", F.col("text"), spelled))
    return top(hits.select("q_id", "chunk_key", F.lit(2.0).alias("score")), k)


def file_overview(chunks: DataFrame, first: int = 7) -> DataFrame:
    return chunks.where(F.col("chunk_id") < first).withColumn("score", F.lit(1.0))


def stem_words(file_name: Column) -> Column:
    """Words of three letters or more of a file's name without its suffix."""
    stem = F.lower(F.regexp_replace(file_name, r"\.[^.]*$", ""))
    return F.filter(F.split(F.trim(F.regexp_replace(stem, r"[_\-]+", " ")), r"\s+"), lambda t: F.char_length(t) > 2)


def file_questions(questions: DataFrame, files: DataFrame, block: int = 500) -> DataFrame:
    """(q_id, file_name): the file of which the question holds two words (one, of names of two words); the longest name first, then by name.

    The questions are a stated set and meet the files in blocks, so neither side has to be small and nothing is exchanged but hits.
    """
    named = files.select("file_name", stem_words(F.col("file_name")).alias("stem"))
    kept = questions.select("q_id", F.lower("question").alias("q"))
    blocks = max(1, -(-kept.count() // block))
    hits = []
    for k in range(blocks):
        rows = kept.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == k).collect()
        asked = F.array(*[F.struct(F.lit(r.q_id).alias("q_id"), F.lit(r.q).alias("q")) for r in rows]) if rows else F.array().cast("array<struct<q_id:int,q:string>>")
        held = lambda a: F.size(F.filter("stem", lambda t: F.contains(a["q"], t)))
        met = F.filter(asked, lambda a: held(a) >= F.when(F.size("stem") > 2, 2).otherwise(1))
        hits.append(named.where(F.size("stem") > 0).select("file_name", F.explode(met).alias("a")).select("a.q_id", "file_name"))
    every = reduce(DataFrame.unionByName, hits)
    return every.groupBy("q_id").agg(F.min_by("file_name", F.struct(-F.char_length("file_name"), F.col("file_name"))).alias("file_name"))


def embedded(c: Column, size: int = 64) -> Column:
    """A stand-in for a model: every token adds 1 or -1 at one of `size` places, by digits of its MD5.  Any other embedder is a function of a column as well."""
    tokens = content_tokens(c)
    digits = lambda t, at, n: F.conv(F.substring(F.md5(t.cast("binary")), at, n), 16, 10).cast("int")
    placed = F.transform(tokens, lambda t: F.struct((digits(t, 1, 2) % size).alias("at"), F.when(digits(t, 3, 1) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))
    add = lambda i: F.aggregate(F.filter(placed, lambda p: p["at"] == i), F.lit(0.0), lambda s, p: s + p["sign"])
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), add)


def index_of(chunks: DataFrame, embed: Callable[[Column], Column] = embedded) -> DataFrame:
    """chunks with their vectors: what an index holds; a chunk without text has none (and keeps its place)."""
    return chunks.withColumn("embedding", F.when(F.trim("text") != "", embed(F.col("text"))))


def retrieve(questions: DataFrame, chunks: DataFrame, embed: Callable | None = None, k: int = 5, threshold: float = 0.75) -> DataFrame:
    """(q_id, chunk_key, rank, score, method): vectors if there is an embedder, and keywords for questions that they give nothing."""
    words = keyword_topk(questions, chunks, k).withColumn("method", F.lit("keywords"))
    if embed is None:
        return words
    found = cosine_topk(questions.select("q_id", embed(F.col("question")).alias("embedding")), index_of(chunks, embed), k, threshold).withColumn("method", F.lit("vectors"))
    rest = words.join(found.select("q_id").distinct(), "q_id", "left_anti")
    return found.select("q_id", "chunk_key", "rank", "score", "method").unionByName(rest.select("q_id", "chunk_key", "rank", "score", "method"))


def answers(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(q_id, status, strategy, confidence, n_sources, first_source, excerpt): the whole way of a question without a language model.

    Refused, unclear and validation questions end at once.  Others take the first chunks of the file they name (overview), chunks that
    spell out an acronym, or the best by keywords; without any they are guidance, if they ask how to write a section, else not found.
    Every way reads the chunks, so they and their tokens are made once and written.
    """
    chunks = written(tokenized(chunks), "passages")
    q = questions.select("q_id", "question", qa.intent(F.col("question")).alias("intent"), qa.is_guidance(F.col("question")).alias("guided"))
    open_ = q.where(F.col("intent").isin("overview", "search"))
    named = file_questions(open_.where("intent = 'overview'"), chunks.select("file_name").distinct())
    overview = named.join(file_overview(chunks), "file_name").select("q_id", "chunk_key", F.lit(1.0).alias("score"), F.lit("overview").alias("strategy"))
    acronym = acronym_hits(open_, chunks).select("q_id", "chunk_key", "score", F.lit("acronym").alias("strategy"))
    words = keyword_topk(open_.select("q_id", "question"), chunks).select("q_id", "chunk_key", "score", F.lit("keywords").alias("strategy"))
    first = overview.unionByName(acronym.join(overview.select("q_id").distinct(), "q_id", "left_anti"))
    every = first.unionByName(words.join(first.select("q_id").distinct(), "q_id", "left_anti"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "chunk_key")))
    per = every.groupBy("q_id", "strategy").agg(order.alias("o"))
    per = per.withColumn("level", confidence_from_scores(F.transform("o", lambda x: -x["s"])))
    told = chunks.select(F.col("chunk_key").alias("first_source"), F.when(F.char_length(F.trim("text")) > 500, F.concat(F.substring(F.trim("text"), 1, 497), F.lit("..."))).otherwise(F.trim("text")).alias("excerpt"))
    d = q.join(per.withColumn("first_source", F.get("o", F.lit(0))["chunk_key"]).join(told, "first_source", "left"), "q_id", "left")
    kind = F.col("intent")
    status = (
        F.when(kind == "standards", "refusal").when(kind == "clarify", "clarify").when(kind == "validate", "validate")
        .when(F.col("o").isNull(), F.when(F.col("guided") & qa.section_of(F.col("question")).isNotNull(), "guidance").otherwise("not_found")).when(F.col("level") == "LOW", "partial").otherwise("answered")
    )
    return d.select("q_id", status.alias("status"), F.coalesce("strategy", F.lit("")).alias("strategy"), F.coalesce("level", F.lit("")).alias("confidence"), F.coalesce(F.size("o"), F.lit(0)).alias("n_sources"), "first_source", "excerpt")

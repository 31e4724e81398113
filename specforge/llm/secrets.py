"""Secret scans by a trigram inverted index, in DataFrame functions only.

The index is made of the texts alone, whatever the rules: every trigram of every lower-cased text, kept as a 32-bit hash.  Its
postings are bit masks: ``BLOCK`` neighbouring rows of a file are a block, and a row of the index holds a block, a trigram and
one bit for each of the block's documents that has it.  The masks are built by a bitwise aggregate, so that a trigram that
every text holds is a few numbers a block and no hot key.

From each rule's regular expression a Boolean query over trigrams is derived: literal runs, with small classes, options and
branches spelled out, must occur, so all their trigrams must.  A rule's candidates are intersections of masks within a clause
and their unions over clauses.  Only candidates are verified with the expression (a hash that two trigrams share only makes a
candidate more); rules without a mandatory trigram scan every text.

Spans are code points, end exclusive, leftmost and non-overlapping per kind.  A null text is empty.  Rows are known by their places in
the files, so rows with equal or null doc_ids are scanned each by itself, and columns may have any name.  Empty tables give
empty results.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm.common import PLACE, placed, table, written

#: Documents of a block (four masks of 64 bits).
BLOCK, WORD = 256, 64
WORDS = BLOCK // WORD
#: Characters of a text from which trigrams are drawn at once.
SEGMENT = 4096
#: Trigrams that a literal run contributes at most; leaving some out only weakens the query.
PER_RUN = 4
#: Spelled-out strings per run at most.
SPELLED = 16
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """kind; expression (alike in Java and Python); the group whose length counts (0: the match) and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so shorter ones can't hide a longer one
)
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


# ---------------------------------------------------------------- Boolean queries
def literal_runs(pattern: str) -> list[set[str]]:
    """Runs that every match holds, each as the set of strings that it may be (lower case)."""
    runs: list[set[str]] = []

    def spelled(node) -> set[str] | None:
        """All strings of an item, or None if they are many."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            chars: set[str] = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return product(arg[-1])
        if op is sre.BRANCH:
            parts = [product(x) for x in arg[1]]
            return None if any(x is None for x in parts) else bounded(set().union(*parts))
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            part = product(arg[2])
            return None if part is None else bounded(part | {""} if arg[0] == 0 else part)
        return None

    def bounded(strings: set[str]) -> set[str] | None:
        return strings if len(strings) <= SPELLED else None

    def product(items) -> set[str] | None:
        out: set[str] | None = {""}
        for x in items:
            part = spelled(x)
            out = None if part is None or out is None else bounded({a + b for a in out for b in part})
        return out

    def walk(items) -> None:
        now = {""}
        for node in items:
            part = spelled(node)
            if part is not None and (joined := bounded({a + b for a in now for b in part})) is not None:
                now = joined
                continue
            runs.append(now)
            now = {""}
            op, arg = node
            if op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2])
        runs.append(now)

    walk(sre_parser.parse(pattern))
    return runs


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams that every matching text satisfies; empty if none is mandatory."""
    clauses: list[frozenset[str]] = []
    for run in literal_runs(pattern):
        if any(len(x) < 3 for x in run):
            continue
        own = [frozenset(x[i : i + 3] for i in range(min(len(x) - 2, PER_RUN))) for x in sorted(run)]
        crossed = [a | b for a in clauses for b in own] if clauses else own
        clauses = crossed if len(crossed) <= SPELLED else clauses
    return list(dict.fromkeys(clauses))


# ---------------------------------------------------------------- index and candidates
def hashed(trigram: Column) -> Column:
    return F.hash(trigram)


def trigram_index(rows: DataFrame) -> DataFrame:
    """(_file, _block, gram, w0, w1, ..): postings of every trigram of the lower-cased texts of placed rows, as masks of a block's documents."""
    low = F.lower(F.coalesce("_doc.text", F.lit("")))
    at = F.col("_row") % BLOCK
    d = rows.select("_file", F.floor(F.col("_row") / BLOCK).alias("_block"), at.alias("_at"), low.alias("_low"))
    # segments overlap by two characters, so that no trigram is lost between them
    d = d.select("_file", "_block", "_at", F.explode(F.regexp_extract_all("_low", F.lit(f"(?s)(?=(.{{1,{SEGMENT + 2}}})).{{1,{SEGMENT}}}"), F.lit(1))).alias("_segment"))
    d = d.select("_file", "_block", "_at", F.explode(F.regexp_extract_all("_segment", F.lit("(?s)(?=(.{3}))"), F.lit(1))).alias("_gram"))
    d = d.select("_file", "_block", hashed(F.col("_gram")).alias("gram"), F.floor(F.col("_at") / WORD).alias("_word"), F.expr(f"shiftleft(1L, cast(_at % {WORD} as int))").alias("_bit"))
    masks = [F.bit_or(F.when(F.col("_word") == k, F.col("_bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS)]
    return d.groupBy("_file", "_block", "gram").agg(*masks)


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_file, _row, c0, c1, ...): rows that rule k's trigram query lets through; rules without a query have no column here."""
    asked = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    index = written(trigram_index(rows), "trigrams")
    trigrams = sorted({t for q in asked.values() for clause in q for t in clause})
    numbers = dict(zip(trigrams, rows.sparkSession.range(1).select(F.array(*[hashed(F.lit(t)) for t in trigrams])).first()[0], strict=True)) if trigrams else {}
    none = F.lit(0).cast("long")
    masks = F.struct(*[f"w{k}" for k in range(WORDS)])
    lists = index.where(F.col("gram").isin(list(numbers.values()))).groupBy("_file", "_block").agg(F.map_from_entries(F.collect_list(F.struct("gram", masks))).alias("_lists"))

    def found(query: list[frozenset[str]], word: int) -> Column:
        held = lambda t: F.coalesce(F.get(F.array(F.try_element_at("_lists", F.lit(numbers[t]))), F.lit(0))[f"w{word}"], none)
        return reduce(lambda a, b: a.bitwiseOR(b), [reduce(lambda a, b: a.bitwiseAND(b), [held(t) for t in sorted(clause)]) for clause in query])

    hits = lists.select("_file", "_block", *[F.array(*[found(q, w) for w in range(WORDS)]).alias(f"h{k}") for k, q in asked.items()])
    every = hits.select("*", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1))).alias("_at"))
    bit = lambda k: F.expr(f"shiftrightunsigned(h{k}[cast(_at div {WORD} as int)], _at % {WORD}) & 1L") == 1
    marked = every.select("_file", (F.col("_block") * BLOCK + F.col("_at")).alias("_row"), *[bit(k).alias(f"c{k}") for k in asked])
    return marked.where(reduce(lambda a, b: a | b, [F.col(f"c{k}") for k in asked], F.lit(False)))


# ---------------------------------------------------------------- verification
def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, rule, end>> of a rule's matches: the pieces between them and the matches give the places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(F.transform(pieces, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("size"), F.transform(counted, F.char_length).alias("counted"))
    kind = "array<struct<start:long,rule:int,end:long>>"
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("spans"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        end = begin + F.coalesce(row["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        more = F.when(row["counted"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), more.alias("spans"))

    return F.aggregate(F.filter(rows, lambda r: r["gap"].isNotNull()), first, step, lambda a: a["spans"])


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(_doc, _spans): a row of docs as a struct, whatever its columns are called, and all spans by start, then rule."""
    rows = placed(docs)
    some = written(candidates(rows, rules), "candidates")
    text = F.coalesce("_doc.text", F.lit(""))
    joined = rows.withColumn("_text", text).join(some, PLACE, "left")
    empty = F.array().cast("array<struct<start:long,rule:int,end:long>>")
    parts = []
    for k, rule in enumerate(rules):
        asked = F.coalesce(F.col(f"c{k}"), F.lit(False)) if f"c{k}" in some.columns else F.lit(True)
        parts.append(F.when(asked & F.col("_text").rlike(rule.pattern), spans_of(F.col("_text"), rule, k)).otherwise(empty))
    return joined.select("_doc", F.array_sort(F.concat(*parts)).alias("_spans"))


def told(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    found = scanned(docs.select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["rule"] < len(BASE))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["rule"] == k)).cast("long")
    return found.select(
        F.col("_doc.doc_id").alias("doc_id"),
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(told(base, RULES).cast("binary"), 256).alias("base_sha256"),
        told(F.col("_spans"), RULES).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of a secret replaced by MASK; overlapping spans become one mask.  n_chars follows the text."""
    found = scanned(docs)
    text = F.col("_doc.text")
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), fresh.alias("out"))

    masked = F.aggregate("_spans", first, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.char_length(text))))
    some = F.size("_spans") > 0
    new = found.withColumn("_new", F.when(some, masked).otherwise(text))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(some, F.char_length("_new").cast("long")).otherwise(F.col("_doc.n_chars")).cast(dict(docs.dtypes)[c]).alias(c))
        else:
            columns.append(F.col(f"_doc.`{c}`"))
    return new.select(*columns)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))

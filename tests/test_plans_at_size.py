"""What queries do to large tables, read from their plans: passes, exchanges and copies of expressions."""

import re

from pyspark.sql import functions as F

from specforge import lexicon
from specforge.functions import text as T
from specforge.operators import chunking, conformity, matrices, retrieval
from specforge.plans import conformity_queries, question_queries
from specforge.tables import written


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_findings_search_each_comment_once(spark):
    """One search a pattern (and one for all, one for domains); copies in filters made them several hundred."""
    items = spark.createDataFrame([("OK", "cannot be met"), ("OK", None), ("OK", " \t"), ("OK", "sw/ee"), ("NOK", "cannot be met")], "category string, comment string")
    d = conformity.ok_suspicions(items)
    assert plan(d).count("RLIKE") <= len(lexicon.SUSPICIONS) + 2
    assert [(r.comment, [s.label for s in r.signals], r.severity) for r in d.collect()] == [("cannot be met", ["cannot"], "warning")]


def test_matrix_rows_stay_where_they_are(spark, sf_dir):
    """Four passes over the rows (headers, ranges, columns, items), joined with a row a file that is sent to them."""
    d = conformity_queries.matrix_findings(spark, sf_dir)
    assert len(re.findall(r"Relation \[", plan(d))) <= 4
    assert "SortMergeJoin" not in d._jdf.queryExecution().sparkPlan().toString()


def test_many_files_give_the_same_items(spark, monkeypatch):
    """Files past the limit are exchanged instead of sent; cells that are missing, null or blank, and a file without rows behind its header."""
    head = ["Requirement", "Ref", "Supplier status", "Supplier comments"]
    rows = [(f, 0, "One", k, cells) for f in ("a", "b") for k, cells in enumerate([head, ["REQ-1", None, " OK\t", "x\n y"], ["REQ-2"], [" ", None], ["BLOCK"], ["REQ-3", "r", "nok", "\x0bv2 "]])]
    d = spark.createDataFrame([*rows, ("c", 0, "One", 0, head)], "file_name string, sheet_idx int, sheet_name string, row_index int, cells array<string>")
    few = sorted(map(tuple, matrices.items(d).collect()))
    monkeypatch.setattr(matrices, "FEW", 0)
    assert sorted(map(tuple, matrices.items(d).collect())) == few
    assert [(r[0], r[2], r[3], r[7], r[8], r[9]) for r in few if r[0] == "a"] == [("a", 1, "REQ-1", "OK", "x\n y", ""), ("a", 2, "REQ-2", "EMPTY", "", ""), ("a", 3, "", "EMPTY", "", ""), ("a", 5, "REQ-3", "NOK", "", "v2")]


def test_strip_and_normalize_as_patterns(spark):
    texts = ["", " ", "a", "\t a  b\n", "a\tb", "a \r\n b c", "É\x0bt  é", "a b c", None, " a ", "x \t"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.regexp_replace("t", r"^\s+|\s+$", "")
    whole = F.regexp_replace(F.translate(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), r"^\s+|\s+$", ""), T.ACCENTED, T.PLAIN), r"\s+", " ")
    for r in d.select(T.strip(F.col("t")).alias("s"), plain.alias("p"), T.normalize(F.col("t")).alias("n"), whole.alias("w")).collect():
        assert (r.s, r.n) == (r.p, r.w)


def test_passages_of_long_documents(spark):
    """No fold that copies what it has gathered at every line; a document of 60,000 lines beside odd ones, ids of another type."""
    lines = [("1.2 Roles", "word " * 30, "", "x y ")[k % 4] for k in range(60_000)]
    d = spark.createDataFrame([("long", "\n".join(lines)), ("none", None), ("blank", " \n\n"), ("bare", "SCOPE OF WORK")], "doc_id string, text string")
    out = chunking.with_overlap(d)
    assert "aggregate(" not in plan(out)
    got = {(r.doc_id, r.chunk_id): (r.section, r.text) for r in out.collect()}
    paragraphs, want, held = ["x y"] * 15_000 + ["word " * 29 + "word"] * 15_000, [], []
    paragraphs[::2], paragraphs[1::2] = paragraphs[15_000:], paragraphs[:15_000]
    for p in paragraphs:
        if held and sum(map(len, held)) + len(p) > 900:
            want.append(" ".join(held))
            tail = []
            while held and sum(map(len, tail)) + len(held[-1]) <= 180:
                tail.insert(0, held.pop())
            held = tail
        held.append(p)
    assert got == {("long", k): ("1.2 Roles", t) for k, t in enumerate([*want, " ".join(held)])}


def test_acronyms_are_marked_before_names_are_searched(spark):
    """What the search for names finds, found behind the quick test too; and that test stands first."""
    texts = ["ASU: Alarm Siren Unit", "the Alarm Siren Unit ( asu ) rings", "ASU rings (asu", "asu — Alarm", "XASU: Alarm Siren", "Alarm ASU", "Unit (ASU)", "Alarm Unit\n(ASU)", "asu(alarm siren)", "ASU-al", "ASU \t- alarms"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_key long, text string")
    asked = spark.createDataFrame([(1, "What does ASU stand for?"), (2, "nothing")], "q_id int, question string")
    hits = retrieval.acronym_hits(asked, chunks, k=20)
    spelled = re.compile(r"\bASU\s*[\(—\-:]\s*([A-Z][^\)]{3,60})|\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,5})\s*\(\s*ASU\s*\)", re.IGNORECASE)
    assert sorted(r.chunk_key for r in hits.collect()) == [k for k, t in enumerate(texts) if spelled.search(t)]
    assert plan(hits).count("RLIKE") == 2


def test_a_question_reads_chunks_that_were_made_once(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(retrieval, "written", lambda d, what: made.append(what) or written(d, what))
    d = question_queries.ask_pipeline(spark, sf_dir)
    assert made == ["passages"] and "part.parquet" not in " ".join(d.inputFiles()) and "MapInArrow" not in plan(d)

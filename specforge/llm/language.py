"""Language identification by rank-order profiles.

A profile is the list of the ``TOP`` most frequent n-grams of letters (one to three, words bounded by a blank), most frequent
first.  A document gets the language whose profile its own is least out of place with: for every n-gram the difference
of its ranks, or ``TOP`` if the language lacks it.

Profiles are learned from at most ``SAMPLE`` labelled rows a language, drawn by a hash of their number (the least first, then by
their place in the files) among the documents that aren't held out; every whole text is classified.  Profiles are held in
blocks of ``BLOCK`` languages; where there are more, texts go through the blocks one after the other with their best language so far.

Nulls and texts without letters are ``und`` with score 0; so is everything if nothing was learned.  Documents without a
language or a number aren't learned from.  Ties go to the first language by name.  Repeated rows are classified each, and each counts
for itself in the sample.  Empty tables give no rows; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.llm.common import PLACE, placed, small_batches, table, written

TOP = 400
SAMPLE = 400
#: Languages whose profiles a task holds at once (400,000 numbers).
BLOCK = 1000
#: Codes that are counted at once while a profile is learned.
COUNTED = 1 << 21
GAP = 1  # code point that stands for everything but letters


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text's letters, 21 bits a letter; empty if it has none."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64)
    points = np.concatenate(([GAP], np.where(is_letter, points, GAP), [GAP]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != GAP) | (points[:-1] != GAP)
    p = points[keep]
    pairs = p[:-1] << 21 | p[1:]
    triples = pairs[:-1] << 21 | p[2:]
    return np.concatenate((p[p != GAP], pairs, triples))


def ranked(codes: np.ndarray) -> np.ndarray:
    """The TOP most frequent codes, most frequent first, ties by code."""
    return most_frequent(*np.unique(codes, return_counts=True))


def most_frequent(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    if len(values) > TOP:
        edge = np.partition(n, len(n) - TOP)[len(n) - TOP]
        values, n = values[n >= edge], n[n >= edge]
    return values[np.argsort(-n, kind="stable")][:TOP]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled(docs: DataFrame) -> DataFrame:
    """(lang, text): SAMPLE rows a language at most, by a hash of their number and then by place."""
    rows = placed(docs)
    d = rows.select(*PLACE, F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"), F.col("_doc.lang").cast("string").alias("lang"))
    labelled = d.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = written(labelled.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_size")).withColumnRenamed("lang", "_lang"), "languages", 4)
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30))
    # a draw of about twice the sample's numbers first, so that a frequent language brings no more rows to its task than a rare one
    near = labelled.select(*PLACE, drawn.alias("_drawn"), "lang").join(sizes, F.col("lang") == F.col("_lang")).where(F.col("_drawn") <= F.lit(2.0 * SAMPLE * (1 << 30)) / F.col("_size"))
    order = Window.partitionBy("lang").orderBy("_drawn", *PLACE)
    chosen = written(near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE).select(*PLACE), "sample", 4)
    return labelled.join(chosen, PLACE, "left_semi").select("lang", F.coalesce("text", F.lit("")).alias("text"))


def counted(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) over texts; so many codes at once that memory doesn't grow with the texts."""
    codes, n, held, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
    for text in (*texts, None):
        if text is not None:
            held.append(grams(text))
            size += len(held[-1])
        if held and (text is None or size >= COUNTED):
            more, times = np.unique(np.concatenate(held), return_counts=True)
            every, place = np.unique(np.concatenate((codes, more)), return_inverse=True)
            n = np.bincount(place, np.concatenate((n, times)), len(every)).astype(np.int64)
            codes, held, size = every, [], 0
    return codes, n


def profiles(docs: DataFrame) -> DataFrame:
    """lang, code, rank: the learned profiles, TOP rows a language at most."""

    def learn(own: pd.DataFrame) -> pd.DataFrame:
        codes = most_frequent(*counted(own.text))
        return pd.DataFrame({"lang": own.lang.iloc[0], "code": codes, "rank": np.arange(len(codes))})

    return written(sampled(docs).groupBy("lang").applyInPandas(learn, "lang string, code long, rank long"), "profiles", 4)


class Profiles:
    """Ranks of some languages' n-grams as a matrix."""

    def __init__(self, learned: pd.DataFrame):
        self.langs = sorted(learned.lang.unique())
        self.known = np.unique(learned.code.to_numpy(np.int64))
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for k, lang in enumerate(self.langs):
            own = learned[learned.lang == lang]
            self.ranks[k, np.searchsorted(self.known, own.code.to_numpy(np.int64))] = own["rank"].to_numpy()

    def nearest(self, own: np.ndarray) -> tuple[str, int]:
        """The language that a document's ranked codes are least out of place with, and by how much."""
        at = np.searchsorted(self.known, own)
        at[at == len(self.known)] = 0
        at = np.where(self.known[at] == own, at, len(self.known))
        theirs = self.ranks[:, at]
        away = np.where(theirs < 0, TOP, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], int(away[best])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    learned = profiles(docs)
    langs = sorted(r.lang for r in learned.select("lang").distinct().collect())
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", held_out().alias("held_out"), "text", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("long").alias("away"), F.lit(0).cast("long").alias("n"))
    for first in range(0, len(langs), BLOCK):
        some = learned.where(F.col("lang").between(langs[first], langs[min(first + BLOCK, len(langs)) - 1])).toPandas()
        d = d.mapInArrow(passed(Profiles(some)), f"doc_id {kind}, held_out boolean, text string, lang_pred string, away long, n long")
    found = F.col("n") > 0
    score = F.when(found, 1 - F.col("away") / (F.lit(TOP) * F.col("n"))).otherwise(0.0)
    return d.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def passed(own: Profiles):
    """Rows with their best language so far, once more compared with these profiles (the earlier language stays in a tie)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lang, away in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                codes = ranked(grams(text)) if text else ()
                if len(codes):
                    other, far = own.nearest(codes)
                    lang, away = (other, far) if away is None or far < away else (lang, away)
                rows.append((lang, away, len(codes)))
            columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "held_out", "text", "lang_pred", "away", "n"])

    return compare


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents"))

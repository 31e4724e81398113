"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest document that fits; then its smallest document is replaced with two unpacked
documents that fit the expanded gap more tightly, as long as that helps.  Only lengths matter for that, and lengths are at
most one sequence, so the plan is made on a histogram of at most ``capacity`` counts: equal bins are filled at once, as often
as the counts allow.  Documents then find their place by their rank among pieces of their length: a rank within the task that
tokenised them plus an offset per task and length.  Texts are never shuffled, and a length that a third of all pieces have
is ranked in as many parts as there are tasks.

Documents longer than a sequence are cut so that only the first piece may be shorter.  A null or empty text is its end
token alone.  Repeated rows are separate documents under one number.  Empty tables give no pieces.  Ids are those of the
vocabulary file (chunks of plain words may be looked up in the same vocabulary's rank file); strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm.common import long_ids, small_batches, sums_before, table, written

CAPACITY = 2048
END = 0
#: Chunks of texts whose ids a worker remembers at most; then it forgets them all.
REMEMBERED = 400_000
#: Texts that are looked up at once.
TOGETHER = 200
WHITE = " \n\t\r"
#: White space with the letters behind it, or with any other word.  No token of this vocabulary spans a change from a word to
#: white space, nor one from letters to an ASCII character that isn't a letter.
LATIN = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
CHUNK = re.compile(rf"[ \n\t\r]*[{LATIN}]++(?![^\x00-\x7f])|[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Other white space, which could join a run across chunks: such texts are tokenised whole.
ODD_SPACE = (0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ODD = re.compile("[" + "".join(map(chr, ODD_SPACE)) + "]")


def merges(ranks: str):
    """Function text -> ids of the same vocabulary, given as ranks; it joins bytes several times faster, to the same ids."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        table_ = {base64.b64decode(word): int(number) for word, number in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary


class Places(dict):
    """Chunks by number; a new one gets the next number and is noted as fresh."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        self.fresh.append(chunk)
        return number


class Ids:
    """Token ids of texts by way of remembered chunks."""

    def __init__(self, vocabulary: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of their own would only cost memory
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        words = self.tokenizer.get_vocab()  # byte-level: a character stands for a byte
        self.bytes = np.zeros(max(words.values()) + 1, np.int64)
        for word, number in words.items():
            self.bytes[number] = len(word)
        self.quick = merges(ranks) if ranks else None
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.flat, self.offsets, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Chunks that begin with a blank and end in a word are tokenised as one text and told apart by the bytes of their tokens."""
        plain = [c[0] == " " and c[-1] not in WHITE for c in chunks]
        joined, single = list(compress(chunks, plain)), [c for c, p in zip(chunks, plain, strict=True) if not p]
        encode, text = self.tokenizer.encode_batch_fast, "".join(joined)
        flat = np.array(self.quick(text) if self.quick else encode([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, joined if text.isascii() else map(str.encode, joined)), np.int64, len(joined)))
        upto = np.searchsorted(np.cumsum(self.bytes[flat]), ends) + 1
        rest = [x.ids for x in encode(single, add_special_tokens=False)]
        sizes = np.concatenate([np.diff(upto, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        offsets = len(self.flat) + np.cumsum(sizes) - sizes
        order = np.argsort(~np.array(plain, bool), kind="stable")  # joined ones first, as they lie in flat
        own = np.empty((2, len(chunks)), np.int64)
        own[:, order] = offsets, sizes
        self.offsets, self.lengths = np.concatenate([self.offsets, own[0]]), np.concatenate([self.lengths, own[1]])
        self.flat = np.concatenate([self.flat, flat, np.fromiter(chain.from_iterable(rest), np.uint32)])

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; some texts are looked up at once."""
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            if len(self.place) > REMEMBERED:
                self.forget()
            chunks = [None if ODD.search(t) else CHUNK.findall(t) for t in some]
            n = sum(len(own) for own in chunks if own)
            index = np.fromiter(map(self.place.__getitem__, chain.from_iterable(own for own in chunks if own)), np.int64, n)
            if self.place.fresh:
                self.learn(self.place.fresh)
                self.place.fresh = []
            sizes = self.lengths[index]
            upto = np.cumsum(sizes)
            ids = self.flat[np.repeat(self.offsets[index] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
            begin, seen = 0, 0
            for text, own in zip(some, chunks, strict=True):
                if own is None:
                    yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                    continue
                seen += len(own)
                end = int(upto[seen - 1]) if own else begin
                yield ids[begin:end]
                begin = end


@lru_cache(1)
def ids_of(vocabulary: str, ranks: str | None) -> Ids:
    """One tokeniser a worker, whatever the number of its tasks."""
    return Ids(vocabulary, ranks)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank counts pieces of this length within the task."""
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = ids_of(vocabulary, ranks), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, own in zip(batch.column(0).to_pylist(), ids.of(texts), strict=True):
                whole = np.append(own, np.uint32(END)).astype("<u4")
                first = (len(whole) - 1) % capacity + 1
                edges = [0, *range(first, len(whole) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc, k, a, b - a, zlib.crc32(whole[a:b].tobytes()), part, int(seen[b - a])))
                    seen[b - a] += 1
            columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return long_ids(docs, "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


def plan(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places as (length, first rank, end rank, first sequence, offset) for counts[length] pieces of each length."""
    left, used_ranks, sequence, places = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64), 0, []
    while left.any():
        free = left.copy()

        def largest(most: int, free: np.ndarray = free) -> int:
            fitting = np.flatnonzero(free[: most + 1])
            return int(fitting[-1]) if len(fitting) else 0

        bin_, gap = [], capacity
        while (take := largest(gap)) > 0:
            bin_.append(take)
            free[take] -= 1
            gap -= take
        while gap > 0 and len(bin_) > 1:
            small = min(bin_)
            pair = two(free, gap + small, small)
            if pair is None:
                break
            bin_.remove(small)
            free[small] += 1
            for x in pair:
                free[x] -= 1
            bin_ += pair
            gap += small - sum(pair)
        bin_.sort(reverse=True)
        lengths, times = np.unique(bin_, return_counts=True)
        repeat = int((left[lengths] // times).min())
        offset = 0
        for x in bin_:
            first = int(used_ranks[x])
            places.append((x, first, first + repeat, sequence, offset))
            used_ranks[x] += repeat
            left[x] -= repeat
            offset += x
        sequence += repeat
    return places


def two(free: np.ndarray, room: int, over: int) -> list[int] | None:
    """The two free lengths that fill room best, if they fill it better than `over` alone."""
    lengths = np.flatnonzero(free[:room])
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return None
    at = np.searchsorted(lengths, room - lengths, side="right") - 1
    partner = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    alone = (partner == lengths) & (free[lengths] < 2)
    partner = np.where(alone, np.where(at >= 1, lengths[np.maximum(at - 1, 0)], 0), partner)
    best = int(np.argmax(np.where(partner > 0, lengths + partner, 0)))
    if partner[best] == 0 or lengths[best] + partner[best] <= over:
        return None
    return [int(lengths[best]), int(partner[best])]


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    cut = written(pieces(docs, vocabulary, capacity, ranks), "pieces")
    per_task = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    offsets = written(sums_before(per_task, "length", "part", "n").withColumnRenamed("_before", "before"), "offsets")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in offsets.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    places = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    places = places[np.lexsort((places[:, 1], places[:, 0]))]
    keys = (places[:, 0] << 44) | places[:, 1]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            found = places[np.searchsorted(keys, (length << 44) | rank, side="right") - 1] if len(length) else places[:0]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    # offsets grow with the tasks, so they are never broadcast; neither side has texts
    ranked = cut.join(offsets.drop("n").hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), vocabulary_path(), ranks=vocabulary_path("byte_bpe_50k.tiktoken"))

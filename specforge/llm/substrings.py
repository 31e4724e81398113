"""Suffix-array dedup: every byte that a 100-byte string covers which also starts earlier in the corpus is removed.

How windows that are equal find one another without comparing all shards with all:

1. Every 100-byte window holds 69 strings of 32 bytes; the one with the least hash is its anchor.  Equal windows have equal
   anchors.  Consecutive windows with one anchor form a piece.  A task keeps, per anchor and digest of the piece, the first
   occurrence; later ones are removed whole.  (Long repeats consist of equal pieces, so they end here.)
2. Per bucket of anchors the same is done across tasks.  Where one anchor is left with different pieces, their windows may
   still be equal in part: these pieces are asked for.
3. The pieces' bytes go to shards by anchor.  A shard has a suffix array by Larsson-Sadakane refinement; Kasai common prefixes
   of at least 100 bytes make windows equal; shards of one bucket are merged by binary search (see `suffix`).
4. No digest removes anything by itself: a piece that was taken for a copy names the copy before it.  Pieces that lie behind one another in both
   documents are one run; the earlier document's bytes of every run are sent to the later one and compared there, byte by byte.
   (Copies form chains, so a passage that a third of all documents hold is sent once a copy, and no document is asked by all.)
5. A document's removed intervals are united and its other bytes digested.  If any run differed, all is done again with other digests.

Hot passages.  Hashes of 32-byte strings that are frequent in a sample of about ``SAMPLE`` documents get the highest values, so they
are anchors only of windows that hold nothing else, and those have few different pieces.  The sample steers only where windows
meet; the result doesn't depend on it.  A string that a third of all documents hold reaches a bucket once a task.

Nulls: a null text is empty.  Where numbers repeat or are null, rows are ordered by (doc_id, text), each a document of its own, nulls
first.  Texts under 100 bytes lose nothing.  Empty tables give empty results.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm.common import numbers, small_batches, table, text_bytes, written
from specforge.llm.suffix import PAD, WINDOW, not_first, words_at

GRAM = 32
SPAN = WINDOW - GRAM + 1
CHUNK_BYTES = 1 << 20
SHARD_BYTES = 1 << 20
FLUSH = 1_500_000
SAMPLE = 1500
FREQUENT = 8
HOT = 50_000
M1, M2, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
PIECE = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("n", "<i4")])
#: Set in n if the anchor occurs twice within the piece: windows of the piece itself may then be equal.
SELF = 1 << 30
INTERVAL = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
#: A piece that is taken for a copy, and where the copy before it stands; runs of such pieces.
LATER = np.dtype([("doc", "<i8"), ("src", "<i8"), ("at", "<i4"), ("n", "<i4"), ("src_at", "<i4"), ("pad", "<i4")])
RUN = np.dtype([("doc", "<i8"), ("src", "<i8"), ("start", "<i4"), ("end", "<i4"), ("src_at", "<i4"), ("pad", "<i4")])
#: Bits of the digests of each attempt; the words of texts are turned by another number each time.
ATTEMPTS = (64, 64, 64)
TURNS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M1
    return x ^ (x >> np.uint64(29))


@lru_cache(1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, b, np.uint64)))) for b in (BASE, inverse))


def gram_hashes(mixed: np.ndarray, n: int) -> np.ndarray:
    """63-bit hashes of the GRAM-byte strings that start at the first n positions."""
    h = mixed[:n].copy()
    for k in range(8, GRAM, 8):
        h *= M2
        h ^= mixed[k : k + n]
        h ^= h >> np.uint64(32)
    return mix(h * M2) >> np.uint64(1)


class Hot:
    """The frequent strings' hashes, with a bitmap before the search."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(np.uint64))
        self.map = np.zeros(1 << 22, bool)
        self.map[self.hashes >> np.uint64(41)] = True

    def lift(self, h: np.ndarray) -> np.ndarray:
        if len(self.hashes):
            at = np.flatnonzero(self.map[h >> np.uint64(41)])
            place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            at = at[self.hashes[place] == h[at]]
            h[at] |= np.uint64(1 << 63)
        return h


def pieces(docs: list[tuple[int, bytes]], hot: Hot, turn: int = 0, bits: int = 64) -> np.ndarray:
    """All pieces of some documents; digests of so many bits of words that are turned by a number."""
    docs = [x for x in docs if len(x[1]) >= WINDOW]
    if not docs:
        return np.empty(0, PIECE)
    text = np.frombuffer(b"".join(x[1] for x in docs) + bytes(GRAM + 8), np.uint8)
    sizes = np.fromiter((len(x[1]) for x in docs), np.int64, len(docs))
    begins = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    mixed = mix(words_at(text))
    h = hot.lift(gram_hashes(mixed, n - GRAM + 1))
    least, width = h, 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: -(SPAN - width)], least[SPAN - width :])
    windows = sizes - WINDOW + 1
    start = np.repeat(begins - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    owner = np.repeat(np.arange(len(docs)), windows)
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(start)))
    a = start[first]
    b = a + run + WINDOW - 1
    size = max(CHUNK_BYTES, 1 << int(n).bit_length())
    up, down = powers(size)
    total = np.zeros(n + 1, np.uint64)
    turned = mix(mixed[:n] ^ np.uint64(turn)) if turn else mixed[:n]
    np.cumsum(turned * up[:n], out=total[1:])
    out = np.empty(len(first), PIECE)
    out["anchor"], out["n"] = value[first], run | np.where(twice(h, least, a, value[first]), SELF, 0)
    out["digest"] = mix((total[b - 7] - total[a]) * down[a] + run.astype(np.uint64) * M2) >> np.uint64(64 - bits)
    out["doc"] = np.fromiter((x[0] for x in docs), np.int64, len(docs))[owner[first]]
    out["at"] = a - begins[owner[first]]
    return out


def twice(h: np.ndarray, least: np.ndarray, begin: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Pieces near which their anchor's hash is chosen at two places in a row.

    A place is chosen if its hash is the greatest of the least hashes of the windows over it.  Between two places with a piece's
    anchor no other place can be chosen, so looking at neighbours finds every piece that holds its anchor twice.
    """
    most, width = np.concatenate((np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64))), 1
    while 2 * width <= SPAN:
        most = np.maximum(most[:-width], most[width:])
        width *= 2
    most = np.maximum(most[: -(SPAN - width)], most[SPAN - width :])
    chosen = np.flatnonzero(most == h)
    pair = np.flatnonzero((h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) < 2 * WINDOW))
    out = np.zeros(len(begin), bool)
    f, t = chosen[pair], chosen[pair + 1]
    low, high = np.searchsorted(begin, f - SPAN + 1), np.searchsorted(begin, t, side="right")
    for k in range(int((high - low).max()) if len(pair) else 0):
        at = low + k
        inside = at < high
        at = at[inside]
        out[at[anchor[at] == h[f[inside]]]] = True
    return out


def count(p: np.ndarray) -> np.ndarray:
    """Windows of each piece."""
    return (p["n"] & (SELF - 1)).astype(np.int64)


# ---------------------------------------------------------------- first occurrences
def ordered(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces by (anchor, digest, doc, at), and which are the first of their anchor and digest."""
    p = p[np.lexsort((p["at"], p["doc"], p["digest"], p["anchor"]))]
    first = np.ones(len(p), bool)
    first[1:] = (p["anchor"][1:] != p["anchor"][:-1]) | (p["digest"][1:] != p["digest"][:-1])
    return p, first


def copies(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The pieces of ordered ones that aren't first, each with the copy right before it."""
    at = np.flatnonzero(~first)
    out = np.zeros(len(at), LATER)
    out["doc"], out["at"], out["n"] = p["doc"][at], p["at"][at], count(p[at])
    out["src"], out["src_at"] = p["doc"][at - 1], p["at"][at - 1]
    return out


def runs_of_copies(v: np.ndarray) -> np.ndarray:
    """LATER rows as runs: pieces of a document that overlap or touch and whose copies lie in one document at one distance."""
    v = v[np.lexsort((v["at"], v["src_at"].astype(np.int64) - v["at"], v["src"], v["doc"]))]
    end = v["at"].astype(np.int64) + v["n"] + (WINDOW - 1)
    new = np.ones(len(v), bool)
    same = (v["doc"][1:] == v["doc"][:-1]) & (v["src"][1:] == v["src"][:-1]) & (v["src_at"][1:] - v["at"][1:] == v["src_at"][:-1] - v["at"][:-1])
    new[1:] = ~same | (v["at"][1:] > end[:-1])
    first = np.flatnonzero(new)
    out = np.zeros(len(first), RUN)
    out["doc"], out["src"], out["start"], out["src_at"] = v["doc"][first], v["src"][first], v["at"][first], v["src_at"][first]
    out["end"] = end[np.append(first[1:], len(v)) - 1] if len(v) else []
    return out


def united(v: np.ndarray) -> np.ndarray:
    """Intervals by document and place, overlapping and touching ones made one."""
    if not len(v):
        return v
    v = v[np.lexsort((v["start"], v["doc"]))]
    _, group = np.unique(v["doc"], return_inverse=True)
    base = group.astype(np.int64) << 32
    reach = np.maximum.accumulate(base + v["end"])
    new = np.ones(len(v), bool)
    new[1:] = base[1:] + v["start"][1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = v[first]
    out["end"] = reach[np.append(first[1:], len(v)) - 1] & 0xFFFFFFFF
    return out


def dealt(rows: np.ndarray, by: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, bytes) of rows by bucket."""
    order = np.argsort(by, kind="stable")
    rows, by = rows[order], by[order]
    cuts = np.flatnonzero(np.diff(by)) + 1
    for s, e in zip(np.concatenate(([0], cuts)), np.append(cuts, len(by)), strict=True):
        if e > s:
            yield int(by[s]), kind, rows[s:e].tobytes()


def by_doc(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def by_anchor(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(anchor) % np.uint64(buckets)).astype(np.int64)


BLOB = "bucket long, kind int, data binary"


def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int32()), pa.array(list(columns[2]), pa.binary())], ["bucket", "kind", "data"])


def frame_of(rows: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["bucket", "kind", "data"]).astype({"bucket": "int64", "kind": "int32"})


# ---------------------------------------------------------------- stages
def numbered(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): key is doc_id where that is unique, else the row's number by (doc_id, text)."""
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    twice = lean.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if twice:
        return written(lean.orderBy(F.asc_nulls_first("doc_id"), "text").select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "numbered")
    return lean.select(F.col("doc_id").alias("key"), "doc_id", "text")


def frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of strings that FREQUENT documents or more of a small sample hold."""
    rows = docs.count()
    if not rows:
        return np.empty(0, np.uint64)
    some = docs.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / rows)) + 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                if len(text) >= GRAM:
                    raw = np.frombuffer(text + bytes(GRAM + 8), np.uint8)
                    h = np.unique(gram_hashes(mix(words_at(raw)), len(text) - GRAM + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    found = some.select("text").mapInArrow(hashed, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT)
    return np.array([r.h for r in found.orderBy(F.desc("n"), "h").limit(HOT).select("h").collect()], np.int64).view(np.uint64)


def anchored(docs: DataFrame, hot: np.ndarray, buckets: int, turn: int, bits: int) -> DataFrame:
    """Per task and bucket: first pieces (kind 0); per task and document bucket: later ones with the copies before them (kind 1)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lifted, held, some, size = Hot(hot), [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            p, first = ordered(np.concatenate(held)) if held else (np.empty(0, PIECE), np.empty(0, bool))
            again = copies(p, first)
            for row in (*dealt(p[first], by_anchor(p["anchor"][first], buckets), 0), *dealt(again, by_doc(again["doc"], buckets), 1)):
                yield batch_of([row])
            held.clear()

        for batch in batches:
            for key, text in zip(numbers(batch.column(0)).tolist(), text_bytes(batch.column(1)), strict=True):
                some.append((key, text))
                size += len(text)
                if size >= CHUNK_BYTES:
                    held.append(pieces(some, lifted, turn, bits))
                    some, size = [], 0
                    if sum(map(len, held)) >= FLUSH:
                        yield from flush()
        held.append(pieces(some, lifted, turn, bits))
        yield from flush()

    return docs.select("key", "text").mapInArrow(cut, BLOB)


def met(found: DataFrame, buckets: int) -> DataFrame:
    """Across tasks, by document bucket: later pieces with the copies before them (kind 1), and pieces to be looked at (kind 2)."""

    def meet(own: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(own.bucket.iloc[0]), 1, x) for x in own.data[own.kind == 1]]
        p, first = ordered(np.concatenate([np.frombuffer(x, PIECE) for x in own.data[own.kind == 0]] or [np.empty(0, PIECE)]))
        again = copies(p, first)
        p = p[first]
        same = p["anchor"][1:] == p["anchor"][:-1]
        shared = (np.append(same, False) | np.insert(same, 0, False) | (p["n"] >= SELF)) if len(p) else np.empty(0, bool)
        p = p[shared]
        return frame_of(rows + list(dealt(again, by_doc(again["doc"], buckets), 1)) + list(dealt(p, by_doc(p["doc"], buckets), 2)))

    return found.groupBy("bucket").applyInPandas(meet, BLOB)


def per_doc(blobs: DataFrame, dtype: np.dtype, unite: bool) -> DataFrame:
    """(key, data): a document's rows of blobs that are dealt by document."""

    def split(own: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(x, dtype) for x in own.data])
        rows = united(rows) if unite else rows[np.argsort(rows["doc"], kind="stable")]
        cuts = np.flatnonzero(np.diff(rows["doc"])) + 1
        edges = list(zip(np.concatenate(([0], cuts)), np.append(cuts, len(rows)), strict=True))
        return pd.DataFrame({"key": [int(rows["doc"][s]) for s, _ in edges], "data": [rows[s:e].tobytes() for s, e in edges]})

    return blobs.groupBy("bucket").applyInPandas(split, "key long, data binary")


def copied(blobs: DataFrame) -> DataFrame:
    """(key, kind, data) of kind-1 blobs: by document bucket the runs of copies as intervals (kind 1), and by the document that holds the copy what is to be sent (kind 4)."""

    def split(own: pd.DataFrame) -> pd.DataFrame:
        runs = runs_of_copies(np.concatenate([np.frombuffer(x, LATER) for x in own.data]))
        cut = np.empty(len(runs), INTERVAL)
        cut["doc"], cut["start"], cut["end"] = runs["doc"], runs["start"], runs["end"]
        rows = [(int(own.bucket.iloc[0]), 1, united(cut).tobytes())] + [(key, 4, data) for key, data in by_key(runs, "src")]
        return pd.DataFrame(rows, columns=["key", "kind", "data"]).astype({"key": "int64", "kind": "int32"})

    return blobs.groupBy("bucket").applyInPandas(split, "key long, kind int, data binary")


def by_key(rows: np.ndarray, field: str) -> Iterator[tuple[int, bytes]]:
    rows = rows[np.argsort(rows[field], kind="stable")]
    cuts = np.flatnonzero(np.diff(rows[field])) + 1
    for s, e in zip(np.concatenate(([0], cuts)), np.append(cuts, len(rows)), strict=True):
        if e > s:
            yield int(rows[field][s]), rows[s:e].tobytes()


#: Head of the bytes of a run that are sent to the later document.
SENT = np.dtype([("start", "<i4"), ("size", "<i4")])


def fetched(docs: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """(bucket, kind, data) of what documents are asked for (key, kind, data), in one pass over their texts: pieces with their bytes, by anchor
    (kind 3), and the bytes of runs, by the later document (kind 5)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, int], list[bytes]] = {}
            for text, asks in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                for ask in asks:
                    if ask["kind"] == 2:
                        p = np.frombuffer(ask["data"], PIECE)
                        for row, bucket, n in zip(p, by_anchor(p["anchor"], shards), count(p).tolist(), strict=True):
                            at = int(row["at"])
                            held.setdefault((int(bucket), 3), []).append(row.tobytes() + text[at : at + n + WINDOW - 1])
                        continue
                    for r in np.frombuffer(ask["data"], RUN):
                        size, at = int(r["end"] - r["start"]), int(r["src_at"])
                        head = np.array([(r["start"], size)], SENT).tobytes()
                        held.setdefault((int(r["doc"]), 5), []).append(head + text[at : at + size])
            yield batch_of([(b, kind, b"".join(x)) for (b, kind), x in held.items()])

    per = asked.groupBy("key").agg(F.collect_list(F.struct("kind", "data")).alias("asks")).withColumnRenamed("key", "_key")
    joined = docs.select("key", "text").join(per, F.col("key") == F.col("_key"))
    return joined.select("text", "asks").mapInArrow(fetch, BLOB)


def differing(text: bytes, sent: list[bytes]) -> int:
    """Runs whose bytes in the text aren't those that were sent (or that were cut short)."""
    wrong = 0
    for blob in sent:
        at = 0
        while at < len(blob):
            head = np.frombuffer(blob, SENT, 1, at)[0]
            start, size = int(head["start"]), int(head["size"])
            at += SENT.itemsize
            wrong += text[start : start + size] != blob[at : at + size]
            at += size
    return wrong


def unpacked(blobs: list[bytes]) -> list[tuple[np.void, bytes]]:
    out = []
    for blob in blobs:
        at = 0
        while at < len(blob):
            row = np.frombuffer(blob, PIECE, 1, at)[0]
            end = at + PIECE.itemsize + int(count(row)) + WINDOW - 1
            out.append((row, blob[at + PIECE.itemsize : end]))
            at = end
    return out


def sharded(parts: DataFrame, buckets: int) -> DataFrame:
    """Intervals (kind 1, by document bucket) of windows that also start earlier, by suffix arrays of the pieces."""

    def look(own: pd.DataFrame) -> pd.DataFrame:
        found = unpacked(list(own.data))
        found.sort(key=lambda x: (int(x[0]["doc"]), int(x[0]["at"])))
        shards, places, begins, group, size = [], [], [], [], 0
        total = 0

        def close() -> None:
            nonlocal group, size, total
            text = np.frombuffer(b"".join(t for _, t in group) + bytes(PAD), np.uint8)
            n = np.array([int(count(r)) for r, _ in group], np.int64)
            length = n + WINDOW - 1
            begin = np.cumsum(length) - length
            windows = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
            shards.append((text, windows))
            doc = np.repeat(np.array([int(r["doc"]) for r, _ in group], np.int64), n)
            at = np.repeat(np.array([int(r["at"]) for r, _ in group], np.int64) - (np.cumsum(n) - n), n) + np.arange(n.sum())
            begins.append((doc, at))
            group, size, total = [], 0, total + int(n.sum())

        for row, text in found:
            group.append((row, text))
            size += len(text)
            if size >= SHARD_BYTES:
                close()
        if group:
            close()
        doc, at = (np.concatenate([b[k] for b in begins]) for k in (0, 1))
        place = np.empty(len(doc), np.int64)
        place[np.lexsort((at, doc))] = np.arange(len(doc))
        cuts = np.cumsum([len(b[0]) for b in begins])[:-1]
        places = np.split(place, cuts)
        later = np.concatenate(not_first(shards, places))
        out = np.empty(int(later.sum()), INTERVAL)
        out["doc"], out["start"], out["end"] = doc[later], at[later], at[later] + WINDOW
        out = united(out)
        return frame_of(list(dealt(out, by_doc(out["doc"], buckets), 1)))

    return parts.groupBy("bucket").applyInPandas(look, BLOB)


def removed(docs: DataFrame, turn: int = 0, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(key, data) of documents that lose bytes: their removed intervals, united; and (key, sent): what their runs of copies are held against."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(8, 4 * docs.rdd.getNumPartitions())
    found = written(met(anchored(docs, frequent(docs), buckets, turn, bits), buckets), "pieces")
    runs = written(copied(found.where("kind = 1")), "runs")
    pieces_ = per_doc(found.where("kind = 2"), PIECE, False).select("key", F.lit(2).alias("kind"), "data")
    # a piece of 32 bytes here has some 140 bytes of text
    wanted = found.where("kind = 2").agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(4, -(-int(wanted) * 5 // (SHARD_BYTES // 2)))
    parts = written(fetched(docs, written(pieces_.unionByName(runs.where("kind = 4")), "asked"), shards), "parts")
    later = sharded(parts.where("kind = 3"), buckets)
    own = runs.where("kind = 1").select(F.col("key").alias("bucket"), "kind", "data")
    intervals = written(per_doc(written(later, "later").unionByName(own), INTERVAL, True), "intervals")
    sent = parts.where("kind = 5").groupBy(F.col("bucket").alias("key")).agg(F.collect_list("data").alias("sent"))
    return intervals, sent


def deduplicated(docs: DataFrame, texts: bool = False, attempts: tuple[int, ...] = ATTEMPTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 [, kept: the remaining bytes] of every document.

    attempts: bits of the digests of each attempt.  An attempt in which a run of copies differs is thrown away.
    """
    d = numbered(docs)
    for turn, bits in zip(TURNS, attempts, strict=False):
        out = written(applied(d, *removed(d, turn, bits), texts), "deduplicated")
        if not out.where("_wrong > 0").limit(1).count():
            return out.drop("_wrong") if texts else out.drop("_wrong", "kept")
    raise RuntimeError("digests collided in every attempt")


def applied(d: DataFrame, intervals: DataFrame, sent: DataFrame, texts: bool) -> DataFrame:
    """Documents without their intervals, and how many of their runs differ from what was sent."""
    small_batches(d.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, data, proof in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                v = np.frombuffer(data or b"", INTERVAL)
                edges = [0, *np.stack([v["start"], v["end"]], 1).ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(v), hashlib.sha256(kept).hexdigest(), kept if texts else None, differing(text, proof or [])))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "_wrong"])

    cut, told = intervals.withColumnRenamed("key", "_key"), sent.withColumnRenamed("key", "_to")
    both = cut.join(told, F.col("_key") == F.col("_to"), "left").select("_key", "data", "sent")  # who is sent something loses something
    joined = d.join(both, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "data", "sent")
    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, _wrong long")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made in Arrow batches.  Candidate groups share a key.  Inside a group, fingerprints lie vertically:
plane b holds bit b of 64 fingerprints a word, a carry-save counter adds the differing bits of all lanes at once, and
words whose lanes have all gone past the radius are abandoned.

Keys.  For a radius r of 3 over 64 bits, six blocks are cut; two fingerprints at most 3 bits apart agree on three of the six
whole blocks, so the 20 choices of three blocks as keys lose no pair.  For wide fingerprints of five-word shingles keys are
bands of minima of shingle hashes (a pair of similarity 0.8 shares one of 16 bands of 4 with probability 0.9998).
For near-dedup the radius only finds candidates; their sets of shingles decide.

Only distinct fingerprints are compared, so exact copies cost nothing; a group is walked from neighbour to neighbour and a
fingerprint that has been reached isn't compared again, so a dense group costs little over its size and emits a forest,
never all pairs.  A key with more than ``BLOCK`` rows is cut into blocks, and every pair of blocks is a group of its own, so
no task holds an unbounded one.  Components come from star contraction over the links in DataFrames.

Nulls: a null text has no words.  A text without words has fingerprint zero, which links as any other does.  Rows with the
same doc_id are separate rows with the same number.  Empty tables give empty results.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specforge.llm.common import PLACE, long_ids, placed, small_batches, table, text_bytes, unplaced, written

SEED = 42
#: Six blocks of a 64-bit fingerprint: (lowest bit, width).
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Groups up to this size are compared as pairs side by side in one sheet of lanes; larger ones are walked.
PAIRED = 48
#: Rows of a key that stay together: of 64-bit fingerprints, of wide ones (whose sets of shingles may have to be held as well).
BLOCK, WIDE_BLOCK = 8192, 1024
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of a text, repeats included; A-Z is lower-cased first."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if n <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    spans = zip(starts[: n - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([h(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as an unsigned number."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduce(ones, axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def remix(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other hashes of the same shingles, for wide fingerprints and minima."""
    x = (hashes + np.uint64(lane)) * GOLDEN
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of three-word shingles, as a signed long."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t, 3)) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return long_ids(docs, "text").mapInArrow(make, "doc_id long, fp long")


def wide_fingerprints(held: DataFrame, lanes: int = 4, bands: int = 16, rows: int = 4) -> DataFrame:
    """(_file, _row, node, fp, n, keys) of rows (_file, _row, text): digest of the set of five-word shingles, its fingerprint of lanes*64 bits, size and band keys."""
    small_batches(held.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, keys = [], [], [], []
            for text in text_bytes(batch.column(2)):
                hashes = np.unique(shingle_hashes(text, 5))
                nodes.append(set_digest(hashes))
                fps.append(b"".join(majority(remix(hashes, k)).to_bytes(8, "little") for k in range(lanes)))
                sizes.append(len(hashes))
                if len(hashes):
                    minima = np.array([remix(hashes, 1000 + k).min() for k in range(bands * rows)], np.uint64).reshape(bands, rows)
                    mixed = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        mixed = remix(mixed ^ minima[:, r], 77)
                    keys.append(mixed.view(np.int64).tolist())
                else:
                    keys.append([0])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                [*PLACE, "node", "fp", "n", "keys"],
            )

    return held.select(*PLACE, "text").mapInArrow(make, "_file long, _row long, node binary, fp binary, n long, keys array<long>")


def set_digest(hashes: np.ndarray) -> bytes:
    """XXH128 of a sorted set of shingle hashes: documents with the same shingles are one node."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, shingles): the hashes of the five-word shingles of every row, sorted and distinct."""
    small_batches(docs.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, 5)) for t in text_bytes(batch.column(0))]
            made = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(x) for x in sets], pa.binary()), made], ["node", "shingles"])

    return docs.select("text").mapInArrow(make, "node binary, shingles array<long>")


# ---------------------------------------------------------------- bit-sliced comparison
def planes_of(lanes: np.ndarray) -> np.ndarray:
    """Bit planes of (members, words) fingerprints: row b holds bit b of all members, 64 to a word."""
    n, width = lanes.shape
    bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(n, width * 8), axis=1, bitorder="little")
    across = np.zeros((width * 64, -(-n // 64) * 64), np.uint8)
    across[:, :n] = bits.T
    return np.packbits(across, axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, pivot: np.ndarray | None, radius: int) -> np.ndarray:
    """Words of lanes whose distance to the pivot is at most the radius (padding lanes aren't cleared).

    Counter bit k of every lane lies in one word of counters[k].  The last one is worth more than the radius and sticky, so a lane
    that has passed it stays out whatever the lower bits go on to count.  Every eight planes, words in which all lanes are past
    the radius are abandoned.
    """
    bits = radius.bit_length() + 1
    counters = np.zeros((bits, planes.shape[1]), np.uint64)
    alive = np.arange(planes.shape[1])
    done = np.zeros(planes.shape[1], np.uint64)
    turned = np.unpackbits(pivot.view(np.uint8), bitorder="little") if pivot is not None else None
    full = ~np.uint64(0)
    for b in range(planes.shape[0]):
        carry = planes[b] if len(alive) == planes.shape[1] else planes[b, alive]
        if turned is not None and turned[b]:
            carry = ~carry
        for k in range(bits - 1):
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        counters[bits - 1] |= carry
        if b % 8 == 7 and b + 1 < planes.shape[0]:
            over = past(counters, radius)
            keep = over != full
            if not keep.all():
                alive, counters = alive[keep], counters[:, keep]
                if not len(alive):
                    return done
    done[alive] = ~past(counters, radius)
    return done


def past(counters: np.ndarray, radius: int) -> np.ndarray:
    """Lanes that count over the radius: a comparison of vertical numbers, highest bit first; the highest is sticky."""
    over, equal = np.zeros(counters.shape[1], np.uint64), np.full(counters.shape[1], ~np.uint64(0))
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            over |= equal & counters[k]
            equal &= ~counters[k]
    return over


def lanes_set(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def walk(lanes: np.ndarray, radius: int, fits=None) -> list[tuple[int, int]]:
    """Links of a spanning forest of one large group.  Whoever is reached is taken out of the lanes; none are left, it ends."""
    left, links = np.arange(len(lanes)), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        planes = planes_of(lanes[left])
        while queue and len(left):
            at = queue.pop()
            near = lanes_set(within(planes, lanes[at], radius), len(left))
            if fits is not None:
                near &= fits(at, left)
            if near.any():
                links += [(int(at), int(x)) for x in left[near]]
                queue += left[near].tolist()
                left = left[~near]
                planes = planes_of(lanes[left]) if len(left) else planes
    return links


def group_links(starts: np.ndarray, ends: np.ndarray, lanes: np.ndarray, radius: int, sizes: np.ndarray | None) -> np.ndarray:
    """Links within runs [start, end) of rows that share a key."""
    links: list[np.ndarray] = []
    length = ends - starts
    for m in np.unique(length[(length > 1) & (length <= PAIRED)]):
        first = starts[length == m]
        pairs = np.array(list(combinations(range(m), 2)))
        step = max(1, 200_000 // len(pairs))
        for at in range(0, len(first), step):
            a, b = (np.add.outer(first[at : at + step], pairs[:, i]).ravel() for i in (0, 1))
            near = lanes_set(within(planes_of(lanes[a] ^ lanes[b]), None, radius), len(a))
            if sizes is not None:
                near &= alike(sizes[a], sizes[b])
            a, b = a[near], b[near]
            links.append(np.stack([a, b], 1) if m < 4 else forest(a, b))
    for s, e in zip(starts[length > PAIRED], ends[length > PAIRED], strict=True):
        fits = None if sizes is None else (lambda at, left, own=sizes[s:e]: alike(own[at], own[left]))
        links.append(np.array(walk(lanes[s:e], radius, fits), np.int64).reshape(-1, 2) + s)
    return np.concatenate(links) if links else np.empty((0, 2), np.int64)


def set_links(sets: list[np.ndarray], own: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of different labels whose similarity is 0.8 or more, until none is left that joins two labels.

    Common members are counted through the lists of sets that hold each member, for one set against all the later ones.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    member = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    order = np.argsort(member, kind="stable")
    holders, edges = owner[order], np.concatenate(([0], np.cumsum(np.bincount(member))))
    begin, links, own = np.cumsum(sizes) - sizes, [], own.copy()
    for i in range(len(sets) - 1):
        open_ = (own != own[i]) & alike(sizes[i], sizes)
        open_[: i + 1] = False
        if not open_.any():
            continue
        mine = member[begin[i] : begin[i] + sizes[i]]
        low, n = edges[mine], edges[mine + 1] - edges[mine]
        common = np.bincount(holders[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(sets))
        for j in np.flatnonzero(open_ & (10 * common >= 8 * (sizes[i] + sizes - common))):
            if own[j] != own[i]:
                links.append((i, int(j)))
                own[own == own[j]] = own[i]
    return links


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sets of these sizes can have a similarity of 0.8."""
    return 10 * np.minimum(a, b) >= 8 * np.maximum(a, b)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of these links, those that join what isn't joined yet."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return np.array(kept, np.int64).reshape(-1, 2)


def runs_of(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole groups of rows, sorted by the key in column 0, as arrays that `read` makes of a batch (the key first)."""
    held: list[tuple] = []
    for batch in batches:
        if not len(batch):
            continue
        now = read(batch)
        key = now[0]
        if key[-1] == key[0] and (not held or held[-1][0][-1] == key[0]):
            held.append(now)  # one long run goes on
            continue
        edge = int(np.searchsorted(key, key[-1]))
        held.append(tuple(x[:edge] for x in now))
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held = [tuple(x[edge:] for x in now)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def cuts_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(key)]))


def numbers_of(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def objects_of(items: list) -> np.ndarray:
    out = np.empty(len(items), object)
    out[:] = items
    return out


def in_blocks(keyed: DataFrame, by: str, most: int) -> DataFrame:
    """keyed, with the rows of a key that has more than `most` of them once for every pair of blocks that theirs (a hash of `by`) is part of."""
    large = keyed.groupBy("key").agg(F.count("*").alias("_rows")).where(F.col("_rows") > most)
    large = large.select(F.col("key").alias("_large"), F.ceil(F.col("_rows") / most).alias("_blocks"))
    d = keyed.join(large, F.col("key") == F.col("_large"), "left").drop("_large")
    one = F.array(F.lit(0).cast("long"))
    d = d.withColumn("_other", F.explode(F.when(F.col("_blocks").isNull(), one).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))))
    own = F.pmod(F.xxhash64(F.lit("block"), by), F.col("_blocks"))
    pair = F.xxhash64(F.lit("pair"), "key", F.least(own, F.col("_other")), F.greatest(own, F.col("_other")))
    return d.withColumn("key", F.when(F.col("_blocks").isNull(), F.col("key")).otherwise(pair)).drop("_blocks", "_other")


def linked(keyed: DataFrame, radius: int, width: int) -> DataFrame:
    """(a, b) links between fingerprints among rows (key, fp) that share a key; fp is a long or binary of width words.

    Rows (key, fp, n, node) give (key, a, b) links between nodes of fitting sizes.  Either way the links of a key are a forest.
    """
    wide, sized = dict(keyed.dtypes)["fp"] == "binary", "n" in keyed.columns

    def lanes_of(column: pa.Array) -> np.ndarray:
        if wide:
            return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, width)
        return numbers_of(column).view(np.uint64).reshape(-1, 1)

    def read(batch: pa.RecordBatch) -> tuple:
        now = (numbers_of(batch.column(0)), lanes_of(batch.column(1)))
        return (*now, numbers_of(batch.column(2)), objects_of(batch.column(3).to_pylist())) if sized else now

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lanes, *more in runs_of(batches, read):
            links = group_links(*cuts_of(key), lanes, radius, more[0] if sized else None)
            if not len(links):
                continue
            if sized:
                sides = [pa.array(more[1][links[:, i]].tolist(), pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(key[links[:, 0]]), *sides], ["key", "a", "b"])
            else:
                sides = [lanes[links[:, i]] for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0]).view(np.int64)) for x in sides], ["a", "b"])

    out = "key long, a binary, b binary" if sized else "a long, b long"
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(compare, out)


def similar(rows: DataFrame) -> DataFrame:
    """(a, b) links among rows (key, node, label, shingles) of a key with different labels: a forest of the pairs alike at 0.8."""

    def read(batch: pa.RecordBatch) -> tuple:
        return (numbers_of(batch.column(0)), *(objects_of(batch.column(k).to_pylist()) for k in (1, 2)), objects_of([x.values.to_numpy() for x in batch.column(3)]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, label, sets in runs_of(batches, read):
            for s, e in zip(*cuts_of(key), strict=True):
                links = set_links(sets[s:e].tolist(), np.unique(label[s:e].tolist(), return_inverse=True)[1])
                sides = [pa.array([node[s + x[i]] for x in links], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(sides, ["a", "b"])

    return rows.select("key", "node", "label", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a binary, b binary")


def block_keys(fps: DataFrame) -> DataFrame:
    """Twenty keys of a 64-bit fingerprint: each three of its six blocks, and the number of the choice."""
    keys = []
    for t, chosen in enumerate(combinations(BLOCKS, 3)):
        key, at = F.lit(t).cast("long"), 0
        for low, width in chosen:
            part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(part)
            at += width
        keys.append(key)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


# ---------------------------------------------------------------- components
def components(links: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) of all nodes that links (a, b) touch; root is the least node of the component.

    Star contraction: every node hands its greater neighbours to its least one, then its smaller ones, until nothing changes.
    Every round is written, and the minima are tables of their own, so joins see plain exchanges that can be split at hot keys.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "links")
        counts = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        edges = new
        if counts[0] == counts[1]:
            break
    else:
        raise RuntimeError("star contraction did not converge")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_components(marked: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of rows (doc_id, fp): the least doc_id that equal fingerprints and links reach."""
    first = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "first")
    roots = components(links)
    joined = written(first.join(roots, first.fp == roots.node).select("fp", "first", "root"), "joined")
    least = joined.groupBy("root").agg(F.min("first").alias("component"))
    known = joined.join(least, "root").select("fp", "component")
    alone = first.where("n > 1").join(joined, "fp", "left_anti").select("fp", F.col("first").alias("component"))
    final = written(known.union(alone), "components")
    return marked.join(final, "fp", "left").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def simhash_components(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every document; fingerprints link at 3 or fewer differing bits."""
    if not 0 <= radius <= 3:
        raise ValueError("the block keys are exact up to a radius of 3")
    marked = written(fingerprints(docs), "fingerprints")
    links = linked(in_blocks(block_keys(marked.select("fp").distinct()), "fp", BLOCK), radius, 1)
    found = with_components(marked, links)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sets_of(nodes: DataFrame, held: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, shingles) of distinct nodes; firsts are (node, _file, _row) of a row of held."""
    wanted = written(nodes.join(firsts, "node").select(*PLACE), "wanted")
    return written(shingle_sets(held.join(wanted, PLACE, "left_semi")), "sets")


def verified(pairs: DataFrame, held: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b, good) of distinct pairs of nodes: whether their sets of shingles have a similarity of 0.8."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(nodes, held, firsts)
    d = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a")
    d = d.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b")
    inter = F.size(F.array_intersect("s", "t"))
    return written(d.select("a", "b", (10 * inter >= 8 * (F.size("s") + F.size("t") - inter)).alias("good")), "verified")


def near_links(held: DataFrame, worded: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between sets of shingles (nodes) that are alike at 0.8; all such pairs under a key and the radius are linked or joined by links.

    First a forest of every key is verified.  Where one of its links fails, whoever it reached may have a true link elsewhere in
    the key: there the sets themselves are compared, all of those that the verified links haven't joined.
    """
    distinct = written(worded.groupBy("node").agg(F.min(F.struct(*PLACE)).alias("at"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    firsts = distinct.select("node", "at.*")
    keyed = in_blocks(distinct.select(F.explode("keys").alias("key"), "fp", "n", "node"), "node", WIDE_BLOCK)
    tried = written(linked(keyed, radius, 4).select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "tried")
    checked = verified(tried.select("a", "b").distinct(), held, firsts)
    good = checked.where("good").select("a", "b")
    open_keys = written(tried.join(checked.where("not good"), ["a", "b"]).select("key").distinct(), "open")
    roots = written(components(good), "roots").withColumnRenamed("root", "label").withColumnRenamed("node", "_node")
    again = keyed.select("key", "node").join(open_keys, "key", "left_semi").join(roots, F.col("node") == F.col("_node"), "left")
    again = written(again.select("key", "node", F.coalesce("label", "node").alias("label")), "again")
    apart = again.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("greatest")).where("least <> greatest").select("key")
    again = written(again.join(apart, "key", "left_semi"), "apart")
    sets = sets_of(again.select("node").distinct(), held, firsts)
    small_batches(held.sparkSession, 100)  # rows hold sets
    more = written(similar(again.join(sets, "node")), "more")
    small_batches(held.sparkSession)
    return good.union(more)


def near_dedup(docs: DataFrame, radius: int = 60) -> DataFrame:
    """All columns of the rows that stay: one row of each group of documents alike at 0.8 over five-word shingles.

    A group stays as its row of the smallest doc_id (null: last; ties: the first in the files).  Rows are known by their places, so rows
    with equal or null doc_ids are judged by their texts like any others and columns may have any name.  Candidates share a band
    key and differ in at most ``radius`` of 256 bits: a similarity of 0.8 lies near 37, with a deviation under 6.  A candidate is
    linked only if its sets of shingles (64-bit hashes) have a similarity of 0.8.  Texts without words are left alone.  An empty
    table stays empty.
    """
    rows = placed(docs)
    held = rows.select(*PLACE, F.col("_doc.text").alias("text"))
    worded = written(wide_fingerprints(held), "wide").where("n > 0")
    links = written(near_links(held, worded, radius), "near-links")
    order = F.struct(F.col("_doc.doc_id").isNull().alias("last"), F.col("_doc.doc_id").cast("long").alias("doc_id"), *PLACE)
    ordered = rows.select(*PLACE, order.alias("doc_id"))
    found = with_components(worded.select(*PLACE, F.col("node").alias("fp")).join(ordered, PLACE).select("doc_id", "fp"), links)
    gone = written(found.where("component_id <> doc_id").select("doc_id._file", "doc_id._row"), "gone")
    return unplaced(rows.join(gone.hint("merge"), PLACE, "left_anti"), docs)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))

"""WARC, digests, language, sharding."""

import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pytest

from specforge.llm import digests, language, sharding, warc


# ---------------------------------------------------------------- WARC
PAGES = [(1, "http://a/x y", "<p>" + "long " * 40), (0, "http://b", "<p>" + "long " * 40), (2, None, "short"), (3, "http://c\r\nEvil: 1", "short"), (4, "http://d", None), (5, "e", "é🙂\r\n\r\nWARC/1.1\r\n" * 30), (7, "f", "é🙂\r\n\r\nWARC/1.1\r\n" * 30), (6, "g", "")]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")
    warc.write_archives(pages.repartition(2), str(tmp_path / "w"))
    return str(tmp_path / "w")


def test_round_trip_and_assembly(spark, archive):
    found = warc.read_records(spark, archive, payloads=True)
    got = {r.metadata.page_id: r for r in warc.captures(found).collect()}
    assert set(got) == {p[0] for p in PAGES}
    first = {}
    for page, _, html in sorted(PAGES):
        first.setdefault(html or "", page)
    ids = {r.response.record_id: page for page, r in got.items()}
    for page, _, html in PAGES:
        payload, r = (html or "").encode(), got[page]
        again = len(payload) >= 100 and first[html] != page
        assert r.response.type == ("revisit" if again else "response") and r.request.type == "request"
        assert (r.response.payload_bytes, r.response.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert ids.get(r.response.refers_to) == (first[html] if again else None)
        assert r.response.payload == (None if again else payload)


def test_records_stand_by_record_and_by_file(archive):
    import glob
    import gzip

    for path in glob.glob(archive + "/*/*.gz"):
        plain = gzip.open(path).read()
        members = b"".join(gzip.compress(x) for x in (plain[:50], plain[50:]))
        assert list(warc.parse(plain)) == list(warc.parse(members)) == list(warc.parse(open(path, "rb").read()))


def test_damaged_archives(archive):
    """Records before the damage are read, and the damage is told."""
    import glob
    import gzip

    plain = max((gzip.open(p).read() for p in glob.glob(archive + "/*/*.gz")), key=len)
    every = list(warc.parse(plain))
    assert None not in every and len(every) > 6
    cut = list(warc.parse(plain[: len(plain) // 2]))
    assert cut[-1] is None and 0 < len(cut) - 1 < len(every) and cut[:-1] == every[: len(cut) - 1]
    packed = gzip.compress(plain)
    assert list(warc.parse(packed[: len(packed) // 2]))[-1] is None and list(warc.parse(b"\x1f\x8bnothing")) == [None]
    assert list(warc.parse(b"WARC/1.1\r\nContent-Length: many\r\n\r\n")) == [None] and list(warc.parse(b"")) == []


def test_several_concurrent_records(spark):
    d = spark.createDataFrame([("r1", "response", None, 7), ("r2", "response", None, 8), ("q", "request", ["r1", "r2"], None)], "record_id string, type string, concurrent_to array<string>, page_id long")
    assert {(r.record_id, r.request.record_id) for r in warc.captures(d).collect()} == {("r1", "q"), ("r2", "q")}


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import glob
    import os

    monkeypatch.setattr(warc, "ARCHIVE", 40_000)
    monkeypatch.setattr(warc, "CLASSES", (1000, 10_000, 40_000))
    rng = np.random.default_rng(0)
    noise = lambda n: rng.integers(0, 2**62, n // 8).tobytes().hex()[:n]
    rows = [(k, "u", noise(n)) for k, n in enumerate([500] * 60 + [9000] * 12 + [30_000] * 3 + [90_000] * 2)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    sizes = [os.path.getsize(p) for p in glob.glob(str(tmp_path / "w/*/*.gz"))]
    assert max(sizes) < 100_000 and sum(s > 40_000 for s in sizes) <= 2
    assert warc.read_records(spark, str(tmp_path / "w")).where("type = 'response'").count() == len(rows)


def test_warc_query_over_odd_pages(spark, tmp_path):
    """Null and repeated numbers, equal payloads, and no pages at all, through the whole query."""
    long = "<p>" + "text " * 50
    rows = [(1, "u", long), (1, "u", long), (None, "u", long), (None, None, None), (2, "u", "short"), (2, "u", "short")]
    kind = "page_id long, url string, html string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "a/pages.parquet"))
    got = sorted(((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op3_warc(spark, str(tmp_path / "a")).collect()), key=str)
    n = len(long)
    assert got == sorted([(1, n, "response", None), (1, n, "revisit", 1), (-1, n, "revisit", 1), (-1, 0, "response", None), (2, 5, "response", None), (2, 5, "response", None)], key=str)
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "b/pages.parquet"))
    assert warc.op3_warc(spark, str(tmp_path / "b")).count() == 0


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- digests
def form(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(r"\s+", " ", fold).strip(" ")


def test_digests_against_plain(docs, rows):
    got = {r.doc_id: r for r in digests.fingerprints(docs).collect()}
    text = {r[0]: r[1] or "" for r in rows}
    ids = sorted(text, reverse=True)
    follow = dict(zip(ids, ids[1:] + ids[:1]))
    seen = {}
    for k, x in got.items():
        half = len(text[k]) // 2
        edit = text[k][: len(text[k]) - half] + text[follow[k]][:half]
        assert x.n_chars == len(text[k]) and x.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        for f, fp in ((form(text[k]), x.fingerprint), (form(edit), x.edited_fingerprint)):
            assert seen.setdefault(f, fp) == fp
        assert x.near_edited == float(form(text[k]) == form(edit)) and x.near_next == float(form(text[k]) == form(text[follow[k]]))
    assert len(set(seen.values())) == len(seen)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(digests, "RANGE", 7)
    d = spark.range(200).selectExpr("id * id as doc_id", "concat('text ', id) as text")
    got = {r.doc_id: r.edited_sha256 for r in digests.fingerprints(d).collect()}
    for i in range(200):
        t, n = f"text {i}", f"text {(i - 1) % 200}"
        edit = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i * i] == hashlib.sha256(edit.encode()).hexdigest()


def test_colliding_buckets_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(digests, "wide", lambda c: F.substring(c, 1, 1))
    d = spark.createDataFrame([(1, "apple pie"), (2, "avocado"), (3, "Apple  PIE"), (4, "banana")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in digests.fingerprints(d).collect()}
    assert got[1] == got[3] and len({got[1], got[2], got[4]}) == 3


def test_digest_odd_tables(repeated, none):
    assert digests.fingerprints(none).count() == 0
    assert digests.fingerprints(repeated).count() == repeated.count()


# ---------------------------------------------------------------- language
def test_language_held_out(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = language.identified(d).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def test_profile_against_plain():
    text = "Été  42 d'été! Ab"
    words = [w for w in re.split(r"[^a-zé]+", text.lower()) if w]
    line = "\1" + "\1".join(words) + "\1"
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i : i + n]
            if g != "\1":
                code = 0
                for c in g:
                    code = code << 21 | ord(c)
                counts[code] = counts.get(code, 0) + 1
    want = sorted(counts, key=lambda c: (-counts[c], c))[: language.TOP]
    assert language.ranked(language.grams(text)).tolist() == want


def plain_language(texts, labelled):
    """Out-of-place distance spelled out: profiles as dictionaries of ranks."""

    def ranks(counts):
        return {g: k for k, g in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[: language.TOP])}

    def counts(text, out):
        for c in language.grams(text).tolist():
            out[c] = out.get(c, 0) + 1
        return out

    known = {}
    for lang, text in labelled:
        counts(text or "", known.setdefault(lang, {}))
    known = {lang: ranks(c) for lang, c in known.items()}
    out = {}
    for k, text in texts.items():
        own = ranks(counts(text or "", {}))
        away = {lang: sum(abs(p[g] - n) if g in p else language.TOP for g, n in own.items()) for lang, p in known.items()}
        best = min(sorted(away), key=away.get) if own and away else None
        out[k] = (best, 1 - away[best] / (language.TOP * len(own))) if best else ("und", 0.0)
    return out


@pytest.mark.parametrize("block", [1000, 1])
def test_language_against_plain_distances(spark, sf_dir, docs, rows, block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = d.collect()
    held = {r.doc_id for r in own if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    want = plain_language({r.doc_id: r.text for r in own}, [(r.lang, r.text) for r in own if r.doc_id not in held and r.lang is not None])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identified(d).collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    odd = plain_language({r[0]: r[1] for r in rows}, [(r[2], r[1]) for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2])
    assert {r.doc_id: r.lang_pred for r in language.identified(docs).collect()} == {k: x[0] for k, x in odd.items()}


def test_repeated_rows_fill_the_sample_once_each(spark, monkeypatch):
    """A number that comes back many times takes no more than the sample's rows."""
    monkeypatch.setattr(language, "SAMPLE", 5)
    rows = [(1, f"word{k}", "en") for k in range(50)] + [(4, "autre mot", "fr"), (None, "x", "fr"), (6, "y", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.sampled(d).where("lang = 'en'").count() == 5 and language.sampled(d).where("lang = 'fr'").count() == 1


def test_profile_counts_in_parts(monkeypatch):
    texts = ["one two three", "", "two three four five", "été"]
    want = language.counted(texts)
    monkeypatch.setattr(language, "COUNTED", 4)
    assert all((a == b).all() for a, b in zip(want, language.counted(texts), strict=True))


def test_language_odd_tables(spark, docs, repeated, none):
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    assert all((r.lang_pred == "und") == (r.score == 0) for r in got.values())
    assert language.identified(none).count() == 0 and language.identified(repeated).count() == repeated.count()
    blank = spark.createDataFrame([(1, "text here", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identified(blank).collect()} == {("und", 0.0)}


# ---------------------------------------------------------------- sharding
def check_shards(found, texts, leaves):
    assert sorted(r.doc_id for r in found) == sorted(k for k, _ in texts)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in by.values()) and max(by) < leaves
    return {k: sum(r["size"] for r in own) for k, own in by.items()}


def test_shards(docs, rows):
    found = sharding.kd_shards(docs, leaves=5).collect()
    check_shards(found, [(r[0], r[1]) for r in rows], 5)
    want = {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in found} == want


def test_shards_near_equal_with_a_hot_text(spark):
    texts = [(k, "same text here" if k % 3 == 0 else f"text {k} " + "x" * (k % 50)) for k in range(3000)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    sizes = check_shards(sharding.kd_shards(d, leaves=16).collect(), texts, 16)
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(s - mean) < 0.05 * mean for s in sizes.values())


def plain_tree(rows, leaves):
    """The tree in plain Python: rows are (id, text, lang, source); groups of equal texts are cut only if they hold a tenth of a leaf."""
    letters = lambda x: int.from_bytes((x or "").encode()[:7].ljust(7, b"\0"), "big")
    least = {}
    for _, t, lang, source in rows:
        own = least.setdefault(t or "", [letters(lang), letters(source)])
        least[t or ""] = [min(own[0], letters(lang)), min(own[1], letters(source))]
    points = []
    for k, t, _, _ in rows:
        raw = (t or "").encode()
        size = len(raw) + 1
        points.append((k, t or "", size, (int(np.floor(np.log2(size) * 2**20)), int(np.floor((len(t or "") + 1) / size * 2**20)), *least[t or ""])))
    low = [min(p[3][d] for p in points) for d in range(4)]
    wide = [max(1, max(p[3][d] for p in points) - low[d]) for d in range(4)]

    def split(own, leaves):
        if leaves == 1 or not own:
            return [own]
        weight = sum(p[2] for p in own)
        varied = []
        for d in range(4):
            x = [int((p[3][d] - low[d]) / wide[d] * 1023) for p in own]
            mean = sum(p[2] * v for p, v in zip(own, x)) / weight
            varied.append(round(sum(p[2] * v * v for p, v in zip(own, x)) / weight - mean * mean, 6))
        d = max(range(4), key=lambda k: (varied[k], -k))
        goal, run, values = weight * (leaves // 2) / leaves, 0, {}
        for p in own:
            values.setdefault(p[3][d], []).append(p)
        left, right = [], []
        for v in sorted(values):
            size = sum(p[2] for p in values[v])
            if run >= goal:
                right += values[v]
            elif run + size < goal:
                left += values[v]
            else:
                return None if len({p[1] for p in values[v]}) > 1 else halves(left, values[v], [p for u in sorted(values) if u > v for p in values[u]], run, size, goal, leaves, weight)
            run += size
        return split(left, leaves // 2) + split(right, leaves - leaves // 2)

    def halves(left, here, right, run, size, goal, leaves, weight):
        if run + size - goal < goal - run:
            left = left + here
        else:
            right = here + right
        a, b = split(left, leaves // 2), split(right, leaves - leaves // 2)
        return None if a is None or b is None else a + b

    return split(points, leaves)


def test_shards_against_a_plain_tree(spark):
    """All values of a dimension are held by one text each, so digests, by which texts of one value are ordered, don't matter."""
    rng = np.random.default_rng(4)
    rows = [(k, "x" * int(n), "en", "a") for k, n in enumerate(rng.permutation(np.arange(50, 650)))]
    want = plain_tree(rows, 4)
    assert want is not None
    got = {}
    for r in sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), leaves=4).collect():
        got.setdefault(r.shard, set()).add(r.doc_id)
    assert [got.get(k, set()) for k in range(4)] == [{p[0] for p in own} for own in want]


def test_languages_part_where_they_vary_most(spark):
    """Texts of one size: the first cut runs between the two languages, the next between the sources."""
    rows = [(k, f"{k:08d}", "de" if k % 2 else "xx", "a" if k % 4 < 2 else "z") for k in range(400)]
    found = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), leaves=4).collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, set()).add((rows[r.doc_id][2], rows[r.doc_id][3]))
    assert len(by) == 4 and all(len(own) == 1 for own in by.values())


def test_equal_texts_stay_together(spark):
    """Small groups of equal texts in different sources and languages are never cut; a hot one is."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, int(n))) for n in rng.integers(5, 60, 400)]
    rows = [(k, texts[int(rng.integers(0, 400))] if k % 4 else "hot text " * 9, ("en", "fr", None)[k % 3], f"s{k % 7}") for k in range(2400)]
    by = {}
    for r in sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), leaves=8).collect():
        by.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(own) == 1 for t, own in by.items() if not t.startswith("hot"))


def test_shards_odd_tables(repeated, none):
    assert sharding.kd_shards(none, leaves=16).count() == 0
    assert sharding.kd_shards(repeated, leaves=4).count() == repeated.count()
    assert sharding.kd_shards(repeated, leaf_bytes=10**9).select("shard").distinct().count() == 1

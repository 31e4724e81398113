import numpy as np
import xxhash

from specforge.llm import simhash as S


def plain(text):
    words = (text or "").encode().lower().split()
    n = len(words)
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, n - 2))] if n else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    return {a: find(a) for a in ids}


def test_fingerprints_and_components(docs, rows):
    got = {r.doc_id: r for r in S.simhash_components(docs).collect()}
    want = {r[0]: plain(r[1]) for r in rows}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == want
    assert {k: r.component_id for k, r in got.items()} == groups(want)


def test_bit_sliced_distances():
    rng = np.random.default_rng(0)
    for width, radius in ((1, 3), (1, 0), (4, 48), (2, 17)):
        lanes = rng.integers(0, 2**63, (150, width), dtype=np.uint64)
        for k in range(100):
            lanes[k] = lanes[0]
            for b in rng.integers(0, 64 * width, rng.integers(0, 2 * radius + 2)):
                lanes[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        far = np.bitwise_count(lanes ^ lanes[0]).sum(axis=1)
        near = S.lanes_set(S.within(S.planes_of(lanes), lanes[0], radius), len(lanes))
        assert (near == (far <= radius)).all()


def test_large_group_is_walked_completely():
    rng = np.random.default_rng(1)
    chain = [np.uint64(rng.integers(0, 2**63))]
    for _ in range(400):
        chain.append(chain[-1] ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))))
    lanes = np.array(chain, np.uint64).reshape(-1, 1)
    links = S.walk(lanes, 3)
    far = np.bitwise_count(lanes[:, None, 0] ^ lanes[None, :, 0])
    assert len(links) == len(lanes) - 1 and all(far[a, b] <= 3 for a, b in links)


def test_star_contraction(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 200), (300, 301)]
    got = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in [*range(31), 200]) and all(got[i] == 100 for i in range(100, 140)) and got[301] == got[300] == 300


def test_odd_tables(repeated, none):
    assert S.simhash_components(none).count() == 0
    assert S.simhash_components(repeated).count() == repeated.count()


def test_near_dedup(docs, rows):
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    by_text = {}
    for r in rows:
        if r[1] and r[1].split():
            by_text.setdefault(r[1], []).append(r[0])
    for same in by_text.values():
        assert sum(i in ids for i in same) <= 1
    near = [r[0] for r in rows if r[1] and len(r[1].split()) in (150, 151)]
    assert sum(i in ids for i in near) == 1
    assert {r[0] for r in rows if not (r[1] or "").split()} <= ids


def test_near_dedup_recall(spark):
    """Pairs of a similarity of 0.8 or more over five-word shingles meet; unrelated texts stay."""
    rng = np.random.default_rng(3)
    rows, wanted = [], 0
    for k in range(120):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        other = list(words)
        for at in rng.choice(300, 4, replace=False):
            other[at] = "changed"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = ({tuple(x[i : i + 5]) for i in range(296)} for x in (words, other))
        wanted += len(a & b) >= 0.8 * len(a | b)
    ids = {r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in ids for k in range(120))
    assert sum(2 * k + 1 not in ids for k in range(120)) >= 0.95 * wanted > 50


def with_similarity(rng, shared, own):
    """Two texts of five-word shingles of which `shared` are common and `own` differ on each side."""
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common = words(shared + 4)
    return " ".join(common + words(own)), " ".join(common + words(own))


def test_near_dedup_decides_by_shingles(spark):
    """Pairs just above 0.8 go, pairs just below stay, whatever their fingerprints."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(100):
        a, b = with_similarity(rng, 242, 30) if k < 50 else with_similarity(rng, 230, 30)  # 242/302 = 0.801, 230/290 = 0.793
        rows += [(2 * k, a), (2 * k + 1, b)]
    ids = {r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * k in ids for k in range(100))
    assert all(2 * k + 1 in ids for k in range(50, 100))
    assert sum(2 * k + 1 not in ids for k in range(50)) >= 49


def test_failed_candidates_hide_no_links(spark):
    """In a crowd of candidates under 0.8 every true pair is found, though a forest of the crowd needn't hold it."""
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
    texts = []
    for _ in range(40):
        words = list(base)
        for at in rng.choice(60, 7, replace=False) * 5:
            words[at] = f"c{rng.integers(0, 10**9)}"
        twin = list(words)
        twin[150] = "twin"
        texts += [words, twin]
    sets = [{tuple(x[i : i + 5]) for i in range(296)} for x in texts]
    top = list(range(len(texts)))
    for _ in texts:  # least numbers spread along true links
        for a in range(len(texts)):
            for b in range(len(texts)):
                if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    top[a] = min(top[a], top[b])
        if all(top[t] == t for t in top):
            break
    rows = [(k, " ".join(x)) for k, x in enumerate(texts)]
    ids = {r.doc_id for r in S.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ids == set(top) and 30 <= len(ids) < 60


def test_large_keys_are_cut_into_blocks(spark, docs, rows, monkeypatch):
    """The same components, whatever the size of a block."""
    want = groups({r[0]: plain(r[1]) for r in rows})
    monkeypatch.setattr(S, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in S.simhash_components(docs).collect()} == want
    keyed = spark.range(50).selectExpr("id % 2 as key", "id as fp")
    got = {}
    for r in S.in_blocks(keyed, "fp", 10).collect():
        got.setdefault(r.key, set()).add(r.fp)
    assert max(map(len, got.values())) < 25
    assert all(any({a, b} <= own for own in got.values()) for a in range(50) for b in range(a % 2, 50, 2))


def test_near_dedup_in_blocks(spark, monkeypatch):
    """Near-copies of one text that lie in different blocks are still one group."""
    monkeypatch.setattr(S, "WIDE_BLOCK", 7)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**9, 300)]
    texts = []
    for k in range(60):
        words = list(base)
        words[int(rng.integers(0, 300))] = f"own{k}"
        texts.append((k, " ".join(words)))
    assert [r.doc_id for r in S.near_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()] == [0]


def test_rows_without_own_numbers(spark, repeated):
    """Rows that share a number or have none are judged by their texts."""
    words = " ".join(f"u{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(7, words, "x"), (7, other, "x"), (None, words + " end", "x"), (None, " ".join(f"z{k}" for k in range(40)), "x"), (None, None, "x"), (None, "", "x"), (7, words, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    got = sorted((r.doc_id or 0, r.text or "") for r in S.near_dedup(d).collect())
    assert got == sorted([(7, words), (7, other), (0, rows[3][1]), (0, ""), (0, "")])
    kept = S.near_dedup(repeated)
    assert kept.columns == repeated.columns and kept.groupBy("text").count().where("length(trim(text)) > 1 and count > 1").count() == 0


def test_near_dedup_of_nothing(none):
    assert S.near_dedup(none).count() == 0

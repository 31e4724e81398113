import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specforge.llm import substrings as S
from specforge.llm.substrings import deduplicated
from specforge.llm.suffix import PAD, common_prefixes, not_first, search, suffix_array


def padded(b: bytes) -> np.ndarray:
    return np.frombuffer(b + bytes(PAD), np.uint8).copy()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(x % 3 for x in b)))
def test_suffix_array_and_prefixes(data):
    text = padded(data)
    order, rank = suffix_array(text, len(data))
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    assert rank[order].tolist() == list(range(len(data)))
    found = common_prefixes(text, order, rank)
    for a, b in zip(order, order[1:]):
        x, y = bytes(text[a : a + 100]), bytes(text[b : b + 100])
        n = next((k for k in range(100) if x[k] != y[k]), 100)
        assert found[b] == n


def brute(shards):
    seen, base, out = {}, 0, []
    for b in shards:
        for i in range(len(b) - 99):
            seen.setdefault(b[i : i + 100], base + i)
        base += len(b)
    base = 0
    for b in shards:
        out.append([seen[b[i : i + 100]] < base + i for i in range(len(b) - 99)])
        base += len(b)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_shards_meet_by_binary_search(seed):
    rng = np.random.default_rng(seed)
    part = rng.integers(97, 100, 400, dtype=np.uint8).tobytes()
    shards = [part + b"x" * 150, rng.integers(97, 99, 300, dtype=np.uint8).tobytes() + part[50:300], bytes(230), part * 2]
    windows = [np.arange(len(b) - 99) for b in shards]
    place, base = [], 0
    for b, w in zip(shards, windows):
        place.append(w + base)
        base += len(b)
    got = not_first([(padded(b), w) for b, w in zip(shards, windows)], place)
    assert [x.tolist() for x in got] == brute(shards)


def test_search_finds_only_equal_windows():
    a, b = padded(b"a" * 100 + b"b" * 100), padded(b"b" * 100 + b"c" * 100)
    assert search(a, np.array([0, 100]), b, np.array([0, 100])).tolist() == [1, -1]


def expected(rows):
    """By (doc_id, text), every text a document of its own: n_bytes, n_removed, n_spans, digest."""
    seen, out = set(), []
    for doc, text in rows:
        b = (text or "").encode()
        covered = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                covered[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((doc, len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def test_dedup_against_brute_force(docs, rows):
    got = sorted(tuple(r) for r in deduplicated(docs).collect())
    assert got == sorted(expected([(r[0], r[1]) for r in rows]))


def test_dedup_repeated_and_empty(repeated, none):
    rows_ = sorted(((r.doc_id, r.text or "") for r in repeated.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in deduplicated(repeated).collect()), key=key) == sorted(expected(rows_), key=key)
    assert deduplicated(none).count() == 0


def test_colliding_digests_remove_nothing(docs, rows):
    """Digests of one bit take unlike pieces for copies; their bytes tell, and the next attempt gives the right result."""
    import pytest as _pytest

    got = sorted(tuple(r) for r in deduplicated(docs, attempts=(1, 64)).collect())
    assert got == sorted(expected([(r[0], r[1]) for r in rows]))
    with _pytest.raises(RuntimeError):
        deduplicated(docs, attempts=(1,))


def test_runs_of_copies():
    v = np.zeros(5, S.LATER)
    v["doc"], v["src"], v["at"], v["n"], v["src_at"] = [7, 7, 7, 7, 8], [3, 3, 3, 4, 3], [0, 10, 500, 0, 0], [10, 5, 4, 9, 10], [100, 110, 600, 2, 100]
    got = [tuple(r)[:5] for r in S.runs_of_copies(v)]
    assert got == [(7, 3, 0, 114, 100), (7, 3, 500, 603, 600), (7, 4, 0, 108, 2), (8, 3, 0, 109, 100)]
    assert len(S.runs_of_copies(v[:0])) == 0
    assert S.differing(b"abcdef", [np.array([(1, 3)], S.SENT).tobytes() + b"bcd"]) == 0 and S.differing(b"abcdef", [np.array([(1, 3)], S.SENT).tobytes() + b"bxd"]) == 1

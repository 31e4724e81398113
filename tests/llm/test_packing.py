import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specforge.llm import packing as P

RANKS = P.vocabulary_path("byte_bpe_50k.tiktoken")


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary_path())
    t.encode_special_tokens = True
    return t


ODD = ["don't stop²3 m²3 αβγabc abcα áb", "x   y  z　 \n\nWord\r\n\t tab", "<|endoftext|> hé'll we're I'M 3rd", "", "   ", "a\n", "…abc—déf ﬁn 漢字kana 12½ 🙂🙂"]


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_chunks_give_the_ids_of_the_whole_text(rows, ranks):
    texts = [r[1] or "" for r in rows] + ODD
    own = tokenizer()
    for text, got in zip(texts, P.Ids(P.vocabulary_path(), ranks).of(texts)):
        assert got.tolist() == own.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é.,'s \n\t  漢1²-_\x0b", max_size=60))
def test_any_text(text):
    assert next(IDS.of([text])).tolist() == OWN.encode(text, add_special_tokens=False).ids


IDS, OWN = P.Ids(P.vocabulary_path(), RANKS), tokenizer()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_seats_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41)
    places = P.plan(counts, 40)
    used, bins = np.zeros(41, int), {}
    for length, first, end, sequence, offset in places:
        assert first == used[length]
        used[length] += end - first
        for k in range(end - first):
            bins.setdefault(sequence + k, []).append((offset, length))
    assert (used == counts).all()
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(bins) == list(range(len(bins)))


def test_two_for_one():
    """20 + 15 leave 5 of 40; 12 + 8 in place of 15 leave nothing."""
    counts = np.zeros(41, int)
    counts[[20, 15, 12, 8]] = 1
    places = P.plan(counts, 40)
    assert {p[0] for p in places if p[3] == 0} == {20, 12, 8}


def test_packing_against_whole_texts(docs, rows):
    got = [r.asDict() for r in P.packed(docs, P.vocabulary_path(), ranks=RANKS).collect()]
    own, by_doc, bins = tokenizer(), {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == [r[0] for r in rows]
    for doc, text in ((r[0], r[1]) for r in rows):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and len(by_doc[doc]) == -(-len(ids) // 2048)
    for own_ in bins.values():
        at = 0
        for r in sorted(own_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in got) // 2048) + 1


def test_odd_tables(repeated, none):
    assert P.packed(none, P.vocabulary_path()).count() == 0
    assert P.packed(repeated, P.vocabulary_path()).where("piece = 0").count() == repeated.count()


def test_over_the_whole_vocabulary():
    """What the shortcut rests on, for every token: both files hold the same bytes under the same numbers; no token spans a change from a word
    to white space or from letters to an ASCII character that isn't one; and both tokenise every token's text alike, alone and behind a blank."""
    import base64
    import re

    own, quick = tokenizer(), P.merges(RANKS)
    with open(RANKS, "rb") as file:
        ranks = {int(number): base64.b64decode(word) for word, number in map(bytes.split, file)}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    vocabulary = {number: bytes(byte_of[c] for c in word) for word, number in own.get_vocab().items() if number in ranks}
    assert vocabulary == ranks and len(ranks) == 50256
    for word in ranks.values():
        if not P.ODD.search(word.decode("utf-8", "replace")):  # texts with other white space are tokenised whole
            assert not re.search(rb"[^ \n\t\r][ \n\t\r]", word), word
            assert not re.search(rb"[A-Za-z][\x21-\x40\x5b-\x60\x7b-\x7e]", word), word
    texts = [t for w in ranks.values() if (t := w.decode("utf-8", "replace")) and "�" not in t]
    texts += [" " + t for t in texts if t[0] not in " \n\t\r"]
    assert len(texts) > 60_000
    assert [quick(t) for t in texts] == [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    got = P.Ids(P.vocabulary_path(), RANKS).of(texts)
    assert all(a.tolist() == b.ids for a, b in zip(got, own.encode_batch(texts, add_special_tokens=False), strict=True))

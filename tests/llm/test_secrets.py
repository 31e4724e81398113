import hashlib
import re

from specforge.llm import secrets as S


def spans(text):
    out = []
    for k, rule in enumerate(S.RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "") if len(m[rule.group]) >= rule.least]
    return sorted(out)


def told(found):
    return ",".join(f"{S.RULES[k].kind}:{a}:{b}" for a, k, b in found)


def test_spans_against_plain_scan(docs, rows):
    got = {r.doc_id: r for r in S.secret_spans(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found, x = spans(r[1]), got[r[0]]
        base = [s for s in found if s[1] < 3]
        assert x.spans == told(found) and x.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest()
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]


def test_rules_of_every_kind(spark):
    texts = ["eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "ghp_" + "A1" * 20, "xoxb-1234567890-abc", "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "🙂 PASSWD='abcdefghijkl' token: token = abcdefghijkl", "token=" * 3000 + "abcdefghijklm"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in S.secret_spans(docs).collect()}
    assert all(got[k] == told(spans(t)) and got[k] for k, t in enumerate(texts))


def test_queries_admit_every_match():
    samples = {"assign": ["Api_Key=abcdefghijkl", "APIKEY:abcdefghijkl", "pAsswd = abcdefghijkl"], "access": ["AKIA" + "Z" * 14], "chat": ["xoxs-0123456789"], "code_host": ["ghu_" + "a" * 36]}
    for rule in S.RULES:
        query = S.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text) and any(all(t in text.lower() for t in clause) for clause in query)


def test_postings_hold_every_trigram(docs, rows, monkeypatch):
    """The index is that of the texts: every trigram of every text, and no other."""
    from pyspark.sql import functions as F

    from specforge.llm.common import placed

    monkeypatch.setattr(S, "SEGMENT", 50)
    monkeypatch.setattr(S, "hashed", lambda c: c)
    held = placed(docs)
    where = {(r._file, r._row): (r.text or "").lower() for r in held.select("_file", "_row", F.col("_doc.text").alias("text")).collect()}
    got = {}
    for r in S.trigram_index(held).collect():
        for word in range(S.WORDS):
            for bit in range(S.WORD):
                if r[f"w{word}"] >> bit & 1:
                    got.setdefault((r._file, r._block * S.BLOCK + word * S.WORD + bit), set()).add(r.gram)
    for at, text in where.items():
        if text.isascii():
            assert got.get(at, set()) == {text[i : i + 3] for i in range(len(text) - 2)}


def test_candidates_are_few(docs, rows):
    from specforge.llm.common import placed

    held = placed(docs)
    some = S.candidates(held, S.RULES)
    texts = {r.text: r for r in held.join(some, ["_file", "_row"]).select("_doc.text", *[c for c in some.columns if c[0] == "c"]).collect()}
    for _, text, *_ in rows:
        for k, rule in enumerate(S.RULES):
            query = S.trigram_query(rule.pattern)
            if query and text and text.isascii():
                let = any(all(t in text.lower() for t in clause) for clause in query)
                assert let == bool(text in texts and texts[text][f"c{k}"])


def test_redaction(docs, rows):
    out = {r.doc_id: r for r in S.redact(docs).collect()}
    assert S.redact(docs).columns == docs.columns and len(out) == len(rows)
    for r in rows:
        text, at, found = r[1] or "", 0, spans(r[1])
        want = ""
        for a, _, b in found:
            if a >= at:
                want += text[at:a] + S.MASK
            at = max(at, b)
        x = out[r[0]]
        assert x.text == (want + text[at:] if found else r[1]) and (r[1] is None or x.n_chars == len(x.text)) and x.fp == "clash"


def test_odd_tables(repeated, none):
    assert S.secret_spans(none).count() == 0
    assert S.secret_spans(repeated).count() == repeated.count()

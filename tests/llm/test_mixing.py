import re

from specforge.llm import mixing as M


def plain_targets(sizes):
    total, fixed = 1.5 * sum(sizes), {}
    weight = [(3, 1, 2)[k % 3] for k in range(len(sizes))]
    while len(fixed) < len(sizes):
        rest = [k for k in range(len(sizes)) if k not in fixed]
        share = {k: (total - sum(fixed.values())) * weight[k] / sum(weight[j] for j in rest) for k in rest}
        above = [k for k in rest if share[k] > 2 * sizes[k]]
        if not above:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= {k: 2.0 * sizes[k] for k in above}
    return [fixed[k] for k in range(len(sizes))]


def test_targets():
    for sizes in ([10, 10, 10], [1000, 5, 7, 900], [0, 50, 3], [], [0, 0], [17]):
        assert all(abs(a - b) < 1e-9 for a, b in zip(M.targets(sizes), plain_targets(sizes), strict=True))


def plain_taken(line, goal, block):
    """Slots drawn one by one, blocks taken one by one."""
    names = sorted(line, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n in line[s]) for s in names}
    blocks = {s: max(1, -(-size[s] // block)) for s in names}
    edges, run = [], 0.0
    for g in goal:
        run += g
        edges.append(run / max(sum(goal), 1.0) * 2**32)
    edges[-1] = 2**32
    rank, taken = dict.fromkeys(names, 0), {}
    for t in range(-(-int(-(-sum(goal) // 1)) // block)):
        s = names[next(k for k, e in enumerate(edges) if t * M.GOLDEN % 2**32 < e)]
        if rank[s] < 2 * blocks[s]:
            b, at = rank[s] % blocks[s], 0
            for doc, n in line[s]:
                both = min(at + n, (b + 1) * block) - max(at, b * block)
                if both > 0:
                    taken[doc] = taken.get(doc, 0) + both
                at += n
        rank[s] += 1
    return taken


def test_mix_against_plain(docs, rows):
    got = {r.doc_id: r for r in M.mixed(docs, block=16).collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {k: r["size"] for k, r in got.items()} == size
    source = {r[0]: r[3] for r in rows}
    names = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    total = [sum(n for k, n in size.items() if source[k] == s) for s in names]
    goal = plain_targets(total)
    for k, r in got.items():
        at = names.index(source[k])
        assert r.source_size == total[at] and abs(r.target - goal[at]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    begin = {r.doc_id: r.begin for r in M.laid(docs, ["doc_id"]).collect()}
    line = {s: sorted(((k, size[k]) for k in size if source[k] == s and size[k]), key=lambda x: begin[x[0]]) for s in names}
    taken = plain_taken(line, goal, 16)
    assert {k: r.taken for k, r in got.items()} == {k: taken.get(k, 0) for k in size}
    for at, s in enumerate(names):
        assert abs(sum(r.taken for k, r in got.items() if source[k] == s) - goal[at]) <= 4 * 16


def test_lines_have_no_gaps(docs):
    by = {}
    for r in M.laid(docs, ["doc_id"]).collect():
        by.setdefault(r.source, []).append((r.begin, r["size"]))
    for own in by.values():
        at = 0
        for begin, n in sorted(own):
            assert begin == at
            at += n


def test_odd_tables(repeated, none, docs):
    assert M.mixed(none).count() == 0
    assert M.mixed(repeated).count() == repeated.count()
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    assert max(r["count"] for r in out.groupBy("doc_id").count().collect()) <= 2
    assert M.mix_documents(none).count() == 0


def test_rows_that_share_a_number_are_mixed_each(spark, repeated):
    from specforge.llm.common import placed

    rows = placed(repeated)
    at = M.mixed(rows.select("_file", "_row", "_doc.doc_id", "_doc.text", "_doc.source"), ["_file", "_row"]).select("_file", "_row", "copies")
    want = sorted((r.doc_id or -1, r.text, r.copies) for r in rows.join(at, ["_file", "_row"]).select("_doc.doc_id", "_doc.text", "copies").collect() if r.copies)
    got = {}
    for r in M.mix_documents(repeated).collect():
        got[r.doc_id or -1, r.text] = got.get((r.doc_id or -1, r.text), 0) + 1
    total = {}
    for doc, text, n in want:
        total[doc, text] = total.get((doc, text), 0) + n
    assert got == total


def test_columns_with_the_operators_own_names(spark):
    d = spark.createDataFrame([(k, "some words of text " * 40, "a", "_id", 1, 2, "m") for k in range(8)], "doc_id long, text string, source string, _id string, _copies long, _row long, _metadata string")
    out = M.mix_documents(d)
    assert out.columns == d.columns and {r._id for r in out.collect()} == {"_id"}


def test_places_are_those_of_files(spark, docs, rows, repeated):
    """Files' rows are known by where they stand; rows of joins and unions are written first, so every row has a place of its own."""
    from specforge.llm.common import placed, read_straight

    assert read_straight(docs) and read_straight(docs.where("doc_id > 3").select("doc_id", "text"))
    twice = docs.join(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, more string"), "doc_id")
    for d, straight in ((docs, True), (repeated, False), (twice, False), (docs.limit(3), False)):
        assert read_straight(d) == straight
        assert placed(d).select("_file", "_row").distinct().count() == d.count()

import math
import re
from collections import Counter

import numpy as np

from specforge.llm import quality as Q

WS = r"[^\x20\x09-\x0D]+"


def base(text):
    text = text or ""
    w = re.findall(WS, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WS, line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def failed(s):
    return s[0] < 10 or 100 * s[4] > 20 * s[0]


def test_counts(docs, rows):
    got = {r.doc_id: r for r in Q.judged(docs).collect()}
    assert len(got) == len(rows)
    for r in rows:
        x, s = got[r[0]], base(r[1])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == s
        assert x.base_failed == failed(s) and not (x.base_failed and x.kept)


def plain_distances(points):
    """The method in numpy: three starts, concentration steps, the least determinant, calibration."""
    half = lambda v: np.round(v / 64.0)
    floor = np.array([(f * Q.UNIT) ** 2 for f in Q.FLOORS])

    def scaled(cov):
        out = cov * Q.CONSISTENCY * Q.KEEP
        np.fill_diagonal(out, np.maximum(np.diag(cov) * Q.CONSISTENCY, floor))
        return out

    def model(rows):
        return rows.mean(0), scaled(np.cov(rows.T, bias=True))

    def distance(m, cov):
        return np.einsum("ni,ij,nj->n", points - m, np.linalg.inv(cov), points - m)

    def step(m, cov):
        q = np.floor(np.log(distance(m, cov) + 1e-9) * 64)
        return model(points[q <= np.percentile(q, 75)])

    mid = np.array([np.median(half(points[:, i])) * 64 for i in range(5)])
    off = np.array([np.median(half(abs(points[:, i] - mid[i]))) * 64 * 1.4826 for i in range(5)])
    models = [(mid, scaled(np.diag(off**2))), model(points), model(points[points[:, 0] <= mid[0]])]
    for _ in range(Q.TRIAL):
        models = [step(*x) for x in models]
    det = lambda x: np.linalg.slogdet(x[1])[1]
    best = min(models, key=det)
    for _ in range(Q.MOST):
        new = step(*best)
        if det(new) >= det(best) - Q.FALL:
            break
        best = new
    d = distance(*best)
    return d / max(1.0, np.exp(np.percentile(np.round(np.log(d + 1e-9) * 64), 50) / 64) / Q.MEDIAN)


def test_distances_against_plain(spark, tmp_path):
    import random

    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 200))) for _ in range(120)]
    texts += ["### ".join(f"x{rng.randint(0, 10**6)}" for _ in range(80)) for _ in range(3)]
    d = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    d.write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r for r in Q.judged(spark.read.parquet(str(tmp_path / "d"))).collect()}
    stats = [base(t) for t in texts]
    points = np.array([[round(x * Q.UNIT) for x in (math.log(s[0]), s[1] / s[0], math.sqrt(s[2] / s[1]), math.log1p(s[3]), math.sqrt(s[4] / s[0]))] for s in stats], float)
    want = plain_distances(points)
    assert np.allclose([got[k].distance for k in range(len(texts))], want, rtol=1e-6)
    assert all(got[k].kept for k in range(120)) and not any(got[k].kept for k in range(120, 123))


def test_odd_tables(repeated, none, docs):
    assert Q.judged(none).count() == 0
    assert Q.judged(repeated).count() == repeated.count()
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_moderate_outliers_go(spark):
    """Junk between words lies past the 0.999 quantile (20.5), though not far past it."""
    import random

    rng = random.Random(2)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = [" ".join(words(rng.randint(30, 200))) for _ in range(120)] + [" ".join(w + "|" for w in words(80)) for _ in range(3)]
    d = spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.judged(d).collect()}
    assert all(20.6 < got[k].distance < 60 and not got[k].kept for k in range(120, 123))
    assert all(got[k].kept for k in range(120))


def test_planted_outliers_of_several_statistics(spark):
    """A tenth of all rows is junk of one kind; it neither hides itself nor takes clean rows with it."""
    import random

    rng = random.Random(3)
    words = lambda n, size=7: [f"{rng.randint(0, 10**size):0{size}d}" for _ in range(n)]
    clean = [" ".join(words(rng.randint(40, 160), rng.choice((4, 5, 6)))) for _ in range(360)]
    junk = [" ".join(w + "#$" for w in words(rng.randint(40, 160), 30)) for _ in range(40)]
    d = spark.createDataFrame([(k, t, "en", f"s{k % 3}") for k, t in enumerate(clean + junk)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in Q.judged(d).collect()}
    assert not any(got[k] for k in range(360, 400)) and sum(got[k] for k in range(360)) >= 356


def test_small_groups_are_pooled_by_language_and_judged(spark):
    import random

    rng = random.Random(4)
    rows = [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)), "en", f"s{k}") for k in range(30)]
    rows += [(100, " ".join("a#b$" for _ in range(4)) + " " + " ".join(f"| |{k}| |" for k in range(60)), "en", "junk"), (None, rows[0][1], None, None), (5, rows[1][1], "en", "s0")]
    got = [(r.doc_id, r.kept) for r in Q.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()]
    assert sorted(k for k, kept in got if not kept) == [100] and len(got) == 33


def test_each_row_by_its_own_verdict(spark, none):
    words = " ".join(f"w{k}" for k in range(50))
    d = spark.createDataFrame([(1, words, "en", "a", "x"), (1, "too short", "en", "a", "x"), (None, words, None, None, "y"), (None, None, None, None, "z")], "doc_id long, text string, lang string, source string, _bad string")
    kept = Q.quality_filter(d)
    assert kept.columns == d.columns and sorted(r._bad for r in kept.collect()) == ["x", "y"]
    assert Q.quality_filter(none).count() == 0

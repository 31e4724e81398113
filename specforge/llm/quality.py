"""Quality rules: robust multivariate outliers by the minimum covariance determinant, in DataFrame functions only.

Every document becomes five counts, five transformed statistics and, per language and source, a Mahalanobis distance from the
location and scatter of the subset of ``SHARE`` of the rows whose covariance has the least determinant.  The subset is sought
from three starts (medians with median absolute deviations; mean and covariance of all rows; those of the shorter half): every
concentration step takes the mean and covariance of the rows that lie nearest, for all starts in one pass.  After ``TRIAL``
steps a group goes on with its start of the least determinant until that falls no more (``MOST`` steps at most).  Statistics are
whole numbers (units of 1/4096) and sums of products are exact decimals, so reruns agree whatever the order of rows.

Calibration: ``CONSISTENCY`` makes the covariance of the nearest 75 % that of all rows, if they are normal; where a group's
median squared distance is still above that of chi-square, its distances are divided by the ratio.  Variances under ``FLOORS``
are raised to them, since a statistic that is zero nearly everywhere would otherwise make the rare small value an outlier;
covariances are multiplied by ``KEEP``, so that the matrix is regular even where two statistics move together exactly.

The statistics table has a few numbers a document; all that is gathered per group is 21 sums or a histogram of a bounded
number of rounded values, combined before any exchange, so a group with a third of all rows is no hot key.  Models are joined by
group, not by row: no text is ever shuffled.

Nulls: a null text has no words (and fails the base rules); null languages and sources are groups like any other.  Groups of a
language and source under ``MIN_GROUP`` rows that pass the base rules share an estimate with the other small ones of their
language, and languages whose small groups are under it together share one with one another.  Repeated rows and rows with
equal or null doc_ids are separate rows.  Columns of docs may have any name.  Empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specforge.llm.common import SPACE, table, written

WINDOW = 5
SHARE = 0.75
#: Steps that all starts take; steps that the best start takes at most.
TRIAL, MOST = 2, 12
STARTS = 3
MIN_GROUP = 50
KEEP = 0.98
#: A step counts if it lowers the logarithm of the determinant by so much.
FALL = 1e-3
UNIT = 4096.0
#: Least standard deviations of: ln words, mean word length, symbol share root, ln repeated lines, repeated word share root.
FLOORS = (0.5, 0.4, 0.06, 0.5, 0.12)
#: Makes the covariance of the nearest 75 % of five normal variables that of all of them.
CONSISTENCY = 1.41
#: Squared distance above which a document is rejected: the 0.999 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 20.515
#: The median of chi-square with 5 degrees of freedom.
MEDIAN = 4.351
P = 5


def counts(docs: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words beside the columns of docs."""
    own = docs.columns
    d = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    d = d.withColumn("_w", F.filter(F.split("_t", f"[{SPACE}]+"), lambda w: w != ""))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    d = d.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)),
            "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_h": F.transform("_w", lambda w: F.xxhash64(w)),
        }
    )
    at = lambda i: [F.get("_h", i + k) for k in range(WINDOW)]
    windows = F.when(
        F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*at(i)))
    ).otherwise(F.array().cast("array<long>"))
    d = d.withColumn("_g", windows)
    d = d.withColumn("n_repeat_words", repeated("_g"))
    return d.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(windows: str) -> Column:
    """Words that windows found twice or more cover: sorted with their places, equal neighbours are the repeats."""
    hashes = F.col(windows)
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    # transform over a one-element array binds the sorted windows to a name, so they are sorted once
    found = F.flatten(F.transform(F.array(placed), places))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        found,
        start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistics() -> list[Column]:
    """The transformed statistics in whole units; rows that pass the base rules have words."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    raw = [
        F.log(words),
        F.least(chars / words, F.lit(40.0)),
        F.sqrt(F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [F.round(x * UNIT).cast("long").alias(f"x{i}") for i, x in enumerate(raw)]


def estimate(points: DataFrame, by: list[str]) -> DataFrame:
    """Per group: mean m0.., lower Cholesky factor l00.. of the covariance, and _det, the logarithm of its determinant."""
    big = lambda c: c.cast("decimal(20,0)")
    sums = [F.sum(big(F.col(f"x{i}"))).cast("double").alias(f"s{i}") for i in range(P)]
    sums += [F.sum(big(F.col(f"x{i}") * F.col(f"x{j}"))).cast("double").alias(f"s{i}{j}") for i in range(P) for j in range(i + 1)]
    g = points.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    return factored(g, by, [F.col(f"s{i}") / F.col("n") for i in range(P)], lambda i, j: F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))


def factored(g: DataFrame, by: list[str], means: list[Column], cov) -> DataFrame:
    g = g.withColumns({f"m{i}": m for i, m in enumerate(means)})
    floor = [(f * UNIT) ** 2 for f in FLOORS]
    scaled = lambda i, j: F.greatest(cov(i, i) * CONSISTENCY, F.lit(floor[i])) if i == j else cov(i, j) * (CONSISTENCY * KEEP)
    g = g.withColumns({f"c{i}{j}": scaled(i, j) for i in range(P) for j in range(i + 1)})
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            g = g.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}{i}")) for i in range(P)])
    return g.select(*by, *MODEL, det.alias("_det"))


MODEL = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]]


def starts(points: DataFrame) -> DataFrame:
    """The models that steps begin with: (_g, _s, model); the histograms behind exact percentiles hold rounded values only."""
    coarse = lambda c: F.round(c / 64.0)
    mid = written(points.groupBy("_g").agg(*[(F.percentile(coarse(F.col(f"x{i}")), 0.5) * 64).alias(f"d{i}") for i in range(P)]), "medians", 4)
    centred = points.join(mid, "_g")
    off = centred.groupBy("_g")
    off = off.agg(*[(F.percentile(coarse(F.abs(F.col(f"x{i}") - F.col(f"d{i}"))), 0.5) * 64 * 1.4826).alias(f"a{i}") for i in range(P)])
    g = mid.join(off, "_g").withColumn("_s", F.lit(0))
    medians = factored(g, ["_g", "_s"], [F.col(f"d{i}") for i in range(P)], lambda i, j: F.pow(F.col(f"a{i}"), 2) if i == j else F.lit(0.0))
    halves = centred.select("_g", F.explode(F.when(F.col("x0") <= F.col("d0"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_s"), *POINT)
    return medians.unionByName(estimate(halves, ["_g", "_s"]))


POINT = [f"x{i}" for i in range(P)]


def squared(d: DataFrame) -> DataFrame:
    """d (point, model) with d2, the squared Mahalanobis distance by forward substitution."""
    columns = d.columns
    for i in range(P):
        known = sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))
        d = d.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return d.select(*columns, reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]).alias("d2"))


def distances(points: DataFrame, model: DataFrame) -> DataFrame:
    """points with d2 for every model of their group, and what else the model's rows hold."""
    return squared(points.join(model, "_g")).drop(*MODEL)


def step(points: DataFrame, model: DataFrame) -> DataFrame:
    """A concentration step: the models of the SHARE of a group's rows that lie nearest to each of its models."""
    ranked = distances(points, model).withColumn("_q", F.floor(F.log(F.col("d2") + 1e-9) * 64))
    edge = written(ranked.groupBy("_g", "_s").agg(F.percentile("_q", SHARE).alias("_edge")), "edge", 4)
    return written(estimate(ranked.join(edge, ["_g", "_s"]).where("_q <= _edge"), ["_g", "_s"]), "model", 4)


def fitted(points: DataFrame) -> DataFrame:
    """(_g, model, _scale) of points (_g, x0..): the estimate of the least determinant that was found."""
    model = written(starts(points), "model", 4)
    for _ in range(TRIAL):
        model = step(points, model)
    best = F.min_by(F.struct("_s", *MODEL, "_det"), F.struct("_det", "_s")).alias("b")
    model = written(model.groupBy("_g").agg(best).select("_g", "b.*"), "model", 4)
    still = model
    for _ in range(MOST):
        new = step(points.join(still.select("_g"), "_g", "left_semi"), still)
        old = still.select("_g", F.col("_det").alias("_was"))
        still = written(new.join(old, "_g").where(F.col("_det") < F.col("_was") - FALL).drop("_was"), "still", 4)
        if not still.limit(1).count():
            break
        model = written(model.join(still.select("_g"), "_g", "left_anti").unionByName(still), "model", 4)
    near = F.round(F.log(F.col("d2") + 1e-9) * 64)
    scale = distances(points, model).groupBy("_g").agg(F.greatest(F.lit(1.0), F.exp(F.percentile(near, 0.5) / 64) / MEDIAN).alias("_scale"))
    return written(model.join(scale, "_g").select("_g", *MODEL, "_scale"), "fitted", 4)


def judged_rows(stats: DataFrame) -> DataFrame:
    """stats (lang, source, the counts) with base_failed, kept and distance, the squared distance (null where the base rules fail)."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    stats = stats.withColumns({"_k": F.xxhash64(named("lang"), named("source")), "_lang": F.xxhash64(named("lang"))})
    points = stats.where(~base_failed()).select("_k", "_lang", *statistics())
    sizes = points.groupBy("_k", "_lang").agg(F.count("*").alias("_n"))
    small = F.sum(F.when(F.col("_n") < MIN_GROUP, F.col("_n"))).over(Window.partitionBy("_lang"))
    group = F.when(F.col("_n") >= MIN_GROUP, F.col("_k")).when(small >= MIN_GROUP, F.col("_lang")).otherwise(F.lit(0).cast("long"))
    groups = written(sizes.select("_k", group.alias("_g")), "groups", 4)
    points = written(points.join(groups, "_k").select("_g", *POINT), "points")
    model = written(groups.join(fitted(points), "_g").drop("_g"), "models", 4)
    d = squared(stats.select("*", *statistics()).join(model, "_k", "left"))
    d = d.withColumns({"base_failed": base_failed(), "distance": F.when(~base_failed(), F.col("d2") / F.col("_scale"))})
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return d.select(*[c for c in stats.columns if c not in ("_k", "_lang")], "base_failed", kept.alias("kept"), "distance")


def measured(docs: DataFrame, *own: str | Column) -> DataFrame:
    """lang, source, the counts and the named columns of docs, written once."""
    lean = docs.select(*own, "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    return written(counts(lean).drop("text"), "statistics")


def judged(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source, the counts, base_failed, kept and the squared distance (null where there is none)."""
    return judged_rows(measured(docs, "doc_id"))


def quality_filter(docs: DataFrame) -> DataFrame:
    """All columns of the rows that the rules keep, each row by its own verdict; rows are written once as structs beside their counts."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return judged_rows(measured(docs, whole)).where("kept").select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )

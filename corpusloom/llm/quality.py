"""Quality rules: exact text statistics, and robust outliers of their joint distribution.

The statistics of a text become a short vector of logarithms and shares. For each
language and source the minimum covariance determinant estimate of its distribution is
searched from several starts: the medians, and means of a few rows drawn by hash. A
concentration step ranks rows by their distance from the current centre and takes mean and
covariance of the nearest ``SUPPORT`` of them, which never raises the determinant. After a
few steps the starts with the smallest determinants go on until theirs no longer fall, and
the smallest is the estimate. Where a source is small its language is estimated, where
that is small all documents are. A document is rejected when its squared Mahalanobis
distance from the estimate is beyond the outer fence of the distances there.

All of it is DataFrame code over narrow rows. Quantiles are taken from counts in fixed
bins, so they do not depend on how rows are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.skew import join_weighted
from corpusloom.llm.text import SPACE_CHARS, let, row_key, text_of, words
from corpusloom.session import cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SUPPORT = 0.75
#: Starts besides the medians, rows a start is drawn from, steps before all but the best
#: starts are left, starts that go on, and most steps after that.
DRAWN_STARTS = 4
DRAWN_ROWS = 6
FIRST_STEPS = 2
BEST_STARTS = 2
MOST_STEPS = 12
#: A determinant that falls by less than this share has converged.
FALL = 1e-6
MIN_GROUP = 60
#: Cells whose estimates are sent to all tasks; more of them are joined by shuffle.
BROADCAST_CELLS = 20_000
#: Bins of squared distances, in units of ``log1p(16 * d2)``, and of statistics, in units of their floors.
DISTANCE_BINS = 64
STATISTIC_BINS = 8
#: Median of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515
#: Third quartile of that distribution as a multiple of the median; no cell counts as tighter.
CHI2_SPREAD = 1.5227
#: Fence on the distances, as a multiple of the upper half of their interquartile range
#: above the third quartile; it follows tails that are heavier than those of a normal cloud.
#: In one of those the fence lies at 42, the quantile that one document in 17 million exceeds.
FENCE = 8
FEATURES = ("f_size", "f_word", "f_symbol", "f_line", "f_repeat")
#: Standard deviations below which a statistic counts as constant. Without them a source
#: whose documents all lack symbols would reject a document with one. Lengths of sound texts
#: differ by orders of magnitude, so a few texts of one length do not make others outliers.
FLOORS = (1.0, 0.05, 0.10, 0.05, 0.05)


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more, the first ones included.

    Windows are compared by a 64-bit hash of their words inside one text only.
    """
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    grams = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - 2),
        lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i), F.get(h, i + 1)),
    ))

    def covered(g: Column) -> Column:
        pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        again = let(pairs, lambda p: F.filter(p, lambda x, j: (F.get(p, j - 1)["g"] == x["g"]) | (F.get(p, j + 1)["g"] == x["g"])))
        starts = let(again, lambda a: F.array_sort(F.transform(a, lambda x: x["i"])))
        return F.aggregate(
            starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
            lambda acc: acc["n"],
        )

    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(some)


def statistics(text: Column) -> Column:
    """Struct of the six counts of a text; a null text has none of anything."""
    return let(text, lambda t: let(words(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""),
            lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    )))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, language, source, the counts and the transformed vector of each document."""
    stats = docs.select(
        "doc_id", row_key().alias("_row"), F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"),
        statistics(text_of()).alias("_s"),
    ).select("doc_id", "_row", "_lang", "_source", "_s.*")
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns({
        "base_failed": base_failed(),
        "f_size": F.log(n),
        "f_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "f_symbol": F.log1p(10 * F.col("n_symbols") / n),
        "f_line": F.col("n_dup_lines") / n,
        "f_repeat": F.col("n_repeat_words") / n,
    })


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds the cell that judges each row: language and source, or the language, or all
    documents, the first with ``MIN_GROUP`` documents that pass the base rule; ``_cells``
    has all three."""
    sizes = rows.groupBy("_lang", "_source").agg(F.count_if(~F.col("base_failed")).alias("_n"), F.count(F.lit(1)).alias("_total"))
    langs = sizes.groupBy("_lang").agg(F.sum("_n").alias("_n_lang"))
    own = F.to_json(F.struct(F.col("s._lang").alias("l"), F.col("s._source").alias("s"), F.lit(1).alias("own")))
    lang = F.to_json(F.struct(F.col("s._lang").alias("l"), F.lit(0).alias("own")))
    cells = sizes.alias("s").join(langs.alias("m"), F.col("s._lang").eqNullSafe(F.col("m._lang"))).select(
        F.col("s._lang").alias("_l"), F.col("s._source").alias("_o"),
        F.when(F.col("_n") >= MIN_GROUP, own).when(F.col("_n_lang") >= MIN_GROUP, lang).otherwise("all").alias("_cell"),
        F.array(own, lang, F.lit("all")).alias("_cells"), own.alias("_key"), "s._total",
    )
    keyed = rows.withColumn("_key", F.to_json(F.struct(F.col("_lang").alias("l"), F.col("_source").alias("s"), F.lit(1).alias("own"))))
    cells = cut(cells, "cells")
    return _by_key(keyed, cells, "_key", "_total", Weights.of(cells, "_total")).drop("_key", "_total")


@dataclass(frozen=True)
class Weights:
    """Rows per key, ``table(key, weight)``, with the number of keys and of rows."""

    table: DataFrame
    keys: int
    rows: int

    @classmethod
    def of(cls, table: DataFrame, weight: str) -> Weights:
        total, n = table.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count(F.lit(1))).first()
        return cls(table, n, total)


def _by_key(rows: DataFrame, table: DataFrame, key: str, weight: str, weights: Weights) -> DataFrame:
    """Inner join with a table of one row a key. It is sent to all tasks if it has few
    keys; otherwise only the heaviest are."""
    return rows.join(F.broadcast(table), key) if weights.keys <= BROADCAST_CELLS else join_weighted(rows, table, key, F.col(weight), weights.rows)


DIMENSIONS = range(len(FEATURES))
#: Lower triangle of a matrix over the statistics, row by row, as it lies in an array.
PLACES = [(i, j) for i in DIMENSIONS for j in range(i + 1)]
#: What an estimate consists of: ``m`` is the centre, ``w`` the inverse Cholesky factor of
#: the covariance, whose determinant is ``det``.
ESTIMATE = ("m", "w", "det")


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, t: s + term(t))


def _triangle(entry) -> Column:
    """Array of the lower triangle; ``entry(so far, k, i, j)`` is the k-th, at row i and column j."""
    rows, columns = (F.array(*[F.lit(p[side]) for p in PLACES]) for side in (0, 1))
    none = F.array().cast("array<double>")
    step = lambda acc, k: F.concat(acc, F.array(entry(acc, k, F.get(rows, k), F.get(columns, k))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(PLACES) - 1)), none, step)


def _at(i: Column, j: Column) -> Column:
    """Place of row i, column j in a lower triangle."""
    return (i * (i + 1) / 2 + j).cast("int")


def _cholesky(cov: Column) -> Column:
    """Factor of a covariance; the floors on its diagonal keep it regular."""
    least = F.array(*[F.lit(f**2 / 4) for f in FLOORS])
    before = lambda j: F.filter(F.sequence(F.lit(0), F.lit(len(FEATURES))), lambda t: t < j)

    def entry(acc, k, i, j):
        rest = F.get(cov, k) - _sum(before(j), lambda t: F.get(acc, _at(i, t)) * F.get(acc, _at(j, t)))
        return F.when(i == j, F.sqrt(F.greatest(rest, F.get(least, i)))).otherwise(rest / F.get(acc, _at(j, j)))

    return _triangle(entry)


def _inverse(low: Column) -> Column:
    """Inverse of a lower triangle."""
    between = lambda i, j: F.filter(F.sequence(F.lit(0), F.lit(len(FEATURES))), lambda t: (t >= j) & (t < i))

    def entry(acc, k, i, j):
        below = _sum(between(i, j), lambda t: F.get(low, _at(i, t)) * F.get(acc, _at(t, j)))
        return F.when(i == j, 1 / F.get(low, k)).otherwise(-below / F.get(low, _at(i, i)))

    return _triangle(entry)


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean, inverse factor of the covariance and its determinant per key."""
    n = F.count(F.lit(1))
    sums = rows.groupBy(*keys).agg(
        F.array(*[F.sum(f) / n for f in FEATURES]).alias("m"), F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) / n for i, j in PLACES]).alias("e")
    )
    mean = lambda i: F.get("m", F.lit(i))
    floor = lambda i, j: FLOORS[i] ** 2 if i == j else 0.0
    cov = F.array(*[F.get("e", F.lit(k)) - mean(i) * mean(j) + floor(i, j) for k, (i, j) in enumerate(PLACES)])
    factor = sums.select(*keys, "m", cov.alias("c")).select(*keys, "m", _cholesky(F.col("c")).alias("l"))
    diagonal = [F.get("l", F.lit(k)) for k, (i, j) in enumerate(PLACES) if i == j]
    return factor.select(*keys, "m", _inverse(F.col("l")).alias("w"), reduce(lambda a, b: a * b, [d * d for d in diagonal]).alias("det"))


def _quantile_bins(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """First bin at which each share of a key's rows is reached, from ``counts(*keys, bin, n)``."""
    up_to = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    of_all = F.sum("n").over(Window.partitionBy(*keys))
    reached = counts.withColumns({"_up": up_to, "_all": of_all})
    return reached.groupBy(*keys).agg(*[F.min(F.when(F.col("_up") >= F.col("_all") * share, F.col("bin"))).alias(f"q{k}") for k, share in enumerate(shares)])


def _medians(members: DataFrame) -> DataFrame:
    """Coordinate-wise medians and median absolute deviations, in bins, as a first estimate."""
    unit = F.element_at(F.array(*[F.lit(f / STATISTIC_BINS) for f in FLOORS]), F.col("i") + 1)
    values = members.select("_cell", F.posexplode(F.array(*FEATURES)).alias("i", "x")).withColumn("bin", F.floor(F.col("x") / unit))
    counts = cut(values.groupBy("_cell", "i", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")
    middle = _quantile_bins(counts, ["_cell", "i"], [0.5]).withColumnRenamed("q0", "m")
    off = counts.join(middle, ["_cell", "i"]).groupBy("_cell", "i", "m", F.abs(F.col("bin") - F.col("m")).alias("bin")).agg(F.sum("n").alias("n"))
    both = _quantile_bins(off, ["_cell", "i", "m"], [0.5])
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    step = [f / STATISTIC_BINS for f in FLOORS]
    spread = lambda i: F.sqrt((1.4826 * step[i] * at("q0", i)) ** 2 + FLOORS[i] ** 2)
    return both.groupBy("_cell").agg(
        F.array(*[(at("m", i) + 0.5) * step[i] for i in DIMENSIONS]).alias("m"),
        F.array(*[1 / spread(i) if i == j else F.lit(0.0) for i, j in PLACES]).alias("w"),
    ).select("_cell", F.lit(0).alias("start"), "m", "w", F.lit(float("inf")).alias("det"))


def _drawn(members: DataFrame) -> DataFrame:
    """Moments of a few rows of each cell for every drawn start; the draw depends on the rows only."""
    each = members.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(DRAWN_STARTS))))
    order = Window.partitionBy("_cell", "start").orderBy(F.xxhash64("start", *FEATURES), *FEATURES)
    few = each.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= DRAWN_ROWS)
    return _moments(few, "_cell", "start").withColumn("det", F.lit(float("inf")))


def _with_distance(rows: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance ``_d2`` to rows with their estimate."""
    off = [F.col(f) - F.get("m", F.lit(i)) for i, f in enumerate(FEATURES)]
    row = lambda i: reduce(lambda a, b: a + b, [F.get("w", F.lit(k)) * off[q] for k, (p, q) in enumerate(PLACES) if p == i])
    return rows.withColumn("_d2", reduce(lambda a, b: a + b, [F.pow(row(i), F.lit(2)) for i in DIMENSIONS])).drop(*ESTIMATE)


def _bin(d2: Column) -> Column:
    return F.floor(F.log1p(16 * d2) * DISTANCE_BINS)


def _edge(bin_: Column) -> Column:
    """Upper edge of a bin of squared distances."""
    return F.expm1((bin_ + 1) / DISTANCE_BINS) / 16


def _measured_from(members: DataFrame, estimates: DataFrame, sizes: Weights) -> DataFrame:
    """Members with their distance from each estimate of their cell, whose estimates travel as one row."""
    lists = estimates.groupBy("_cell").agg(F.collect_list(F.struct(*[c for c in estimates.columns if c != "_cell"])).alias("_e")).join(sizes.table, "_cell")
    met = _by_key(members, lists, "_cell", "_n", sizes).select("_cell", *FEATURES, F.explode("_e").alias("_e")).select("_cell", *FEATURES, "_e.*")
    return _with_distance(met).withColumn("bin", _bin(F.col("_d2")))


def _concentrated(members: DataFrame, estimates: DataFrame, sizes: Weights) -> DataFrame:
    """One concentration step of every start; ``fell`` tells whether the determinant still does."""
    keys = ["_cell", "start"]
    far = _measured_from(members, estimates, sizes)
    radius = _quantile_bins(far.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")), keys, [SUPPORT])
    within = estimates.join(radius, keys).withColumnRenamed("q0", "radius")
    near = _measured_from(members, within, sizes).where(F.col("bin") <= F.col("radius"))
    old = estimates.select(*keys, F.col("det").alias("det_before"))
    fresh = _moments(near, *keys).join(old, keys)
    return cut(fresh.withColumn("fell", F.col("det") < F.col("det_before") * (1 - FALL)).drop("det_before"), "centre")


def _estimate(members: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimate per cell, with its consistency ``scale`` and
    the ``cutoff`` of scaled distances."""
    sizes = Weights.of(cut(members.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")), "sizes"), "_n")
    current = cut(_medians(members).unionByName(_drawn(members)), "centre")
    state = lambda df: df.select("_cell", "start", *ESTIMATE)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy("det", "start"))
    for _ in range(FIRST_STEPS):
        current = _concentrated(members, state(current), sizes)
    current = cut(current.withColumn("_rank", rank).where(F.col("_rank") <= BEST_STARTS).drop("_rank"), "centre")
    done = []
    for _ in range(MOST_STEPS):
        moving = current.where("fell")
        done.append(state(current.where("not fell")))
        if moving.isEmpty():
            break
        current = _concentrated(members, state(moving), sizes)
    else:
        done.append(state(current.where("fell")))
    best = cut(reduce(DataFrame.unionByName, done).withColumn("_rank", rank).where("_rank = 1").drop("_rank"), "best")
    counts = _measured_from(members, best, sizes).groupBy("_cell", "bin").agg(F.count(F.lit(1)).alias("n"))
    quartiles = _quantile_bins(counts, ["_cell"], [0.5, 0.75])
    # Trimming shrinks a covariance, so its correction only makes distances smaller; where
    # the floors rule, distances are below those of a normal cloud and stay what they are.
    scale = F.greatest(_edge(F.col("q0")) / CHI2_MEDIAN, F.lit(1.0))
    spread = F.greatest(_edge(F.col("q1")) / (F.col("scale") * CHI2_MEDIAN), F.lit(CHI2_SPREAD))
    fence = CHI2_MEDIAN * F.pow((1 + FENCE) * F.sqrt(spread) - FENCE, F.lit(2))
    fitted = quartiles.withColumn("scale", scale).withColumn("cutoff", fence).select("_cell", "scale", "cutoff")
    return cut(best.drop("start").join(fitted, "_cell").join(sizes.table, "_cell"), "estimate")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``distance2``, ``kept``.

    Null texts count as empty and fail the base rule, as every text under 50 words does.
    Only documents that pass the base rule shape the estimate. Null languages and sources
    are groups like any other. Every document is judged, at the latest by the estimate of
    all documents; repeated rows are judged alike; an empty table gives no rows.
    """
    rows = cut(_grouped(cut(measured(docs), "statistics")), "statistics")
    used = rows.select("_cell").distinct()
    members = rows.where(~F.col("base_failed")).select(F.explode("_cells").alias("_cell"), *FEATURES).join(used, "_cell", "left_semi")
    estimate = _estimate(cut(members, "members"))
    known = Weights.of(estimate, "_n")
    if known.keys:
        measured_rows = _with_distance(_by_key(rows, estimate, "_cell", "_n", known))
    else:  # no document passes the base rule
        measured_rows = rows.withColumns({"_d2": F.lit(None).cast("double"), "scale": F.lit(1.0), "cutoff": F.lit(1.0)})
    judged = measured_rows.withColumn("distance2", F.col("_d2") / F.col("scale"))
    outlier = F.coalesce(F.col("distance2") > F.col("cutoff"), F.lit(False))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~outlier).alias("kept"), "distance2", F.col("_row").alias("row"),
    )
